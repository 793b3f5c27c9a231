"""The code hierarchy as a table of nodes, its statistics, documents for retrieval, and level-by-level search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.scalars import LEVELS, is_valid_code


def nodes(codebook: DataFrame) -> DataFrame:
    """(level, node, parent, label, children) from (row, code, category, cause, description).

    Chapters and groups are labelled with their first four sorted categories, lower levels with the first row's
    cause or description.
    """
    names = list(LEVELS)
    at = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(n).alias("len"), F.lit(LEVELS[names[i - 1]] if i else 0).alias("up")) for i, (k, n) in enumerate(LEVELS.items())])
    e = codebook.withColumn("l", F.explode(at))
    e = e.select("row", "category", "cause", "description", F.col("l.level").alias("level"), F.substr("code", F.lit(1), F.col("l.len")).alias("node"), F.when(F.col("l.up") > 0, F.substr("code", F.lit(1), F.col("l.up"))).otherwise("root").alias("parent"))
    g = e.groupBy("level", "node", "parent").agg(F.array_sort(F.collect_set("category")).alias("cats"), F.min_by("cause", "row").alias("cause"), F.min_by("description", "row").alias("description"))
    many = F.concat(F.array_join(F.slice("cats", 1, 4), "; "), F.when(F.size("cats") > 4, "; ...").otherwise(""))
    label = F.when(F.col("level").isin("chapter", "group"), many).when(F.col("level") == "code", F.col("description")).otherwise(F.col("cause"))
    kids = g.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    out = g.select("level", "node", "parent", label.alias("label"))
    return out.join(kids, "node", "left").na.fill(0, ["children"]).select("level", "node", "parent", "label", "children")


def tree_stats(tree: DataFrame, total: str = "total") -> DataFrame:
    """Nodes and most children of each level and of the whole tree."""
    both = tree.withColumn("level", F.explode(F.array(F.col("level"), F.lit(total))))
    return both.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.max("children").alias("max_branching"))


def branching(tree: DataFrame, threshold: int = 10) -> DataFrame:
    """Children of the parents at each level."""
    return tree.where("children > 0").groupBy("level").agg(F.count(F.lit(1)).alias("parents"), F.round(F.avg("children"), 9).alias("mean"), F.median("children").alias("median"), F.max("children").alias("most"), F.count_if(F.col("children") > threshold).alias("over"))


def cross_map(codebook: DataFrame, group: str = "category") -> DataFrame:
    """Each value of a grouping column with its sorted chapters, and its codes and blocks."""
    return codebook.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(F.substring("code", 1, 1))), ",").alias("chapters"), F.countDistinct(F.substring("code", 1, 3)).alias("blocks"), F.countDistinct("code").alias("codes"))


def cross_counts(codebook: DataFrame) -> DataFrame:
    """Codes of each chapter, block and category."""
    return codebook.groupBy(F.substring("code", 1, 1).alias("chapter"), F.substring("code", 1, 3).alias("block"), "category").agg(F.countDistinct("code").alias("codes"))


def documents(codebook: DataFrame, level: int, history: str | None = "histcat") -> DataFrame:
    """(node, text): for each prefix its name and the sorted distinct values of the columns, each under its title.

    Single letters are named by their categories and leave descriptions out; a cause that only repeats the
    descriptions is left out. `history` is a column of older categories, if the book has it.
    """
    d = codebook.where(is_valid_code("code"))
    history = history if history in codebook.columns else None
    values = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(F.col(c)), F.lit("")))), "; ").alias(c)
    g = d.groupBy(F.substring("code", 1, level).alias("node")).agg(*[values(c) for c in ("description", "cause", "category", *([history] if history else []))])
    head = F.col("category") if level == 1 else F.col("description")
    part = lambda title, c: F.when((F.col(c) != "") & (F.col(c) != head), F.concat(F.lit(f"{title}: "), F.col(c)))
    rest = [part("Cause", "cause"), *([] if level == 1 else [part("Category", "category")]), *([part("HistCat", history)] if history else [])]
    return g.select("node", F.concat_ws(" | ", F.concat("node", F.lit(": "), head), *rest).alias("text"))


def path(tree: DataFrame, code: str) -> DataFrame:
    """The nodes from chapter to code."""
    return tree.where(F.col("node").isin(*[code[:n] for n in LEVELS.values() if n <= len(code)])).orderBy(F.length("node"))


def beam_narrow(queries: DataFrame, tree: DataFrame, scores: DataFrame, beam: int, choices: int, id_col: str = "query_id") -> DataFrame:
    """(id, code, place): level by level the best children of each beam, in the beams' order, cut to the beam's width.

    scores: (id, node, score), the order in which children are chosen; children without one come last, ties by
    node. A node with one child passes to it; a node met twice keeps its first place. The leaves are the answer.
    """
    kids = tree.groupBy("parent").agg(F.count(F.lit(1)).alias("_n")).join(tree.select("parent", F.col("node").alias("child")), "parent").withColumnRenamed("parent", "node")
    live = queries.select(id_col).withColumns({"node": F.lit("root"), "place": F.lit(1)})
    asked = scores.select(id_col, F.col("node").alias("child"), "score")
    for _ in LEVELS:
        each = live.join(kids, "node").join(asked, [id_col, "child"], "left")
        each = each.withColumn("_c", F.row_number().over(Window.partitionBy(id_col, "node").orderBy(F.col("score").desc_nulls_last(), "child"))).where((F.col("_c") <= choices) | (F.col("_n") == 1))
        first = each.groupBy(id_col, "child").agg(F.min(F.struct("place", "_c")).alias("_o"))
        live = first.withColumn("place", F.row_number().over(Window.partitionBy(id_col).orderBy("_o.place", "_o._c"))).where(F.col("place") <= beam).select(id_col, F.col("child").alias("node"), "place")
    return live.select(id_col, F.col("node").alias("code"), "place")


def attach_description(counts: DataFrame, codebook: DataFrame, columns: Sequence[str] = ("description",)) -> DataFrame:
    return counts.join(codebook.select("code", *columns), "code", "left")
