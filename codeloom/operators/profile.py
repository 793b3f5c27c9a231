"""Corpus profiles: class counts, concentration, cardinality, lengths, before and after tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.scalars import extract_field
from codeloom.operators.metrics import ratio


def class_counts(df: DataFrame, codes: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, code, n): occurrences; everything below works on this small table."""
    return df.select(*by, F.explode(codes).alias("code")).groupBy(*by, "code").agg(F.count(F.lit(1)).alias("n"))


def label_vocabulary(counts: DataFrame) -> DataFrame:
    """(code, id): ids by sort order; one row a class."""
    return counts.select("code").distinct().withColumn("id", F.row_number().over(Window.orderBy("code")) - 1)


def block_distribution(df: DataFrame, codes: Column, n: int = 3, by: Sequence[str] = (), top: int | None = None) -> DataFrame:
    c = class_counts(df, F.transform(codes, lambda x: F.substring(x, 1, n)), by).withColumnRenamed("code", "block")
    w = Window.partitionBy(*by)
    out = c.withColumns({"share": ratio(F.col("n"), F.sum("n").over(w)), "place": F.row_number().over(w.orderBy(F.desc("n"), "block"))})
    return out if top is None else out.where(F.col("place") <= top)


def cardinality_distribution(df: DataFrame, codes: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.size(codes).alias("labels")).agg(F.count(F.lit(1)).alias("n"))


def source_distribution(df: DataFrame, split: str = "split", source: str = "source_id") -> DataFrame:
    return df.groupBy(split, F.coalesce(source, F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def label_stats(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count_if(F.coalesce(label, F.lit("")) != "").alias("non_empty"), F.countDistinct(F.when(F.col(label) != "", F.col(label))).alias("distinct_labels"))


def length_profile(df: DataFrame, text: str, by: Sequence[str], width: int = 500, prefix: str | None = None) -> DataFrame:
    """Histogram of text lengths in bins of `width`; with a prefix, also of the main fields (column `part`)."""
    parts = [F.struct(F.lit("text").alias("part"), F.length(text).alias("len"))]
    if prefix is not None:
        parts.append(F.struct(F.lit("main").alias("part"), F.length(F.coalesce(extract_field(text, prefix), F.col(text))).alias("len")))
    d = df.select(*by, F.explode(F.array(*parts)).alias("x")).select(*by, "x.part", F.coalesce("x.len", F.lit(0)).alias("len"))
    keys = [*by, *(["part"] if prefix is not None else [])]
    return d.groupBy(*keys, (F.floor(F.col("len") / width) * width).cast("long").alias("from_chars")).agg(F.count(F.lit(1)).alias("n"), F.min("len").alias("shortest"), F.max("len").alias("longest"))


def count_summary(counts: DataFrame) -> DataFrame:
    return counts.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.median("n").alias("median"), F.avg("n").alias("mean"))


def imbalance_profile(counts: DataFrame, by: str | None = None, total: str = "overall") -> DataFrame:
    """Distribution of class counts, of each slice and of all rows; quantiles are interpolated, std is the sample's.

    counts: (by, code, n). Classes of all rows are those of the slices added up.
    """
    q = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    if by:
        counts = counts.withColumn(by, F.explode(F.array(F.col(by), F.lit(total)))).groupBy(by, "code").agg(F.sum("n").alias("n"))
    keys = [by] if by else []
    s = counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("classes"), F.sum("n").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 9).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.percentile("n", F.array(*map(F.lit, q))).alias("q"),
        F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") <= 5).alias("upto_5"), F.count_if(F.col("n") <= 10).alias("upto_10"),
    )
    return s.select(*keys, "classes", "rows", "least", "most", "mean", "std", *[F.round(F.col("q")[i], 9).alias(f"p{round(x * 100)}") for i, x in enumerate(q)], "singletons", "upto_5", "upto_10", F.round(F.col("most") / F.col("least"), 9).alias("max_min"), F.round(F.col("most") / F.col("q")[2], 9).alias("max_median"))


def extremes(counts: DataFrame, k: int = 20) -> DataFrame:
    """(end, place, code, n): the k most and the k least common classes, ties by code."""
    top = counts.orderBy(F.desc("n"), "code").limit(k).withColumns({"end": F.lit("top"), "place": F.row_number().over(Window.orderBy(F.desc("n"), "code"))})
    low = counts.orderBy("n", "code").limit(k).withColumns({"end": F.lit("bottom"), "place": F.row_number().over(Window.orderBy("n", "code"))})
    return top.unionByName(low).select("end", "place", "code", "n")  # k rows each


def rank_frequency(counts: DataFrame) -> DataFrame:
    """Classes by count with the cumulative share (one row a class, so one small window)."""
    w = Window.orderBy(F.desc("n"), "code")
    return counts.select("code", "n", F.row_number().over(w).alias("rank"), (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy())).alias("share"))


def classes_needed(ranks: DataFrame, shares: Sequence[float] = (0.5, 0.8, 0.9, 0.95)) -> DataFrame:
    return ranks.agg(*[F.min(F.when(F.col("share") >= s, F.col("rank"))).alias(f"classes_{round(s * 100)}") for s in shares])


def concentration(counts: DataFrame, tops: Sequence[int] = (10, 100, 1000), below: Sequence[int] = (10, 50)) -> DataFrame:
    """Gini coefficient, share of the top classes, classes below counts."""
    r = counts.withColumns({"up": F.row_number().over(Window.orderBy("n", "code")), "down": F.row_number().over(Window.orderBy(F.desc("n"), "code"))})
    n, total = F.count(F.lit(1)), F.sum("n")
    gini = (2 * F.sum(F.col("up") * F.col("n")) / (n * total)) - (n + 1) / n
    return r.agg(n.alias("classes"), total.alias("rows"), F.round(gini, 9).alias("gini"), *[F.round(F.sum(F.when(F.col("down") <= t, F.col("n")).otherwise(0)) / total, 9).alias(f"top_{t}") for t in tops], *[F.count_if(F.col("n") < b).alias(f"below_{b}") for b in below])


def record_coverage(df: DataFrame, codes: str, counts: DataFrame, tops: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Share of records with one of the N most common codes, for each N."""
    ranks = rank_frequency(counts).where(F.col("rank") <= max(tops)).select("code", "rank")
    best = df.select(*by, "record_id", F.explode(codes).alias("code")).join(F.broadcast(ranks), "code", "left").groupBy(*by, "record_id").agg(F.min("rank").alias("best"))  # at most max(tops) rows
    return best.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), *[F.round(F.avg(F.coalesce((F.col("best") <= t).cast("int"), F.lit(0))), 9).alias(f"top_{t}") for t in tops])


def level_concentration(df: DataFrame, codes: Column, levels: dict[str, int]) -> DataFrame:
    """Distinct nodes and the share of the top 1, 5 and 10 at each level."""
    at = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(n).alias("len")) for k, n in levels.items()])
    each = df.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).withColumn("l", F.explode(at))
    nodes = each.groupBy(F.col("l.level").alias("level"), F.substr("code", F.lit(1), F.col("l.len")).alias("node")).agg(F.sum("n").alias("n"))
    r = nodes.withColumn("r", F.row_number().over(Window.partitionBy("level").orderBy(F.desc("n"), "node")))
    return r.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), *[F.round(F.sum(F.when(F.col("r") <= k, F.col("n")).otherwise(0)) / F.sum("n"), 9).alias(f"top_{k}") for k in (1, 5, 10)])


def before_after(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Counts before and after with the difference; missing is 0."""
    b, a = (x.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for x, n in ((before, "before"), (after, "after")))
    return b.join(a, key, "full").na.fill(0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))


def prep_summary(df: DataFrame) -> DataFrame:
    """Rows by provenance: columns synthetic, injected and perturbed are booleans."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(c) for c in ("synthetic", "injected", "perturbed")], F.count_if(~(F.col("synthetic") | F.col("injected"))).alias("real"))


def analytic_upsample(df: DataFrame, label: str, separator: str, floor: int) -> DataFrame:
    """Rows by label count after raising each class to the floor, without making copies."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("labels", F.size(F.split(label, separator)))
    return c.groupBy("labels").agg(F.sum("n").alias("before"), F.sum(F.greatest("n", F.lit(floor))).alias("after"), F.count_if(F.col("n") < floor).alias("classes_below"))


def validate_labels(df: DataFrame, required: Sequence[str], label: str) -> list[str]:
    """Raises for missing columns or no label at all; returns warnings."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    row = label_stats(df, label).first()
    if not row["non_empty"]:
        raise ValueError("no row has a label")
    return ["only one distinct label"] if row["distinct_labels"] == 1 else []
