"""Baselines that rank codes: most common, TF-IDF, cosine similarity, one-versus-rest; and their evaluation."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codeloom.operators.ordering import settled


def majority_topk(train: DataFrame, codes: str, k: int) -> DataFrame:
    """(place, code, n): the k most common codes, ties by code."""
    top = train.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code").limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "code")))  # k rows


def plain(text: Column) -> Column:
    """Lower-cased text; accented letters of Latin-1 and Latin Extended-A lose their accents."""
    table = {c: d[0] for c in map(chr, range(0xC0, 0x180)) if len(d := unicodedata.normalize("NFKD", c)) > 1 and unicodedata.combining(d[1])}
    return F.lower(F.translate(text, "".join(table), "".join(table.values())))


def terms(text: Column) -> Column:
    """Words of two or more letters or digits of the plain text, and pairs of neighbours."""
    words = F.regexp_extract_all(plain(text), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))
    less = lambda w: F.greatest(F.lit(0), F.size(w) - 1)
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), less(w)), F.slice(w, 2, less(w)), lambda a, b: F.concat_ws(" ", a, b))
    # The array of one binds the words, which would be found again at each use otherwise.
    return F.transform(F.array(words), lambda w: F.concat(w, pairs(w)))[0]


def tfidf(df: DataFrame, id_col: str, text: str, min_df: int = 2, max_features: int | None = None, grams: Column | None = None) -> DataFrame:
    """(id, term, weight): sublinear term frequency, smoothed idf, unit length."""
    each = df.select(id_col, F.explode(grams if grams is not None else terms(F.col(text))).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = df.agg(F.count(F.lit(1)).alias("docs"))
    dfs = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    if max_features:
        dfs = dfs.orderBy(F.desc("total"), "term").limit(max_features)
    idf = dfs.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))  # the count is one row
    raw = each.join(idf, "term").select(id_col, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, id_col).select(id_col, "term", (F.col("w") / F.col("norm")).alias("weight"))


def cosine_topk(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", block: int = 4096, together: int = 16) -> DataFrame:
    """(query_id, place, vec_id, score): the k nearest candidates of each query, which is no candidate of itself.

    Both sides are cut into blocks; query blocks and candidate blocks are dealt to groups of about `together`
    blocks, and each pair of groups meets once, as a cogroup of bounded size: one matrix product for each pair of
    blocks. A query keeps k scores of a group. No group grows with the data. Rows without a vector take no part.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, block):
                ids, m = b.column(0)[i : i + block].to_numpy(), np.array(b.column(1)[i : i + block].to_pylist(), float)
                m = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([m.shape[1]], pa.int32())], ["ids", "matrix", "width"])

    vectors = F.col(vec).cast(T.ArrayType(T.DoubleType()))

    def packed(df: DataFrame) -> DataFrame:
        own = df.where(F.col(vec).isNotNull() & (F.size(vec) > 0))
        return settled(own.select(F.col(id_col).cast("long"), vectors).mapInArrow(pack, "ids binary, matrix binary, width int").withColumn("no", F.monotonically_increasing_id()))

    asked, blocks = packed(queries), packed(candidates)
    groups = [max(1, -(-d.count() // together)) for d in (asked, blocks)]
    own = lambda n, name: F.pmod(F.xxhash64("no"), F.lit(n)).cast("int").alias(name)
    all_of = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = asked.select("*", own(groups[0], "a")).select("*", all_of(groups[1], "b")).groupBy("a", "b")
    right = blocks.select("*", own(groups[1], "b")).select("*", all_of(groups[0], "a")).groupBy("a", "b")

    def score(mine: pa.Table, others: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        rows = [(r["width"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["matrix"], float).reshape(-1, r["width"])) for r in others.to_pylist()]
        for line in mine.to_pylist():
            qi, q = np.frombuffer(line["ids"], np.int64), np.frombuffer(line["matrix"], float).reshape(-1, line["width"])
            best, names = np.zeros((len(qi), 0)), np.zeros((len(qi), 0), np.int64)
            for width, ids, m in rows:
                if width == line["width"]:
                    s = np.where(qi[:, None] == ids[None, :], -np.inf, np.round(q @ m.T, 9))
                    s, own = np.concatenate([best, s], axis=1), np.concatenate([names, np.broadcast_to(ids, s.shape)], axis=1)
                    order = np.lexsort((own, -s), axis=1)[:, :k]
                    best, names = np.take_along_axis(s, order, 1), np.take_along_axis(own, order, 1)
            good = best > -np.inf
            out.append((np.broadcast_to(qi[:, None], best.shape)[good], names[good], best[good]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = left.cogroup(right).applyInArrow(score, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query_id", "place", "vec_id", "score")


def ovr_topk(train: DataFrame, test: DataFrame, codes: Sequence[str], text: str, label: str, id_col: str, k: int, features: int = 1 << 12, **kw) -> DataFrame:
    """(id, place, code, score): linear one-versus-rest scores of a bounded list of codes over TF-IDF terms, all fitted in the same passes."""
    from codeloom.operators import linear

    return linear.topk(test, linear.fit(train, codes, text, label, features, **kw), text, id_col, k)


def retrieval_scores(df: DataFrame, ks: Sequence[int], gold: str = "gold", ranked: str = "ranked") -> DataFrame:
    """Each record once for each k, with its hits, gold and list sizes, coverage and F1 (a record without gold codes is covered)."""
    d = df.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    best = F.array_distinct(F.slice(ranked, F.lit(1), F.col("k")))
    d = d.withColumns({"hits": F.size(F.array_intersect(gold, best)), "g": F.size(F.array_distinct(gold)), "r": F.size(best)})
    return d.withColumns({"cov": F.when(F.col("g") == 0, 1.0).otherwise(F.col("hits") / F.col("g")), "f1": F.when(F.col("g") + F.col("r") == 0, 0.0).otherwise(2 * F.col("hits") / (F.col("g") + F.col("r")))})


def retrieval_eval(df: DataFrame, ks: Sequence[int], gold: str = "gold", ranked: str = "ranked", by: Sequence[str] = ()) -> DataFrame:
    """Mean and median coverage, all-in rate, zero, partial and full shares, micro F1 and mean F1 of records at each k."""
    share = lambda c: F.round(F.avg(c.cast("int")), 9)
    return retrieval_scores(df, ks, gold, ranked).groupBy(*by, "k").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("cov"), 9).alias("coverage"), F.round(F.median("cov"), 9).alias("median_coverage"), share(F.col("hits") == F.col("g")).alias("all_in"),
        share(F.col("cov") == 0).alias("none_in"), share((F.col("cov") > 0) & (F.col("cov") < 1)).alias("partial"), share(F.col("cov") == 1).alias("full"),
        F.round(F.coalesce(F.try_divide(2 * F.sum("hits"), F.sum("g") + F.sum("r")), F.lit(0.0)), 9).alias("micro_f1"), F.round(F.avg("f1"), 9).alias("mean_f1"),
    )


def coverage_by_size(df: DataFrame, ks: Sequence[int], sizes: Sequence[int], gold: str = "gold", ranked: str = "ranked") -> DataFrame:
    """Mean coverage at each k (rows) of the records with each number of gold codes (columns size_n)."""
    d = retrieval_scores(df, ks, gold, ranked)
    return d.groupBy("k").agg(*[F.round(F.avg(F.when(F.col("g") == n, F.col("cov"))), 9).alias(f"size_{n}") for n in sizes])


def recall_at_k(df: DataFrame, ks: Sequence[int], gold: str, ranked: str = "ranked") -> DataFrame:
    d = df.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return d.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg(F.array_contains(F.slice(ranked, F.lit(1), F.col("k")), F.col(gold)).cast("int")).alias("recall"))
