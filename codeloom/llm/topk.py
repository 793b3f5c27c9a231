"""Exact top-k inner-product search by distributed histogram selection.

Everything is scored, in blocks: a block of queries against a block of rows is one matrix product. Pass
by pass the scores of each query are counted in BINS bins of the range in which its k-th best score must
lie; the counts of all blocks are summed, the bin of the k-th is found, and the next pass counts within
that bin only. When the range is one score wide, the k-th score is known; a last pass keeps every score
above it, and those equal to it, of which the smallest ids fill the k places.

Scores are whole numbers, so ranges end after ceil(log_BINS(range)) passes. The queries are a stated set.
Query blocks are dealt to groups of about TOGETHER_QUERIES, row blocks to groups of about TOGETHER_ROWS, and
each pair of groups meets once, as a cogroup of bounded size; a query's counts are summed over the row blocks
of the group before they leave the task, so its rows in the shuffle are bins, not blocks. Components travel as the
narrowest integers that hold a block's. Nothing is broadcast.

Ties: by smaller row id. Ties at the k-th score are cut per group (the k smallest ids of a group hold the k
smallest of all), so a huge set of equal vectors gives at most k rows a group and query.

Nulls and odd input: rows whose vector is null, empty, or holds null or non-finite numbers take no part,
neither do rows with a null id. Rows are told apart by their place, not their id: every row of a repeated
id that is asked for is a query with results of its own, and meets the other rows of its id. Rows meet rows
of their own width only. Few rows give fewer than k results; an empty table gives none. Sums up to 2**62 are
exact (large components are multiplied in halves); vectors beyond that have no score in a long, and raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codeloom.llm.common import materialise

BINS = 256
#: Rows and queries of a block.
ROWS, QUERIES = 4096, 512
#: Row blocks and query blocks that meet in one cogroup, on average: the rows travel once for about 100,000 queries.
TOGETHER_ROWS, TOGETHER_QUERIES = 32, 200
_HALF = 1 << 20


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, vec binary, width): floor(scale * x) for each component, as doubles; unfit rows left out."""
    x = F.col(vec_col).cast(T.ArrayType(T.DoubleType()))
    fit = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.floor(scale * b.column(1).flatten().to_numpy(zero_copy_only=False)).astype("<f8")
            width = np.diff(b.column(1).offsets.to_numpy())
            ends = np.cumsum(width)
            vec = [flat[e - w : e].tobytes() for e, w in zip(ends.tolist(), width.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vec, pa.binary()), pa.array(width.astype(np.int32))], ["id", "vec", "width"])

    return vectors.where(fit).select(F.col(id_col).cast("long").alias("id"), x.alias("vec")).mapInArrow(run, "id long, vec binary, width int")


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of at most `size` (key, id, vec, width) rows of one width: a number, keys, ids and the matrix as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in batches:
            widths = b.column(3).to_numpy()
            for w in np.unique(widths).tolist():
                own = b if (widths == w).all() else b.filter(pa.array(widths == w))
                for i in range(0, own.num_rows, size):
                    part = own.slice(i, size)
                    keys, ids = (part.column(c).to_numpy().tobytes() for c in (0, 1))
                    kind, vecs = narrowed(np.frombuffer(b"".join(part.column(2).to_pylist()), "<f8"))
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([w], pa.int32()), pa.array([kind]), *[pa.array([x], pa.binary()) for x in (keys, ids, vecs)]], [name, "width", "kind", "keys", "ids", "vecs"])
                    number += 1

    return rows.mapInArrow(run, f"{name} long, width int, kind string, keys binary, ids binary, vecs binary")


def narrowed(values: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers as bytes of the narrowest type that holds them all, and the type."""
    reach = np.abs(values).max(initial=0)
    kind = next((k for k, most in (("<i1", 2**7), ("<i2", 2**15), ("<i4", 2**31)) if reach < most), "<f8")
    return kind, values.astype(kind).tobytes()


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products, as 64-bit integers, of rows of whole numbers; they must be below 2**62."""
    reach = np.sqrt((a * a).sum(axis=1).max(initial=0)) * np.sqrt((b * b).sum(axis=1).max(initial=0))
    if reach < 1 << 52:
        return (a @ b.T).astype(np.int64)
    (ah, al), (bh, bl) = ((np.floor(x / _HALF), x - np.floor(x / _HALF) * _HALF) for x in (a, b))
    whole = lambda x, y: (x @ y.T).astype(np.int64)
    return whole(ah, bh) * _HALF * _HALF + (whole(ah, bl) + whole(al, bh)) * _HALF + whole(al, bl)


def _matrix(line: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(line["keys"], np.int64), np.frombuffer(line["ids"], np.int64), np.frombuffer(line["vecs"], line["kind"]).reshape(-1, line["width"]).astype("<f8")


def _scored(left: pa.Table, right: pa.Table):
    """For each query block: its line, ids, and (ids, scores, which count) of each row block of its width."""
    rows = [(line["width"], *_matrix(line)) for line in right.to_pylist()]
    for line in left.to_pylist():
        q_keys, q_ids, q = _matrix(line)
        yield line, q_ids, ((r_ids, products(q, r), q_keys[:, None] != r_keys[None, :]) for w, r_keys, r_ids, r in rows if w == line["width"])


def topk(vectors: DataFrame, is_query, k: int, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k best rows of each query row, by integer inner product."""
    spark = vectors.sparkSession
    rows = materialise(quantised(vectors, id_col, vec_col, scale))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norms = [float((v * v).sum()) for v in (np.frombuffer(x, "<f8") for x in b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([max(norms, default=0.0)])], ["norm"])

    norm = rows.select("vec").mapInArrow(reach, "norm double").agg(F.max("norm")).first()[0]
    if norm is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if norm >= 1 << 62:
        raise ValueError("vectors too large for scores in a long")
    bound = int(norm * (1 + 1e-9)) + 2  # no score is beyond it
    keyed = rows.select(F.monotonically_increasing_id().alias("key"), "id", "vec", "width")
    row_blocks = materialise(_blocks(keyed, ROWS, "r"))
    query_blocks = materialise(_blocks(keyed.where(is_query(F.col("id"))), QUERIES, "q"))
    # Groups: enough of them for all cores, and no more in one than fits a task.
    n_rows, n_queries, cores = row_blocks.count(), query_blocks.count(), spark.sparkContext.defaultParallelism
    r_groups = max(1, -(-n_rows // TOGETHER_ROWS))
    q_groups = max(1, -(-n_queries // TOGETHER_QUERIES), min(n_queries, -(-cores // r_groups)))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    dealt_rows = row_blocks.select("*", F.pmod(F.xxhash64("r"), F.lit(r_groups)).cast("int").alias("rg")).select("*", every(q_groups, "qg")).groupBy("qg", "rg")

    def meet(state: DataFrame | None, run, schema: str) -> DataFrame:
        asked = query_blocks if state is None else query_blocks.join(_packed(state), "q")
        dealt = asked.select("*", F.pmod(F.xxhash64("q"), F.lit(q_groups)).cast("int").alias("qg")).select("*", every(r_groups, "rg")).groupBy("qg", "rg")
        return dealt.cogroup(dealt_rows).applyInArrow(run, schema)

    step = 1
    while step * BINS < 2 * bound + 1:
        step *= BINS

    def histogram(step: int, first: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [np.zeros((4, 0), np.int64)]
            for line, q_ids, blocks in _scored(left, right):
                low = np.full(len(q_ids), -bound, np.int64) if first else np.frombuffer(line["low"], np.int64)[: len(q_ids)]
                base = np.arange(len(q_ids))[:, None] * BINS
                n = np.zeros(len(q_ids) * BINS, np.int64)
                for _, s, ok in blocks:
                    at = (s - low[:, None]) // step
                    n += np.bincount((base + at)[ok & (at >= 0) & (at < BINS)], minlength=len(n))
                hot = np.flatnonzero(n)
                out.append(np.stack([np.full(len(hot), line["q"]), hot // BINS, hot % BINS, n[hot]]))
            q, at, bins, n = np.concatenate(out, axis=1)
            return pa.table({"q": q, "at": at.astype(np.int32), "bin": bins.astype(np.int32), "n": n})

        return run

    # state: for each query its range's least score (low) and how many of the k best are in it (need; the
    # rest are above). A query with fewer than k candidates goes on to its least score.
    state = None
    while step >= 1:
        counts = meet(state, histogram(step, state is None), "q long, at int, bin int, n long").groupBy("q", "at", "bin").agg(F.sum("n").alias("n"))
        above = F.coalesce(F.sum("n").over(Window.partitionBy("q", "at").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("above", above).withColumn("least", F.min("bin").over(Window.partitionBy("q", "at")))  # at most BINS rows a query
        if state is None:
            counts = counts.withColumn("low", F.lit(-bound).cast("long")).withColumn("need", F.lit(k).cast("long"))
        else:
            counts = counts.join(state, ["q", "at"])
        inside = (F.col("above") < F.col("need")) & ((F.col("above") + F.col("n") >= F.col("need")) | (F.col("bin") == F.col("least")))
        short = F.col("above") + F.col("n") < F.col("need")
        state = materialise(
            counts.where(inside).select("q", "at", (F.col("low") + F.col("bin").cast("long") * step).alias("low"), F.when(short, F.lit(1 << 40)).otherwise(F.col("need") - F.col("above")).cast("long").alias("need"))
        )
        step //= BINS

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros((5, 0), np.int64)]
        for line, q_ids, blocks in _scored(left, right):
            low = np.frombuffer(line["low"], np.int64)[: len(q_ids)]
            found = [np.zeros((3, 0), np.int64)]
            for r_ids, s, ok in blocks:
                qi, ri = np.nonzero(ok & (s >= low[:, None]))
                found.append(np.stack([qi, r_ids[ri], s[qi, ri]]))
            qi, ids, score = np.concatenate(found, axis=1)
            # Of the scores equal to the k-th, a group gives its k smallest ids.
            order = np.lexsort((ids, -score, qi))
            qi, ids, score = qi[order], ids[order], score[order]
            good = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
            qi, ids, score = qi[good], ids[good], score[good]
            out.append(np.stack([np.full(len(qi), line["q"]), qi, q_ids[qi], ids, score]))
        return pa.table(dict(zip(("q", "at", "query_id", "vec_id", "score"), np.concatenate(out, axis=1), strict=True)))

    kept = meet(state, keep, "q long, at long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q", "at").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packed(state: DataFrame) -> DataFrame:
    """(q, low binary): the lows of a query block's queries in order; one without candidates gets the largest."""

    def run(key, table):
        low = np.full(QUERIES, np.iinfo(np.int64).max // 2, np.int64)
        low[table.column("at").to_numpy()] = table.column("low").to_numpy()
        return pa.table({"q": pa.array([key[0].as_py()]), "low": pa.array([low.tobytes()], pa.binary())})

    return state.groupBy("q").applyInArrow(run, "q long, low binary")


def topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0, 20)


ORACLE = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row <> c.row),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
