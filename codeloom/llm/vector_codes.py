"""Product codes of vectors by ball k-means.

Components become whole numbers, vectors are cut into parts, and each part position has a codebook whose entries
start as that part of the vectors of least ids. A round assigns every part to the nearest entry (ties to the lower
index) and replaces each entry by the floor of its parts' mean.

The first assignment is one matrix product a part and batch. Each later one starts from the entry that a part had:
an entry and its parts are a ball, whose radius is the distance of its farthest part. Only entries within twice the
radius are neighbours; a part nearer to its entry than half the way to the nearest neighbour is in the stable core
and needs no work; one between half the way to the m-th and the next neighbour is in the m-th ring and is compared
with m neighbours. A neighbour at exactly twice the distance may tie, so it counts. All distances are exact integers.

Balls are those of an Arrow batch, so radii are smaller and nothing is gathered. A round reads the vectors with
their codes, sums them in the tasks (a row an entry), and writes them with new codes; nothing but those sums, and
the label totals of `label_errors`, is shuffled. The driver holds the codebooks: entries times width integers.

Nulls and odd input: rows whose vector is null, empty, or holds null or non-finite numbers are left out, and so are
rows of another width than the first row (by id) whose width is a multiple of `parts`. Null ids sort last, equal ids
by their vectors; repeated rows are kept. Fewer rows than entries give a smaller codebook, an empty table gives none.
Components so large that a squared distance isn't a long raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import discard, materialise, shared_dir, text_view

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Pairs of a part and an entry that are worked through together.
_PAIRS = 1 << 18


def _fits(x: Column, parts: int) -> Column:
    return x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def _whole(flat: np.ndarray, width: int, scale: int) -> np.ndarray:
    out = np.floor(scale * flat)
    if len(out) and np.abs(out).max() >= min(2.0**31, (2.0**61 / width) ** 0.5):
        raise ValueError("components too large for squared distances in a long")
    return out.astype("<i4")


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry of each row, by one matrix product; ties to the lower index."""
    reach = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    kind = np.float64 if 4 * x.shape[1] * float(reach) ** 2 < 2**52 else np.int64  # exact either way
    x, book = x.astype(kind), book.astype(kind)
    return ((book * book).sum(axis=1) - 2 * (x @ book.T)).argmin(axis=1)


class Balls:
    """Entries of one part position and, for each, the others by distance."""

    def __init__(self, book: np.ndarray):
        self.book = book.astype(np.int64)
        apart = ((self.book[:, None] - self.book[None]) ** 2).sum(axis=2)
        np.fill_diagonal(apart, -1)
        self.near = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.near, axis=1)

    def distances(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        return ((x - self.book[code]) ** 2).sum(axis=1)

    def reassign(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The nearest entries, from the entries that the rows had."""
        d = self.distances(x, code)
        order = np.argsort(code, kind="stable")
        edges = np.searchsorted(code[order], np.arange(len(self.book) + 1))
        ring = np.zeros(len(x), np.int64)
        for e in range(len(self.book)):
            ball = order[edges[e] : edges[e + 1]]
            if len(ball):
                radius = d[ball].max()
                neighbours = np.searchsorted(self.apart[e], 4 * radius, "right")
                if neighbours:
                    ring[ball] = np.searchsorted(self.apart[e, :neighbours], 4 * d[ball], "right")
        out = code.copy()
        moving = np.flatnonzero(ring)  # outside the stable cores
        ends = np.cumsum(ring[moving])
        i = 0
        while i < len(moving):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _PAIRS, "right")))
            own, m = moving[i:j], ring[moving[i:j]]
            starts = np.cumsum(m) - m
            row = np.repeat(np.arange(len(own)), m)
            entry = self.near[code[own][row], np.arange(len(row)) - starts[row]]
            apart = ((x[own][row] - self.book[entry]) ** 2).sum(axis=1)
            best = np.minimum.reduceat(apart, starts)
            first = np.minimum.reduceat(np.where(apart == best[row], entry, len(self.book)), starts)
            better = (best < d[own]) | ((best == d[own]) & (first < code[own]))
            out[own[better]] = first[better]
            i = j
        return out


def _vectors(column: pa.Array, parts: int, width: int) -> np.ndarray:
    raw, _ = text_view(column)
    return np.ascontiguousarray(raw).view("<i4").reshape(-1, parts, width // parts).astype(np.int64)


def _binary(values: np.ndarray) -> pa.Array:
    """Each row of an array as bytes."""
    size = values[0].nbytes if len(values) else 0
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer((np.arange(len(values) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _updated(coded: DataFrame, book: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of its parts' mean, sums by task first; unused entries stay."""
    parts, entries, dim = book.shape
    names = [f"s{i}" for i in range(dim)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((dim, parts * entries), np.int64)
        for b in batches:
            x = _vectors(b.column(0), parts, parts * dim)
            slot = (text_view(b.column(1))[0].reshape(-1, parts) + entries * np.arange(parts)).ravel()
            n += np.bincount(slot, minlength=len(n))
            for i in range(dim):
                np.add.at(sums[i], slot, x[:, :, i].ravel())
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), *[pa.array(s[at]) for s in sums]], ["slot", "n", *names])

    each = coded.select("vec", "code").mapInArrow(run, ", ".join(["slot int", "n long", *[f"{c} long" for c in names]]))
    total = each.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names])
    out = book.copy()
    for r in total.collect():  # a row an entry
        out[r["slot"] // entries, r["slot"] % entries] = [int(r[c]) // r["n"] for c in names]
    return out


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code binary, error long) of the rows that take part, in a table of its own, and the codebooks
    (part, entry, component). `entries` is at most 256: a code has a byte a part."""
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = vectors.sparkSession
    x = F.col(vec_col).cast(T.ArrayType(T.DoubleType()))
    label = F.lit(None).cast("string") if label_col is None else F.col(label_col)
    rows = vectors.where(_fits(x, parts)).select(F.col(id_col).cast("long").alias("id"), label.alias("label"), x.alias("vec"))
    order = [F.col("id").asc_nulls_last(), F.col("vec").asc()]
    seeds = rows.select("id", "vec").orderBy(*order).limit(entries).collect()
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", rows.schema["label"].dataType), T.StructField("vec", T.BinaryType()), T.StructField("code", T.BinaryType())])
    done = T.StructType([*schema.fields[:2], schema.fields[3], T.StructField("error", T.LongType())])
    if not seeds:
        return spark.createDataFrame([], done), np.zeros((parts, 0, 0), np.int64)
    width = len(seeds[0]["vec"])
    rows = rows.where(F.size("vec") == width)
    if any(len(r["vec"]) != width for r in seeds):
        seeds = rows.select("id", "vec").orderBy(*order).limit(entries).collect()
    book = _whole(np.array([r["vec"] for r in seeds]).ravel(), width, scale).reshape(len(seeds), parts, -1).transpose(1, 0, 2).astype(np.int64)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            v = _whole(b.column(2).flatten().to_numpy(zero_copy_only=False), width, scale).reshape(b.num_rows, parts, width // parts)
            code = np.stack([nearest(v[:, p], own[p]) for p in range(parts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _binary(v), _binary(code)], schema.names)

    def again(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            balls = [Balls(b) for b in shared.value]
            for b in batches:
                v, code = _vectors(b.column(2), parts, width), text_view(b.column(3))[0].reshape(-1, parts).astype(np.int64)
                code = np.stack([balls[p].reassign(v[:, p], code[:, p]) for p in range(parts)], axis=1) if len(v) else code
                if last:
                    error = sum(balls[p].distances(v[:, p], code[:, p]) for p in range(parts))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _binary(code.astype(np.uint8)), pa.array(error)], done.names)
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _binary(code.astype(np.uint8))], schema.names)

        return run

    shared = spark.sparkContext.broadcast(book)  # entries times width integers
    place = shared_dir(spark)
    coded = materialise(rows.mapInArrow(first, schema), place)
    for k in range(rounds):
        book = _updated(coded, book)
        shared = spark.sparkContext.broadcast(book)
        last = k == rounds - 1
        before, place = place, shared_dir(spark)
        coded = materialise(coded.mapInArrow(again(last), done if last else schema), place)
        discard(spark, before)
    return (coded if rounds else materialise(coded.mapInArrow(again(True), done))), book


def decode(codes: DataFrame, book: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(id, vec array<double>): the entries that the codes name, in the vectors' own scale."""
    parts, _, dim = book.shape
    shared = codes.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = text_view(b.column(1))[0].reshape(-1, parts)
            flat = shared.value[np.arange(parts), code].reshape(-1) / scale
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array((np.arange(b.num_rows + 1) * parts * dim).astype(np.int32)), pa.array(flat))], ["id", "vec"])

    return codes.select("id", "code").mapInArrow(run, "id long, vec array<double>")


def label_errors(codes: DataFrame) -> DataFrame:
    """The codes with label_error: the errors of all rows of the label, nulls together.

    Totals are summed in the tasks first; the join splits a label that holds much of the table as Spark's adaptive
    execution does, or broadcasts the totals if they are small.
    """
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return codes.join(totals, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def vector_codes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    codes, book = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label_col="label")
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return label_errors(codes).select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql_round(k: int) -> str:
    """Assignment k and the codebook after it."""
    return f"""a{k} AS MATERIALIZED (SELECT r, part, min(64 * CAST(xx + cc - 2 * list_dot_product(p.x, b.x) AS BIGINT) + entry) AS best
  FROM p JOIN (SELECT *, list_dot_product(x, x) AS cc FROM b{k}) b USING (part) GROUP BY r, part),
s{k} AS (SELECT part, best % 64 AS entry, i, CAST(sum(CAST(x[i] AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM p JOIN a{k} USING (r, part), (SELECT unnest(range(1, 1 + d)) AS i FROM w) GROUP BY part, best % 64, i),
m{k} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS x FROM s{k} GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, entry)),
"""


#: Parts as lists of whole doubles; a least of 64 * distance + entry gives the nearest entry, ties to the lower.
ORACLE = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT max(len(e)) // 16 AS d FROM v),
p AS MATERIALIZED (SELECT r, part, e[part * d + 1:(part + 1) * d] AS x, list_dot_product(e[part * d + 1:(part + 1) * d], e[part * d + 1:(part + 1) * d]) AS xx FROM v, w, (SELECT unnest(range(16)) AS part)),
b0 AS (SELECT part, r AS entry, x FROM p WHERE r < 64),
{_sql_round(0)}{_sql_round(1)}a2 AS (SELECT r, part, min(64 * CAST(xx + cc - 2 * list_dot_product(p.x, b.x) AS BIGINT) + entry) AS best FROM p JOIN (SELECT *, list_dot_product(x, x) AS cc FROM b2) b USING (part) GROUP BY r, part),
c AS (SELECT r, string_agg(lpad(lower(to_hex(best % 64)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (r), h
"""
