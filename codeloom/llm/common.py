"""What the training-data operators share: shared storage, Arrow text views, word arrays, hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Arrow batches are worked through in runs of whole documents of about so many bytes.
RUN_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is missing, a local session (tests) gets a temporary checkpoint folder; others raise.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="codeloom-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/codeloom-{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. Survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a materialised table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def row_key(id_col: str, text_col: str) -> tuple:
    """Two columns that tell rows apart by id and whole text (equal rows get equal keys)."""
    return (
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("key_a"),
        F.xxhash64(F.lit(7), F.length(F.col(text_col)), F.col(text_col), F.col(id_col)).alias("key_b"),
    )


def without_rows(docs: DataFrame, id_col: str, text_col: str, gone: DataFrame) -> DataFrame:
    """The documents whose row_key isn't in `gone`; their columns may have any names."""
    keys = ["key_a", "key_b"]
    left = docs.select(F.struct("*").alias("doc"), *row_key(id_col, text_col))
    return left.join(gone.select(*keys).distinct(), keys, "left_anti").select("doc.*")


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once: named inside a lambda, an expression is worked out for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, op, block: int = 256) -> Column:
    """op of all non-negative integers before each place of an array (0 before the first); op is a sum or a maximum.

    Worked out in blocks, then over the blocks' totals, so the work doesn't grow with the square of the array.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    before = lambda a: F.aggregate(a, start, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def in_blocks(v: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))
        return bound(F.transform(cuts, lambda i: before(F.slice(v, i * block + 1, F.lit(block)))), joined)

    def joined(parts: Column) -> Column:
        bases = before(F.transform(parts, lambda x: x["at"]))["out"]
        return F.flatten(F.zip_with(parts, bases, lambda x, base: F.transform(x["out"], lambda v: op(base, v))))

    return bound(values, lambda v: F.when(F.size(v) > block, in_blocks(v)).when(F.size(v) > 0, before(v)["out"]).otherwise(F.array().cast("array<int>")))


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary array, without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string() if pa.types.is_large_string(column.type) else pa.binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES):
    """(first, last) document ranges of about `limit` bytes; a longer document is a run by itself."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def byte_class(word_bytes) -> np.ndarray:
    """A 256-entry table: True for bytes that belong to words."""
    table = np.zeros(256, bool)
    table[list(word_bytes)] = True
    return table


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Byte starts and ends of all words, and the number of words before each document.

    A word is a maximal run of bytes of the class inside one document.
    """
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = table[data]
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] |= inside[1:-1][edges]
    end[edges - 1] |= inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_ODD, _ODD2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        if size <= RUN_BYTES * 2:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _ODD) -> np.ndarray:
    """64-bit hash of values[start:end] for each span: a polynomial from prefix sums, then mixed."""
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + U64(1)) * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hash(word_hash: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the k consecutive words from each position (all positions, unless given), whatever document they are in."""
    if at is None:
        at = np.arange(max(0, len(word_hash) - k + 1))
    return span_hash(word_hash, at, at + k, _ODD2)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w consecutive values."""
    if len(x) < w:
        return x[:0]
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the least of some run of w hashes."""
    low = sliding_min(grams, w)
    if not len(low):
        return np.zeros(0, np.int64)
    keep = np.zeros(len(grams), bool)
    for k in range(w):
        keep[k : k + len(low)] |= grams[k : k + len(low)] == low
    return np.flatnonzero(keep)


SPACE = (0x20, 9, 10, 11, 12, 13)
#: Bytes of `[^\x20\x09-\x0D]+`.
PLAIN_WORD = byte_class(set(range(256)) - set(SPACE))
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (0-9, a-z and everything beyond ASCII).
ALNUM_WORD = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Bytes with A-Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
