"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: A-Z lowered, words of `[^\\x20\\x09-\\x0D]+`, 3-word shingles with repeats, XXH64 (seed 42) of
each; a bit is 1 if it is set in over half of them. Fewer words: one shingle of all; none: zero.

Candidates: bit i of the 64 is given a non-zero vector of RADIUS + 1 bits (i mod 7 + 1). Mask v keeps the
bits whose vector has an odd inner product with v. Fingerprints that differ in RADIUS bits or fewer differ
in bits whose vectors lie in a plane, and some v is orthogonal to that plane: under mask v they are equal.
So each pair within the radius meets in one of 2**(RADIUS+1) - 1 tables, and each table compares 36 or 37
bits, of which unrelated fingerprints hardly ever share all.

Links: in a table, two fingerprints of a bucket differ only where the mask is 0, and they are within two
bits exactly if they share a neighbour at one bit or less there. Every fingerprint of a bucket with more
than one names these 28 or 29 neighbours, and the least fingerprint at each is linked with the others.
That costs a fixed number of rows for each fingerprint, however full a bucket is: no pairs are made.

Equal fingerprints are one node from the start, so a group of copies is a single row before any join.

Nulls and odd input: a null or empty text has fingerprint zero, linked like any other; a null id is kept
with its class but is never the class's id; equal rows are kept; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import materialise, row_key, text_view
from codeloom.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
_BIT = np.array([0x80 >> i for i in range(8)], np.uint8)


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of one UTF-8 text."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z and the six white-space bytes only
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        whole = b" ".join(words)
        at = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)  # starts, and the end + 1
        hashes = [digest(whole[a:b], SEED) for a, b in zip(at[: -SHINGLE].tolist(), (at[SHINGLE:] - 1).tolist(), strict=True)]
    bits = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
    n, counts = len(bits), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        counts += np.unpackbits(bits[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple = ()) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer; then `keys` (columns of longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_view(batch.column(1))
            raw = memoryview(data)
            fp = np.array([fingerprint(bytes(raw[a:b])) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], ["id", "fp", *batch.schema.names[2:]])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *keys)
    return source.mapInArrow(run, ", ".join(["id long, fp long", *(f"{c} long" for c in source.columns[2:])]))


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks, each as the bits it keeps."""
    size = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if bin((i % size + 1) & v).count("1") % 2) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp) within two bits, whose paths give all such links' classes.

    Each edge is itself a pair within two bits, and each such pair shares a star of these edges.
    """
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks())])
    rows = prints.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    full = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "key")
    near = rows.join(full, ["t", "key"])
    free = [F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks()]
    flip = F.element_at(F.array(*free), F.col("t") + 1)
    around = near.select("fp", "t", F.explode(F.transform(flip, lambda b: F.col("fp").bitwiseXOR(b))).alias("at"))
    hubs = around.groupBy("t", "at").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a <> top").select("t", "at", "a")
    return around.join(hubs, ["t", "at"]).where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def _rooted(nodes: DataFrame) -> DataFrame:
    """Adds each distinct fingerprint's class, as `root`."""
    roots = components(links(nodes.select("fp")))
    return nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): component is the least id reachable over links of two bits or fewer."""
    prints = materialise(fingerprints(docs, id_col, text_col))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    classes = _rooted(materialise(nodes))
    least = classes.groupBy("root").agg(F.min("least").alias("component"))
    classes = materialise(classes.join(least, "root").select("fp", "component"))
    return prints.join(classes, "fp").select("id", "fp", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class stays: the one with the least id, null ids last.

    Rows with the same id go by hashes of their text, then of all their columns; of wholly equal rows one stays.
    """
    plain = [F.col(f"`{c}`").cast("string") if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes]
    keys = (*row_key(id_col, text_col), F.xxhash64(*plain).alias("key_c"))
    names = ["key_a", "key_b", "key_c"]
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", *names)
    nodes = fingerprints(docs, id_col, text_col, keys).groupBy("fp").agg(F.min(order).alias("first"))
    first = _rooted(materialise(nodes)).groupBy("root").agg(F.min("first").alias("first")).select("first.*").select(*names)
    rows = docs.select(F.struct("*").alias("doc"), *keys).dropDuplicates(names)
    return rows.join(first, names, "left_semi").select("doc.*")


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
