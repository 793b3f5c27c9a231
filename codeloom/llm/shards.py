"""Balanced contiguous shards from global byte-size prefix sums.

Rows are range-partitioned by id, text hash, size and place in the input, so that many rows of one id (or none)
are several partitions, and sorted within partitions. Each partition's total size (one small row
a partition) gives it a base; base plus the running sum inside the partition is the row's global prefix.
The line of all bytes is cut at equal targets, and a row belongs to the shard in which its middle byte
falls: shards are contiguous in id order and differ from the target by less than one row at either end.

Nulls and odd input: a null text has no bytes besides the overhead; null ids come first; rows of one id
are ordered by text hash, equal rows in any order (they are alike); with an empty table there are no rows;
columns that the caller names in `carry` come along, others are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import materialise

OVERHEAD = 16


def text_size(text_col: str = "text") -> F.Column:
    """UTF-8 bytes of the text (null: none) plus the overhead of a row."""
    return (F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + OVERHEAD).cast("long")


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row.

    Sizes are taken where the texts are read; texts are not shuffled. `slot` counts a shard's rows from 0
    in id order. Partition totals and the rows that a partition has in each shard are the only things
    that pass through the driver: at most partitions + shards small rows, whatever the input.
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.col(id_col).cast("long").alias("id"),
        text_size(text_col).alias("size"),
        F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
    )

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the partition's number, and rows and bytes before each row in the partition."""
        from pyspark import TaskContext

        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            size = b.column(1).to_numpy()
            before = total + np.cumsum(size) - size
            at = rows + np.arange(len(size))
            rows, total = rows + len(size), total + int(size.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(at), pa.array(before)], ["id", "size", "text_crc32", "part", "at", "before"])

    order = ["id", "text_crc32", "size", "place"]
    ordered = slim.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("place")
    placed = materialise(ordered.mapInArrow(running, "id long, size long, text_crc32 long, part int, at long, before long"))
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).orderBy("part").collect()
    bases, rows, total = [], 0, 0
    for r in totals:
        bases.append((r["part"], rows, total))
        rows, total = rows + r["rows"], total + r["bytes"]
    base = F.broadcast(spark.createDataFrame(bases, "part int, rows_base long, bytes_base long"))  # a row a partition
    middle = 2 * (F.col("bytes_base") + F.col("before")) + F.col("size")  # twice the middle, so whole numbers
    whole = middle.cast("decimal(38,0)") * shards
    shard = F.least(F.lit(shards - 1), F.floor(whole / F.lit(max(1, 2 * total)).cast("decimal(38,0)")).cast("int"))
    out = placed.join(base, "part").select("id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_base") + F.col("at")).alias("row"))
    first = out.groupBy("shard").agg(F.min("row").alias("first"))  # at most `shards` rows
    return out.join(F.broadcast(first), "shard").select("id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents with their shard and slot, one folder a shard, rows in slot order.

    Ids must be unique here; the assignment is joined back on them.
    """
    where = assign_shards(docs, shards, id_col, text_col).select(F.col("id").alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    both = docs.join(where, docs[id_col].cast("long").eqNullSafe(F.col("_id"))).drop("_id")
    both.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)


def shards_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: crc32 by the bit-wise rule (polynomial 0xEDB88320, table worked out in t), the rest by running sums.
ORACLE = """
WITH RECURSIVE bits AS (SELECT i AS i, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
t AS (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS tab FROM bits WHERE k = 8),
b AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, CAST(size AS BIGINT) AS size,
             CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM b, t),
p AS (SELECT *, CAST(sum(size) OVER (ORDER BY doc_id) - size AS BIGINT) AS before, CAST(sum(size) OVER () AS BIGINT) AS total FROM c),
s AS (SELECT *, CAST(least(39, ((2 * before + size) * 40) // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
