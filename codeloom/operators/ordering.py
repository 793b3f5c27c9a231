"""Global ranks and running sums without sending all rows to one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


#: Rows (slices and partitions together) that are broadcast; beyond them they are joined.
BASES = 100_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; only a local session without it gets a temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="codeloom-"))
    return context.getCheckpointDir().rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Checkpointed rows, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, for rows that are read often: a reading takes only the columns it needs."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def on_slices(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined with a frame of one row a slice; a null slice meets the null slice. Without slices, right is one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    own = right.withColumnsRenamed({c: f"_on_{c}" for c in by})
    test = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in by])
    return left.join(own, test, how).drop(*[f"_on_{c}" for c in by])


def ranked(df: DataFrame, order: Sequence[Column], sums: dict[str, Column] | None = None, by: Sequence[str] = (), parts: int | None = None, count: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds `rank` (from 1) in the given order, within each combination of `by`, and running sums (as doubles).

    `count` names a column for the rows of the slice; `keep` the columns that stay besides `by` (all without it).

    Rows are range-partitioned by (by, order) and sorted inside the partitions, which is the one time they are
    shuffled; ranks and sums inside a partition are taken as its rows go by, and the last of each slice there (one
    small row for each partition and slice) are added up and joined. The ranges come from a sample, so the
    partitioned rows are checkpointed: both uses see the same ranges, even after executors are lost.
    """
    sums = sums or {}
    by = list(by)
    keys = [F.col(c).asc() for c in by] + list(order)
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumns({f"_v_{k}": v.cast("double") for k, v in sums.items()})
    kept = df.columns if keep is None else list(dict.fromkeys([*by, *keep]))
    values = [f"_v_{k}" for k in sums]
    d = d.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select(*kept, *values, F.spark_partition_id().alias("_part"))
    names = ["rank", *sums]
    schema = T.StructType([*[f for f in d.schema.fields if f.name not in values], T.StructField("_r_rank", T.LongType()), *[T.StructField(f"_r_{k}", T.DoubleType()) for k in sums]])
    inside = settled(d.mapInArrow(_running(by, list(sums), d.columns, schema.names), schema))
    totals = inside.groupBy("_part", *by).agg(F.max("_r_rank").alias("_t_rank"), *[F.max_by(f"_r_{k}", "_r_rank").alias(f"_t_{k}") for k in sums])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("_t_rank").over(Window.partitionBy(*by)).alias("_n")] if count else []
    bases = totals.select("_part", *by, *whole, *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in names])
    bases = settled(bases)
    joined = on_slices(inside, F.broadcast(bases) if bases.count() <= BASES else bases, ["_part", *by])
    return joined.select(*kept, *[(F.col(f"_r_{k}") + F.col(f"_b_{k}")).alias(k) for k in names], *([F.col("_n").alias(count)] if count else []))


def _running(by: list[str], sums: list[str], names: list[str], out_names: list[str]):
    """For sorted rows: the rank and the running sums within each run of equal `by` columns, in place of the sums' values."""
    stay = [i for i, c in enumerate(names) if c in out_names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None
        rank, totals = 0, [0.0] * len(sums)
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            own = [b.column(names.index(c)) for c in by]
            for c in own:
                same = pc.or_kleene(pc.equal(c[1:], c[:-1]), pc.and_(c[1:].is_null(), c[:-1].is_null()))
                new[1:] |= ~same.fill_null(False).to_numpy(zero_copy_only=False)
            first = [c[0].as_py() for c in own]
            new[0] = first != last
            last = [c[-1].as_py() for c in own]
            starts = np.flatnonzero(new)
            at = np.arange(1, b.num_rows + 1, dtype=np.int64)
            begun = np.zeros(b.num_rows, np.int64)
            begun[starts] = starts
            ranks = at - np.maximum.accumulate(begun)
            ranks[: starts[0] if len(starts) else None] += rank
            edges = [0, *starts[starts > 0].tolist(), b.num_rows]
            out = []
            for i, k in enumerate(sums):
                v = b.column(names.index(f"_v_{k}")).fill_null(0.0).to_numpy(zero_copy_only=False).copy()
                if not new[0]:
                    v[0] += totals[i]
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    np.cumsum(v[s:e], out=v[s:e])
                totals[i] = float(v[-1])
                out.append(pa.array(v))
            rank = int(ranks[-1])
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in stay], pa.array(ranks), *out], out_names)

    return run
