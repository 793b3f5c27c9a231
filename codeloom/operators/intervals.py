"""Confidence intervals of any figure of sums, by a cluster bootstrap over sufficient statistics.

Rows are first summed by group (all that a figure needs of them), then each group is weighted by Poisson(1) draws, one
for each replicate, and the weighted sums give the figure again. So rows are shuffled once, and only groups are
multiplied by the number of replicates, in the tasks that then sum them. Groups (records of one text, say) are drawn
whole; draws are keyed by group and replicate, so a group of several slices or classes has one weight.

Figures: any expression over the sums, such as micro F1 from tp, gold and pred; with `classes`, over the sums of one
class, averaged over the classes (macro F1). Groups of null are one group; a figure without a value (nothing drawn) is
left out of the interval; no rows give no figures.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codeloom.operators.metrics import exploded, record_scores, same_set
from codeloom.operators.ordering import on_slices, settled
from codeloom.operators.splits import poisson_weight


def _figures(sums: DataFrame, by: Sequence[str], figures: Mapping[str, Column], classes: str | None) -> DataFrame:
    """(by, figures) from rows of sums, which with classes are one for each class."""
    if classes is None:
        return sums.select(*by, *[v.cast("double").alias(k) for k, v in figures.items()])
    return sums.groupBy(*by).agg(*[F.avg(v.cast("double")).alias(k) for k, v in figures.items()])


def intervals(df: DataFrame, group: Column, sums: Mapping[str, Column], figures: Mapping[str, Column], replicates: int = 40, level: float = 0.95, by: Sequence[str] = (), classes: str | None = None, seed: int = 333) -> DataFrame:
    """(by, figure, value, low, high): each figure and the ends of its interval (percentiles of the replicates).

    sums: names and values of what is summed over rows; figures: names and expressions over those sums.
    """
    keys = [*by, *([classes] if classes else [])]
    key = F.coalesce(group.cast("string"), F.lit(""))
    stats = df.groupBy(*keys, key.alias("_g"), group.isNull().alias("_null")).agg(*[F.sum(v.cast("double")).alias(k) for k, v in sums.items()])
    numbers = F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("_r")  # replicate 0 is the rows as they are
    weight = F.when(F.col("_r") == 0, 1).otherwise(poisson_weight(F.col("_g"), F.col("_r"), seed))
    each = stats.select(*keys, "_g", *sums, numbers).withColumn("_w", weight).where("_w > 0")
    drawn = each.groupBy(*keys, "_r").agg(*[F.sum(F.col("_w") * F.col(k)).alias(k) for k in sums])
    values = _figures(drawn, [*by, "_r"], figures, classes)
    long = values.select(*by, "_r", F.explode(F.array(*[F.struct(F.lit(k).alias("figure"), F.col(k).alias("v")) for k in figures])).alias("x")).select(*by, "_r", "x.*")
    tail = (1 - level) / 2
    ends = [F.percentile(F.when(F.col("_r") > 0, F.col("v")), F.lit(q)).alias(n) for n, q in (("low", tail), ("high", 1 - tail))]
    return long.groupBy(*by, "figure").agg(F.max(F.when(F.col("_r") == 0, F.col("v"))).alias("value"), *ends)  # replicates + 1 rows a slice and figure


def metric_intervals(df: DataFrame, group: Column, replicates: int = 40, level: float = 0.95, by: Sequence[str] = (), seed: int = 333) -> DataFrame:
    """(by, figure, value, low, high) of accuracy and of micro, sample and macro F1, for rows of gold and pred codes."""
    d = record_scores(df.withColumn("_group", group)).withColumn("_hit", same_set(df).cast("int"))
    over = lambda a, b: F.try_divide(a, b)
    sums = {"tp": F.col("_tp"), "g": F.col("_g"), "p": F.col("_p"), "hits": F.col("_hit"), "f": F.col("f1"), "n": F.lit(1)}
    whole = {"accuracy": over(F.col("hits"), F.col("n")), "micro_f1": over(2 * F.col("tp"), F.col("g") + F.col("p")), "sample_f1": over(F.col("f"), F.col("n"))}
    one = intervals(d.drop("n"), F.col("_group"), sums, whole, replicates, level, by, seed=seed)
    codes = exploded(df.withColumn("_group", group), ["_group", *by])
    each = {"tp": F.col("is_gold") * F.col("is_pred"), "g": F.col("is_gold"), "p": F.col("is_pred")}
    macro = {"macro_f1": over(2 * F.col("tp"), F.col("g") + F.col("p"))}
    return one.unionByName(intervals(codes, F.col("_group"), each, macro, replicates, level, by, classes="code", seed=seed))


def overlaps(table: DataFrame, slices: str) -> DataFrame:
    """Adds `distinct`: whether a slice's interval lies wholly apart from that of the best slice of its figure."""
    best = table.groupBy("figure").agg(F.max_by("low", "value").alias("_low"), F.max("value").alias("_value"))  # a row a figure
    out = on_slices(table, best, ["figure"])
    return out.withColumn("distinct", (F.col("high") < F.col("_low")) & (F.col("value") < F.col("_value"))).drop("_low", "_value").select(slices, *[c for c in table.columns if c != slices], "distinct")


#: Upper edges of the Poisson(1) weights 0 to 8, as in splits.poisson_weight.
_EDGES = list(itertools.accumulate(math.exp(-1) / math.factorial(n) for n in range(9)))


def _weights(groups: pa.Array | pa.ChunkedArray, replicates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's group, groups x replicates + 1 weights): splits.poisson_weight once a group; replicate 0 is the rows as they are."""
    coded = (groups.combine_chunks() if isinstance(groups, pa.ChunkedArray) else groups).dictionary_encode()
    names = coded.dictionary.to_pylist()
    draws = np.array([int(hashlib.md5(f"{seed}:{g}:{r}".encode()).hexdigest()[:8], 16) for g in names for r in range(1, replicates + 1)], np.float64) / (1 << 32)
    drawn = np.searchsorted(_EDGES, draws, side="right").reshape(len(names), replicates)
    return coded.indices.to_numpy(), np.concatenate([np.ones((len(names), 1), np.int64), drawn], axis=1)


def _totals(by: Sequence[str], replicates: int, seed: int, names: Sequence[str]):
    """Of each batch: rows drawn and hits of each replicate, by part and slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = replicates + 1
        for b in batches:
            t = pa.Table.from_batches([b]).append_column("_at", pa.array(np.arange(b.num_rows)))
            at = t.group_by(["_part", *by]).aggregate([("_at", "list")])
            for k in range(at.num_rows):
                rows = t.take(at.column("_at_list")[k].values)
                own, weights = _weights(rows.column("_g"), replicates, seed)
                count, hits = np.bincount(own, minlength=len(weights)), np.bincount(own, rows.column("_hit").to_numpy(), len(weights))
                keys = [pa.concat_arrays([at.column(c).combine_chunks().slice(k, 1)] * n) for c in ("_part", *by)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(n, dtype=np.int32)), pa.array(count @ weights), pa.array(hits @ weights)], names)

    return run


def _sorted_areas(by: Sequence[str], replicates: int, seed: int):
    """For one slice's rows of one range: the risks added up, the first risk and the rows drawn, of each replicate."""

    def run(rows: pa.Table, before: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_score", "descending"), ("_id", "ascending")])
        n = replicates + 1
        own, weights = _weights(rows.column("_g"), replicates, seed)
        hit = rows.column("_hit").to_numpy()
        drawn0, hits0 = np.zeros(n), np.zeros(n)
        at = before.column("_r").to_numpy()
        drawn0[at], hits0[at] = before.column("_drawn").to_numpy(), before.column("_hits").to_numpy()
        risks, first, drawn, hits = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
        for r in range(n):  # a row that is drawn w times has w ranks, one after the other
            again = np.repeat(hit, weights[own, r])
            if len(again):
                risk = 1 - (hits0[r] + np.cumsum(again)) / (drawn0[r] + np.arange(1, len(again) + 1))
                risks[r], first[r] = risk.sum(), risk[0] if drawn0[r] == 0 else 0.0
                drawn[r], hits[r] = len(again), again.sum()
        keys = {c: pa.concat_arrays([rows.column(c).combine_chunks().slice(0, 1)] * n) for c in by}
        return pa.table({**keys, "_r": pa.array(np.arange(n, dtype=np.int32)), "_risks": risks, "_first": first, "_drawn": drawn, "_hits": hits})

    return run


def aurc_intervals(df: DataFrame, score: str, correct: str, id_col: str, group: Column, replicates: int = 40, level: float = 0.95, by: Sequence[str] = (), seed: int = 333) -> DataFrame:
    """(by, value, low, high): the area under the risk-coverage curve and the ends of its interval.

    A figure of the order of the rows, so sums by group don't do. Rows (score, correct, id and group; the weights of
    the groups are worked out where rows are met) are range-partitioned by slice and score; what each range draws and hits is added up over the
    ranges before it, and each range then adds up its own risks, replicate by replicate. No row is multiplied in a
    shuffle, and no task holds more than one range.

    Rows without a score or figure are left out; ties go by id; null slices and null groups are slices and groups;
    a replicate that draws no row has no area; no rows give no rows (without slices, one row of nulls).
    """
    keys = list(by)
    key = F.coalesce(group.cast("string"), F.lit(""))
    slim = df.select(*keys, F.col(score).cast("double").alias("_score"), F.col(correct).cast("double").alias("_hit"), F.col(id_col).alias("_id"), key.alias("_g"))
    slim = slim.where("_score IS NOT NULL AND _hit IS NOT NULL")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*[F.col(c).asc() for c in keys], F.col("_score").desc(), F.col("_id").asc()]
    placed = settled(slim.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    drawn = T.StructType([T.StructField("_part", T.IntegerType()), *df.select(*keys).schema.fields, T.StructField("_r", T.IntegerType()), T.StructField("_n", T.LongType()), T.StructField("_h", T.DoubleType())])
    each = placed.select("_part", *keys, "_g", "_hit").mapInArrow(_totals(keys, replicates, seed, drawn.names), drawn)
    totals = each.groupBy("_part", *keys, "_r").agg(F.sum("_n").alias("_n"), F.sum("_h").alias("_h"))
    earlier = Window.partitionBy(*keys, "_r").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = totals.select("_part", *keys, "_r", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("double").alias("_drawn"), F.coalesce(F.sum("_h").over(earlier), F.lit(0.0)).alias("_hits"))
    fields = [*df.select(*keys).schema.fields, T.StructField("_r", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("_risks", "_first")], T.StructField("_drawn", T.LongType()), T.StructField("_hits", T.DoubleType())]
    areas = placed.groupBy("_part", *keys).cogroup(before.groupBy("_part", *keys)).applyInArrow(_sorted_areas(keys, replicates, seed), T.StructType(fields))
    n = F.sum("_drawn")
    ends = (F.sum("_first") + 1 - F.sum("_hits") / n) / 2
    area = areas.groupBy(*keys, "_r").agg(F.when(n > 0, F.round((F.sum("_risks") - ends) / n, 9)).alias("_v"))
    tail = (1 - level) / 2
    limits = [F.percentile(F.when(F.col("_r") > 0, F.col("_v")), F.lit(q)).alias(c) for c, q in (("low", tail), ("high", 1 - tail))]
    return area.groupBy(*keys).agg(F.max(F.when(F.col("_r") == 0, F.col("_v"))).alias("value"), *limits)  # replicates + 1 rows a slice
