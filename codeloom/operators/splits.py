"""Leakage-safe splitting and sampling; every draw is an md5 of a keyed string, so results survive repartitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.scalars import keyed_hash, uniform
from codeloom.operators.selection import between


def split_of(draw: Column, sizes: dict[str, float]) -> Column:
    """Name of the split by cumulative thresholds on a draw in [0, 1)."""
    if abs(sum(sizes.values()) - 1) > 1e-9 or sizes.get("train", 0) <= 0:
        raise ValueError("sizes must sum to 1 with some train")
    out, edge = None, 0.0
    for name, size in sizes.items():
        edge += size
        if size > 0:
            test = draw < edge
            out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise([n for n, s in sizes.items() if s > 0][-1])


def random_split(df: DataFrame, id_col: str, sizes: dict[str, float], seed: int = 333) -> DataFrame:
    """Adds `split`. Sizes are expected, not exact."""
    return df.withColumn("split", split_of(uniform(seed, F.col(id_col)), sizes))


def grouped_split(df: DataFrame, group: Column, sizes: dict[str, float], seed: int = 333) -> DataFrame:
    """Adds `split`; rows of one group stay together. Sizes are shares of groups, so shares of rows drift with repeats."""
    return df.withColumn("split", split_of(uniform(seed, group), sizes))


def group_leaks(df: DataFrame, group: Column) -> DataFrame:
    """Groups on both sides of train and the rest."""
    d = df.select(group.alias("group"), (F.col("split") == "train").alias("t"))
    return d.groupBy("group").agg(F.bool_or("t").alias("in_train"), F.bool_or(~F.col("t")).alias("elsewhere")).where("in_train AND elsewhere").select("group")


def assert_no_group_leak(df: DataFrame, group: Column) -> None:
    if bad := group_leaks(df, group).orderBy("group").limit(5).collect():
        raise ValueError(f"groups in train and elsewhere: {[r[0] for r in bad]}")


def sample_fraction(df: DataFrame, id_col: str, fraction: float, seed: int = 333) -> DataFrame:
    """max(1, round(N f)) rows, by hash order (halves round to even). Rows are counted and filtered, never sorted."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    return between(df, keyed_hash(seed, F.col(id_col)), F.greatest(F.lit(1), F.rint(F.col("_n") * fraction)))


def holdout_eval_sample(held: DataFrame, id_col: str, fraction: float | None, seed: int = 333) -> DataFrame:
    """A sample of the held-out rows for frequent evaluation; all of them where none is asked for."""
    return held if fraction is None else sample_fraction(held, id_col, fraction, seed)


def single_label_sample(df: DataFrame, id_col: str, codes: str, fraction: float, seed: int = 333) -> DataFrame:
    """A sample of the rows with exactly one label."""
    return sample_fraction(df.where(F.size(codes) == 1), id_col, fraction, seed)


def stable_batch(df: DataFrame, id_col: str, start: int, n: int, seed: int = 333) -> DataFrame:
    """Rows start .. start+n-1 of a fixed shuffle; batches don't overlap."""
    if start < 0 or n < 1:
        raise ValueError("a batch has a row or more, from 0 on")
    # A start beyond the rows leaves nothing: the last row isn't beyond itself.
    return between(df, keyed_hash(seed, F.col(id_col)), F.lit(start + n), F.lit(start) if start else None)


def ledger(old: DataFrame, batch: DataFrame, id_col: str) -> DataFrame:
    """Used ids; adding a batch again changes nothing."""
    return old.select(id_col).unionByName(batch.select(id_col)).dropDuplicates([id_col])


def stratified_sample(df: DataFrame, strata: str, id_col: str, fraction: float, seed: int = 333) -> DataFrame:
    """round(N f) rows of each stratum (null is one), by hash order; a stratum may be huge."""
    return between(df, keyed_hash(seed, F.col(id_col)), F.rint(F.col("_n") * fraction), by=[strata])


def partition_holdout(df: DataFrame, source: str, col: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """(rest, held out) by exact source; an unknown source or one that takes all raises."""
    have = sorted(r[0] for r in df.groupBy(col).count().collect() if r[0] is not None)
    if source not in have or len(have) == 1:
        raise ValueError(f"can't hold out {source!r}; sources: {have}")
    return df.where(~F.col(col).eqNullSafe(source)), df.where(F.col(col) == source)


def exclude_sources(df: DataFrame, sources: Sequence[str], col: str = "source_id") -> DataFrame:
    have = {r[0] for r in df.groupBy(col).count().collect()}
    if missing := set(sources) - have:
        raise ValueError(f"unknown sources {sorted(missing)}; sources: {sorted(x for x in have if x)}")
    out = df.where(~F.coalesce(F.col(col).isin(*sources), F.lit(False)))
    if have <= set(sources):
        raise ValueError("nothing would be left")
    return out


def source_violations(df: DataFrame, forbidden: Sequence[str], holdout: str | None, col: str = "source_id") -> DataFrame:
    """(split, source, n) that shouldn't be: forbidden or held-out sources outside the holdout, others inside it."""
    outside = ~F.col("split").isin("holdout", "holdout_eval") & F.col(col).isin(*forbidden, *([holdout] if holdout else []))
    inside = F.col("split").isin("holdout", "holdout_eval") & ~F.col(col).eqNullSafe(F.lit(holdout))
    return df.groupBy("split", col).agg(F.count(F.lit(1)).alias("n")).where(outside | inside)


def assert_split_sources(df: DataFrame, forbidden: Sequence[str], holdout: str | None, col: str = "source_id") -> None:
    """Raises for source_violations, and for a held-out source without rows in the holdout."""
    if bad := source_violations(df, forbidden, holdout, col).orderBy("split", col).limit(5).collect():
        raise ValueError(f"sources where they shouldn't be: {[tuple(r) for r in bad]}")
    if holdout is not None and df.where(F.col("split") == "holdout").isEmpty():
        raise ValueError(f"the holdout of {holdout!r} is empty")


def frequent_codes(df: DataFrame, codes: str, k: int, train: Column) -> DataFrame:
    """(code, count): the codes that occur k times or more in train."""
    return df.where(train).select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= k)


def min_frequency(df: DataFrame, id_col: str, codes: str, k: int, train: Column) -> DataFrame:
    """The rows with only those of their codes that are frequent in train, in their order; rows left with none go.

    Lists are known by id and codes together, so rows of one id, or of none, keep their own.
    """
    lists = df.select(F.col(id_col).alias("_id"), F.col(codes).alias("_own")).distinct()
    each = lists.select("_id", "_own", F.posexplode("_own").alias("_at", "code"))
    kept = each.join(frequent_codes(df, codes, k, train).select("code"), "code", "left_semi")
    lists = kept.groupBy("_id", "_own").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "code"))), lambda x: x["code"]).alias("_codes"))
    return df.join(lists, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(codes) == F.col("_own"))).withColumn(codes, F.col("_codes")).drop("_id", "_own", "_codes")


def kfold(group: Column, k: int, seed: int = 333) -> Column:
    """Fold of a group, 0 to k-1."""
    return F.floor(uniform(seed, group) * k).cast("int")


def poisson_weight(group: Column, replicate: Column, seed: int = 333) -> Column:
    """Poisson(1) bootstrap weight of a group in a replicate, by inversion."""
    import math

    u = uniform(seed, group, replicate)
    edge, p, out = 0.0, math.exp(-1), None
    for n in range(9):
        edge += p / math.factorial(n)
        out = F.when(u < edge, n) if out is None else out.when(u < edge, n)
    return out.otherwise(9)


def bootstrap(df: DataFrame, group: Column, value: Column, replicates: int, level: float = 0.95, seed: int = 333) -> DataFrame:
    """(mean, low, high) of a figure with a cluster bootstrap: each replicate weighs whole groups by Poisson(1).

    Rows are summed by group first; only groups are multiplied by the number of replicates.
    """
    groups = df.groupBy(group.alias("_g")).agg(F.sum(value.cast("double")).alias("_s"), F.count(value).alias("_n"))
    each = groups.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", poisson_weight(F.col("_g"), F.col("_r"), seed))
    means = each.groupBy("_r").agg((F.sum(F.col("_w") * F.col("_s")) / F.nullif(F.sum(F.col("_w") * F.col("_n")), F.lit(0))).alias("_m"))  # one row a replicate
    tail = (1 - level) / 2
    ends = means.agg(F.percentile("_m", F.lit(tail)).alias("low"), F.percentile("_m", F.lit(1 - tail)).alias("high"))
    return groups.agg((F.sum("_s") / F.sum("_n")).alias("mean")).crossJoin(ends)  # one row each


def take_by_reference(df: DataFrame, order: DataFrame, id_col: str, line: str, n: int, drop_source: str | None = None, source: str = "source_id") -> DataFrame:
    """n rows: a source left out, first row of each id, ordered by an outside position (missing ones last)."""
    d = df if drop_source is None else df.where(~F.col(source).eqNullSafe(drop_source))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(id_col).orderBy(line))).where("_r = 1").drop("_r")
    return d.join(order.select(id_col, "position"), id_col, "left").orderBy(F.col("position").asc_nulls_last(), id_col).limit(n)


def select_ids(df: DataFrame, ids: Sequence, id_col: str) -> DataFrame:
    """The rows of the asked ids that exist, in the order asked for."""
    kind = df.schema[id_col].dataType.simpleString()
    want = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(ids)], f"{id_col} {kind}, position int")
    return df.join(want, id_col).orderBy("position")
