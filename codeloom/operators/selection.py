"""Rows by their place in a hash order, without sorting: histograms of the hash find the edges, then a filter picks.

The rows of a stratum are counted by the first hexadecimal digits of their hash; the bin that holds the asked place is
counted again by more digits until few rows are left in it, whose hashes give the edge itself. Counts are summed before
they are shuffled, and rows are only filtered: they stay where they are. Only rows that share an edge's hash (repeated
ids) are ranked among themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators.ordering import on_slices, ranked, settled

#: Digits of a step, the rows of a bin that are few, and the strata whose edges are broadcast (beyond them they are joined).
DIGITS, FEW, STRATA = 4, 50_000, 100_000
LENGTH = 32


def _placed(counts: DataFrame, by: Sequence[str], bin_col: str, before: Column) -> DataFrame:
    """The bin of each stratum in which the wanted place lies; `_below` counts the rows of the bins before."""
    upto = Window.partitionBy(*by).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0)  # at most 16 ** DIGITS or FEW rows a stratum
    cum = counts.withColumn("_below", before + F.sum("_c").over(upto) - F.col("_c"))
    return cum.where((F.col("_below") < F.col("_want")) & (F.col("_want") <= F.col("_below") + F.col("_c")))


def edges(d: DataFrame, want: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, _edge, _below, _ties, _want): for each stratum of d, with its hash in `_h`, the hash at the wanted place.

    `want` may use `_n`, the stratum's rows; a place beyond them is the last, and none is given for 0 or less.
    """
    every = Window.partitionBy(*by)
    counts = d.groupBy(*by, F.substr("_h", F.lit(1), F.lit(DIGITS)).alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_n", F.sum("_c").over(every)).withColumn("_want", F.least(want.cast("long"), F.col("_n")))
    at = settled(_placed(counts, by, "_bin", F.lit(0)).select(*by, "_bin", "_below", "_c", "_want"))
    digits = DIGITS
    near = lambda: on_slices(d, bounded(at), by).where(F.substr("_h", F.lit(1), F.lit(digits)) == F.col("_bin"))
    while digits < LENGTH and (at.agg(F.max("_c")).first()[0] or 0) > FEW:
        counts = near().groupBy(*by, "_below", "_want", F.substr("_h", F.lit(1), F.lit(digits + DIGITS)).alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
        at = settled(_placed(counts, by, "_bin", F.col("_below")).select(*by, "_bin", "_below", "_c", "_want"))
        digits += DIGITS
    counts = near().groupBy(*by, "_below", "_want", F.col("_h").alias("_edge")).agg(F.count(F.lit(1)).alias("_c"))
    return settled(_placed(counts, by, "_edge", F.col("_below")).select(*by, "_edge", "_below", F.col("_c").alias("_ties"), "_want"))


def bounded(table: DataFrame) -> DataFrame:
    """A settled table of a row a stratum, broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= STRATA else table


def between(df: DataFrame, key: Column, high: Column, low: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The rows with low < place <= high in the order of their hashes (32 hexadecimal digits), within each stratum.

    high and low may use `_n`, the stratum's rows. Null strata are strata. Rows of equal hashes come in the order of a hash
    of all their columns.
    """
    d = df.withColumn("_h", key)
    asked = [c for c in (high, low) if c is not None]
    tables = [edges(d.select(*by, "_h"), c, by) for c in asked]
    ties = any((t.agg(F.max("_ties")).first()[0] or 0) > 1 for t in tables)
    both = d
    for name, t in zip(("hi", "lo"), tables, strict=False):
        own = t.withColumnsRenamed({f"_{c}": f"_{c}_{name}" for c in ("edge", "below", "ties", "want")})
        if by:
            both = on_slices(both, bounded(own), by, "left")
        else:
            row = own.first()  # the only one
            both = both.withColumns({c: F.lit(row[c] if row else None).cast(own.schema[c].dataType) for c in own.columns})
    keep = F.coalesce(F.col("_h") <= F.col("_edge_hi"), F.lit(False))
    if low is not None:
        keep = keep & F.coalesce(F.col("_h") > F.col("_edge_lo"), F.lit(True))
    if not ties:
        return both.where(keep).select(*df.columns)
    at = [F.coalesce(F.col("_h") == F.col(f"_edge_{n}"), F.lit(False)) for n in ("hi", "lo")[: len(asked)]]
    edge = reduce(lambda a, b: a | b, at)
    tied = ranked(both.where(edge).withColumn("_all", F.xxhash64(*df.columns)).withColumn("_id", F.monotonically_increasing_id()), [F.col("_all").asc(), F.col("_id").asc()], by=[*by, "_h"])
    place = lambda n: F.col(f"_below_{n}") + F.col("rank")
    good = F.when(at[0], place("hi") <= F.col("_want_hi")).otherwise(True)
    if low is not None:
        good = good & F.when(at[1], place("lo") > F.col("_want_lo")).otherwise(True) & (at[0] | keep | at[1])
    return both.where(keep & ~edge).select(*df.columns).unionByName(tied.where(good).select(*df.columns))
