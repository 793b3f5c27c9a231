"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a group-by and an equi-join; every round is written to the shared folder, which cuts the
lineage and lets the run survive lost executors. Rounds grow with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import discard, materialise, shared_dir


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node reachable.

    Null ends are left out; loops and repeated edges do no harm; no edges give no rows. Raises if
    max_rounds is not enough.
    """
    spark = edges.sparkSession
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    held = shared_dir(spark)
    e = materialise(e, held)
    before = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written first: both sides of the join are then plain shuffles, and a node with very many
        # neighbours can be split among tasks.
        lows, after = shared_dir(spark), shared_dir(spark)
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), lows)
        # Large star: each larger neighbour is linked to the least of the neighbourhood.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: each smaller neighbour, and the node itself, is linked to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        e = materialise(small.distinct(), after)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        # The round before is no longer read.
        for path in (lows, held):
            discard(spark, path)
        held = after
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError("components didn't settle")
