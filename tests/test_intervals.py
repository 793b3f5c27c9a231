"""Intervals of the risk-coverage area against the curve of the rows as drawn."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators import intervals as V


def weight(group, r, seed=333):
    """Poisson(1) by inversion of the keyed draw."""
    u, edge = int(hashlib.md5(f"{seed}:{group}:{r}".encode()).hexdigest()[:8], 16) / 2**32, 0.0
    for n in range(9):
        edge += math.exp(-1) / math.factorial(n)
        if u < edge:
            return n
    return 9


def area(hits):
    n = len(hits)
    risk = 1 - np.cumsum(hits) / np.arange(1, n + 1)
    return round(float(((risk[1:] + risk[:-1]) / 2).sum() / n), 9) if n else None


def plain(rows, replicates):
    """{slice: (value, low, high)} of rows of (id, slice, group, score, hit)."""
    out = {}
    for s in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == s and r[3] is not None and r[4] is not None), key=lambda r: (-r[3], r[0]))
        if not own:
            continue
        each = []
        for k in range(replicates + 1):
            each.append(area([r[4] for r in own for _ in range(weight(r[2] if r[2] is not None else "", k) if k else 1)]))
        drawn = [v for v in each[1:] if v is not None]
        out[s] = (each[0], *(float(np.percentile(drawn, q)) if drawn else None for q in (2.5, 97.5)))
    return out


SCHEMA = "id long, slice string, g string, score double, hit double"


@pytest.mark.parametrize("parts", [1, 7])
def test_intervals_of_the_area_against_rows_as_drawn(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["x", "y", "z", None, "w"]), rng.choice([None, 0.5, 0.25, rng.random()]), rng.choice([0.0, 1.0, 0.5, None])) for i in range(400)]
    rows += [(1000, "one", "x", 0.1, 1.0), (1001, "none", "x", None, 1.0)]
    rows += [(i, "hot", "x", 0.5, float(i % 3 == 0)) for i in range(2000, 2600)]  # one group, one score
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["slice"]: (r["value"], r["low"], r["high"]) for r in V.aurc_intervals(spark.createDataFrame(rows, SCHEMA), "score", "hit", "id", F.col("g"), 20, by=["slice"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = plain(rows, 20)
    assert set(got) == set(want) == {"a", "b", None, "one", "hot"}
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=2e-9), s


def test_intervals_without_slices_or_rows(spark):
    rows = [(i, None, str(i), float(i % 7), float(i % 2)) for i in range(50)]
    (got,) = V.aurc_intervals(spark.createDataFrame(rows, SCHEMA), "score", "hit", "id", F.col("g"), 10).collect()
    assert tuple(got) == pytest.approx(plain(rows, 10)[None], abs=2e-9)
    assert V.aurc_intervals(spark.createDataFrame([], SCHEMA), "score", "hit", "id", F.col("g"), 10).collect() == [(None, None, None)]
    assert V.aurc_intervals(spark.createDataFrame([], SCHEMA), "score", "hit", "id", F.col("g"), 10, by=["slice"]).collect() == []


def test_weights_are_drawn_once_a_group(spark):
    import pyarrow as pa

    groups = [["x", "", "y"][i % 3] for i in range(3000)]
    own, weights = V._weights(pa.array(groups), 40, 333)
    assert weights.shape == (3, 41) and [list(weights[i]) for i in own[:3]] == [[1, *(weight(g, r) for r in range(1, 41))] for g in groups[:3]]
    d = spark.createDataFrame([(i, "s", g, float(i), 1.0) for i, g in enumerate(groups)], SCHEMA)
    plan = V.aurc_intervals(d, "score", "hit", "id", F.col("g"), 40, by=["slice"])._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "posexplode" not in plan
