import hashlib

from pyspark.sql import functions as F

from codeloom.operators import selection as Q
from codeloom.operators import selective as P
from codeloom.operators import splits as E


def h(i):
    return hashlib.md5(f"333:{i}".encode()).hexdigest()


def test_places_within_strata_null_strata_and_refined_bins(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 3)
    monkeypatch.setattr(Q, "DIGITS", 1)
    rows = [(i, "abc"[i % 3] if i % 4 else None) for i in range(900)]
    d = spark.createDataFrame(rows, "id long, s string").repartition(5)
    key = E.keyed_hash(333, F.col("id"))
    own = {s: sorted((i for i, x in rows if x == s), key=h) for s in {x for _, x in rows}}
    for low, high in ((0, 7), (10, 25), (40, 10_000), (5000, 6000)):
        got = Q.between(d, key, F.lit(high), F.lit(low) if low else None, ["s"]).collect()
        assert sorted(r.id for r in got) == sorted(i for v in own.values() for i in v[low:high])
    every = sorted((i for i, _ in rows), key=h)
    assert {r.id for r in Q.between(d, key, F.lit(33), F.lit(11)).collect()} == set(every[11:33])
    monkeypatch.setattr(Q, "STRATA", 1)
    assert Q.between(d, key, F.rint(F.col("_n") * 0.5), by=["s"]).count() == sum(round(len(v) * 0.5) for v in own.values())
    assert Q.between(d.limit(0), key, F.lit(3)).count() == 0 and Q.between(d, key, F.lit(0)).count() == 0


def test_repeated_ids_are_told_apart(spark):
    d = spark.createDataFrame([(1, f"x{i}") for i in range(50)] + [(2, "y"), (None, "z"), (None, "z"), (None, "z")], "id long, t string")
    for n in (1, 20, 51, 53):
        assert E.stable_batch(d, "id", 0, n).count() == n
    parts = [{(r.id, r.t) for r in E.stable_batch(d.where("id is not null"), "id", s, 10).collect()} for s in range(0, 51, 10)]
    assert [len(p) for p in parts] == [10, 10, 10, 10, 10, 1] and len(set.union(*parts)) == 51
    assert E.sample_fraction(d, "id", 0.1).count() == 5


def test_rows_are_filtered_where_they_are(spark):
    d = spark.range(2000).select("id", F.lit("wide").alias("w"), (F.col("id") % 3).alias("s"))
    for out in (E.sample_fraction(d, "id", 0.1), E.stratified_sample(d, "s", "id", 0.1), E.stable_batch(d, "id", 100, 50)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_temperatures_of_null_slices_and_repeated_scores(spark):
    rows = [(s, x / 4.0, int(x > 0) if x % 5 else 1 - int(x > 0)) for s in ("a", None) for x in range(-20, 21)] * 3
    d = spark.createDataFrame(rows, "s string, x double, y int")
    found = P.fit_temperatures(d, "x", "y", ["s"])
    assert set(found) == {("a",), (None,)} and abs(found["a",] - found[None,]) < 1e-9
    assert abs(found["a",] - P.fit_temperature_binary(d, "x", "y")) < 1e-6
    import math

    gradient = lambda t: sum((1 / (1 + math.exp(-x / t)) - y) * x for _, x, y in rows)
    assert gradient(found["a",] - 1e-3) * gradient(found["a",] + 1e-3) < 0


def test_ranks_and_sums_across_partitions_slices_and_batches(spark):
    from codeloom.operators import ordering

    rows = [(i, "abc"[i % 7 % 3] if i % 11 else None, i * 37 % 101, float(i % 5) if i % 13 else None) for i in range(700)]
    d = spark.createDataFrame(rows, "id long, s string, k long, v double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
        for parts, few in ((1, 10**6), (6, 10**6), (6, 0)):
            ordering.BASES = few
            for by in ([], ["s"]):
                got = {r.id: (r.rank, r.total) for r in ordering.ranked(d, [F.col("k").desc(), F.col("id").asc()], {"total": F.col("v")}, by, parts).collect()}
                want, seen = {}, {}
                for i, s, _, v in sorted(rows, key=lambda r: (-r[2], r[0])):
                    n, t = seen.get(s if by else 0, (0, 0.0))
                    seen[s if by else 0] = want[i] = (n + 1, t + (v or 0.0))
                assert got == want
    finally:
        ordering.BASES = 100_000
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_curves_of_slices_bring_no_slice_to_one_task(spark):
    d = spark.range(900).select("id", (F.col("id") % 7 / 7).alias("x"), (F.col("id") % 2).alias("y"), F.expr("CASE WHEN id % 3 > 0 THEN id % 3 END").alias("s"))
    for ids in (True, False):
        points = P.curve(d, "x", "y", "id", ["s"], ids=ids)
        assert ("score" in points.columns) is ids and {r[0] for r in points.select("n").distinct().collect()} == {300}
        assert "Exchange hashpartitioning" not in points._jdf.queryExecution().executedPlan().toString()
    assert P.curve(d, "x", "y", "id").agg(F.min("n"), F.max("n"), F.max("rank")).first()[:] == (900, 900, 900)


def test_temperatures_in_few_rounds_of_unequal_scores_and_odd_slices(spark, monkeypatch):
    import math
    import random

    rng, nan = random.Random(5), math.nan
    rows = []
    for s, t in ((1.0, 0.3), (2.0, 7.0), (nan, 30.0), (None, 1.0)):
        for _ in range(600):
            x = rng.gauss(0.5, 3)
            rows.append((s, x, int(rng.random() < 1 / (1 + math.exp(-x / t)))))
    rows += [(8.0, float(x), 0) for x in range(1, 9)] + [(9.0, 0.0, 1)] * 5 + [(7.0, None, 1), (1.0, None, 1), (1.0, 2.0, None)]
    rounds, between = [], P._between
    monkeypatch.setattr(P, "_between", lambda *a: rounds.append(1) or between(*a))
    found = {str(k[0]): t for k, t in P.fit_temperatures(spark.createDataFrame(rows, "s double, x double, y int"), "x", "y", ["s"]).items()}
    assert set(found) == {"1.0", "2.0", "nan", "None", "7.0", "8.0", "9.0"} and len(rounds) <= 5 * 4
    assert found["7.0"] == found["8.0"] == 1.0 and abs(found["9.0"] - 0.05) < 1e-6
    for s in ("1.0", "2.0", "nan", "None"):
        own = [(x, y) for k, x, y in rows if str(k) == s and x is not None and y is not None]
        low, high = 0.05, 50.0
        gradient = lambda t: sum((1 / (1 + math.exp(min(700, -x / t))) - y) * x for x, y in own)  # noqa: B023, E731
        while high - low > 1e-9:
            mid = (low + high) / 2
            low, high = (mid, high) if gradient(0.05) * gradient(mid) > 0 else (low, mid)
        assert abs(found[s] - low) < 1e-6


def test_accepted_shares_by_counts_of_the_ranks(spark):
    d = spark.range(10).select(F.col("id").alias("record_id"), (-F.col("id")).cast("double").alias("x"))
    for share, n in ((0.0, 0), (0.05, 1), (0.35, 3), (1.0, 10), (2, 10)):
        out = P.defer_or_accept(d, "x", coverage=share)
        assert out.columns == ["record_id", "x", "decision"]
        assert sorted(r.record_id for r in out.where("decision = 'accept'").collect()) == list(range(n))
    got = {r.coverage: (r.n_kept, r.value) for r in P.rc_metric(d, "x", "record_id", F.max("record_id"), (0.3, 1.0)).collect()}
    assert got == {0.3: (3, 2), 1.0: (10, 9)}
