import pytest
from pyspark.sql import functions as F

from codeloom.operators import leakage as L
from codeloom.operators import metrics as M
from codeloom.operators import selective as P

SCHEMA = "id long, gold array<string>, pred array<string>"


def frame(spark, *rows):
    return spark.createDataFrame([(i, list(g), list(p)) for i, (g, p) in enumerate(rows)], SCHEMA)


def test_micro_of_one_record(spark):
    r = M.micro(frame(spark, ("ABD", "ABC"))).first()
    assert (r.precision, r.recall, r.f1) == pytest.approx((2 / 3,) * 3)
    assert r.jaccard == 0.5


def test_micro_of_no_rows_is_zero(spark):
    r = M.micro(frame(spark, ("A", "A")).where("id < 0")).first()
    assert (r.precision, r.recall, r.f1, r.jaccard) == (0, 0, 0, 0)


def test_sample_counts_two_empty_sets_as_right(spark):
    r = M.sample(frame(spark, ("AC", "AB"), ("CD", "C"), ("", ""))).first()
    assert tuple(r) == pytest.approx((5 / 6, 2 / 3, 13 / 18, 11 / 18))


def test_hamming_loss_over_a_given_universe(spark):
    r = M.diagnostics(frame(spark, ("AC", "AB"), ("CD", "C")), extra_classes=list("ABCDE")).first()
    assert r.classes == 5 and r.hamming_loss == pytest.approx(0.3)


def test_macro_over_gold_and_predicted_classes(spark):
    r = M.macro(frame(spark, ("A", "A"), ("A", "A"), ("A", "A"), ("B", "A"))).first()
    assert (r.macro_recall, r.macro_precision) == pytest.approx((0.5, 0.375))


def test_hierarchy_levels_in_one_pass(spark):
    d = spark.createDataFrame([(1, ["J18.900"], ["J18.900"]), (2, ["J17.000"], ["J18.500"]), (3, ["A00.000"], ["A00.000"])], SCHEMA)
    acc = {r.level: r.accuracy for r in M.metric_set(M.by_level(d, {"chapter": 1, "block": 3}), ["level"]).collect()}
    assert acc == pytest.approx({"chapter": 1.0, "block": 2 / 3})


def test_two_notions_of_a_match(spark):
    d = frame(spark, ("AB", "BA"))
    assert d.select(M.same_set(d).alias("s"), M.same_string(d).alias("t")).first() == (True, False)


def test_source_transfer_buckets(spark):
    train = spark.createDataFrame([("one", ["A001"]), ("two", ["B001"])], "source_id string, gold array<string>")
    test = spark.createDataFrame([(1, "one", ["A001"]), (2, "one", ["B001"]), (3, "one", ["C001", "A001"])], "id long, source_id string, gold array<string>")
    got = {(r.id, r.code): r.bucket for r in L.transfer_buckets(test, L.label_sources(train), "id").collect()}
    assert got == {(1, "A001"): "same_source", (2, "B001"): "other_source", (3, "C001"): "never", (3, "A001"): "same_source"}


def test_holdout_leakage_rates(spark):
    schema = "text string, y array<string>"
    train = spark.createDataFrame([("a", ["X"]), ("b", ["Y"])], schema)
    hold = spark.createDataFrame([("a", ["X"]), ("c", ["Z"])], schema)
    r = L.holdout_leakage(train, hold, "text", "y").first()
    assert (r.inputs_seen_rate, r.pairs_seen_rate, r.labels_seen_rate, r.classes_seen_rate) == (0.5,) * 4


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_risk_coverage(spark, parts):
    rows = [(i, s, m) for i, (s, m) in enumerate(zip((0.99, 0.05, 0.95, 0.10, 0.90), (1, 0, 1, 0, 1), strict=True))]
    d = spark.createDataFrame(rows, "id long, score double, correct int").repartition(parts)
    got = {r.coverage: (r.n_kept, r.value) for r in P.rc_curve(P.curve(d, "score", "correct", "id"), (0.0, 0.6, 1.0)).collect()}
    assert got == {0.0: (0, None), 0.6: (3, 1.0), 1.0: (5, 0.6)}


def test_temperature_is_recovered(spark):
    import math
    import random

    rng = random.Random(1)
    rows = []
    for _ in range(4000):
        z = rng.uniform(-3, 3)
        rows.append((3 * z, int(rng.random() < 1 / (1 + math.exp(-z)))))
    t = P.fit_temperature_binary(spark.createDataFrame(rows, "s double, c int"), "s", "c")
    assert 2.5 < t < 3.6
    assert P.fit_temperature_tokens(spark.createDataFrame([], "l array<double>, g int"), "l", "g") == (1.0, 0.0, 0.0)


def test_empty_sequences_rank_last(spark):
    d = spark.createDataFrame([(1, [], []), (2, [-0.5, -1.5], [0.2, 0.4])], "id long, lp array<double>, e array<double>")
    got = {r.id: (r.mean_logprob, r.mean_entropy) for r in P.sequence_signals(d, "lp", "e").collect()}
    assert got[1] == (-1e9, 1e9) and got[2] == pytest.approx((-1.0, 0.3))


def test_scrub_prefers_codes_then_cost(spark):
    schema = "id long, line int, codes array<string>, raw string, cost double, turns int, error string"
    log = spark.createDataFrame([(1, 1, [], "", 0.0, 0, "x"), (2, 1, [], "t", 9.0, 1, None), (2, 2, ["A"], "t", 1.0, 1, None), (2, 3, ["B"], "t", 2.0, 1, None)], schema)
    assert [(r.id, r.line) for r in M.scrub(log, "id", "line").collect()] == [(2, 3)]


def test_unknown_mode_raises(spark):
    with pytest.raises(ValueError):
        M.filter_metrics(spark.range(1).withColumn("metric", F.lit("n")), "most")


def test_lines_are_dealt_over_tasks_and_a_log_is_read_once(spark):
    from codeloom.plans.evaluation import _attempts
    from codeloom.plans.views import TASKS, table, view

    sf = "/root/testdata/sf0.001"
    n = TASKS * table(spark, sf, "lineitem").rdd.getNumPartitions()
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert f", {n}), REPARTITION_BY_NUM" in plan(view(spark, sf, "eval_lines"))
    assert "Union" not in plan(_attempts(spark, sf))
