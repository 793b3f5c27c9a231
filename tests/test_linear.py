import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codeloom.operators import intervals as V
from codeloom.operators import linear
from codeloom.operators import retrieval as T


def test_all_classes_against_plain_newton(spark):
    rng = random.Random(4)
    topics = {c: [f"{c}{i}" for i in range(6)] for c in "abcde"}
    rows = [(i, " ".join(rng.choices(topics[c], k=5) + rng.choices(topics[rng.choice("abcde")], k=2)), [c] if i % 5 else [c, "e"]) for i, c in enumerate(rng.choices("abcde", k=150))] + [(200, None, ["a"]), (201, "", None), (202, "a1 a2", ["z"])]
    d = spark.createDataFrame(rows, "id long, text string, y array<string>").repartition(4)
    features, l2 = 64, 1e-2
    model = linear.fit(d, list("abcde"), "text", "y", features, l2, passes=200, tolerance=1e-8)
    terms = {r.id: r.t for r in d.select("id", linear._buckets(F.col("text"), features).alias("t")).collect()}
    n = np.array([sum(b in t for t in terms.values()) for b in range(features)])
    assert np.allclose(model.idf, np.log((1 + len(rows)) / (1 + n)) + 1)
    x = np.zeros((len(rows), features))
    for i, r in enumerate(rows):
        np.add.at(x[i], terms[r[0]], 1)
    x *= model.idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    z = np.hstack([x, np.ones((len(rows), 1))])
    ridge = l2 * np.diag([*[1.0] * features, 0.0])
    for k, c in enumerate("abcde"):
        y = np.array([c in (r[2] or []) for r in rows], float)
        w = np.zeros(features + 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(rows) + ridge + 1e-12 * np.eye(features + 1), z.T @ (p - y) / len(rows) + ridge @ w)
        assert np.allclose(model.weights[k], w[:-1], atol=1e-4) and abs(model.bias[k] - w[-1]) < 1e-3
    got = linear.topk(d, model, "text", "id", 2).collect()
    scores = x @ model.weights.T + model.bias
    for r in got:
        i = next(i for i, q in enumerate(rows) if q[0] == r.id)
        assert r.score == np.round(np.sort(scores[i])[::-1][r.place - 1], 6)
    assert len(got) == 2 * len(rows)


def test_empty_frames_and_many_codes(spark):
    d = spark.createDataFrame([(i, f"word{i} common", f"c{i:03d}") for i in range(100)], "id long, text string, y string")
    out = T.ovr_topk(d, d, [f"c{i:03d}" for i in range(100)], "text", "y", "id", 1, 1 << 10, passes=8).collect()
    assert len(out) == 100 and sum(r.code == f"c{r.id:03d}" for r in out) > 90
    assert T.ovr_topk(d.limit(0), d.limit(0), ["a"], "text", "y", "id", 1).count() == 0
    tied = T.ovr_topk(d.limit(0), d.limit(1), ["b", "a"], "text", "y", "id", 2).orderBy("place").collect()
    assert [r.code for r in tied] == ["a", "b"]


def test_dense_blocks_have_unit_rows():
    used, x = linear._dense(pa.array([[3, 3, 1], [], [5]], pa.list_(pa.int32())), np.ones(8))
    assert used.tolist() == [1, 3, 5] and np.allclose(np.linalg.norm(x, axis=1), [1, 0, 1])


def test_intervals_of_micro_and_macro(spark):
    rows = [(g, ["A", "B"] if g % 3 else ["A"], ["A"] if g % 2 else ["B"], "s" if g % 4 else None) for g in range(200)]
    d = spark.createDataFrame(rows, "g long, gold array<string>, pred array<string>, s string")
    out = {(r.s, r.figure): r for r in V.metric_intervals(d, F.col("g"), 60, by=["s"]).collect()}
    assert len(out) == 8
    for r in out.values():
        assert r.low <= r.value <= r.high and r.high - r.low < 0.4 and (r.high > r.low or r.value in (0.0, 1.0))
    own = [(set(g), set(p)) for _, g, p, s in rows if s]
    micro = 2 * sum(len(a & b) for a, b in own) / sum(len(a) + len(b) for a, b in own)
    assert abs(out["s", "micro_f1"].value - micro) < 1e-12
    one = V.metric_intervals(d, F.lit(1), 30).collect()  # a single group: every replicate that draws it has the same figures
    assert all(abs(r.low - r.value) < 1e-12 and abs(r.high - r.value) < 1e-12 for r in one)
    assert V.metric_intervals(d.limit(0), F.col("g"), 5).count() == 0
    table = spark.createDataFrame([("x", "f", 0.9, 0.8, 0.95), ("y", "f", 0.5, 0.4, 0.6), ("z", "f", 0.85, 0.7, 0.9)], "s string, figure string, value double, low double, high double")
    assert {r.s: r["distinct"] for r in V.overlaps(table, "s").collect()} == {"x": False, "y": True, "z": False}


def test_rows_are_dealt_over_the_sessions_tasks(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"word{i % 7} common", f"c{i % 3}") for i in range(60)], "id long, text string, y string").repartition(40)
    parts = []
    settled = linear.settled
    monkeypatch.setattr(linear, "settled", lambda df: parts.append((out := settled(df)).rdd.getNumPartitions()) or out)
    linear.fit(d, ["c0", "c1", "c2"], "text", "y", 64, passes=3)
    assert parts == [spark.sparkContext.defaultParallelism]


def test_words_are_found_once_a_text(spark):
    plan = spark.createDataFrame([("a bc de",)], "text string").select(T.terms(F.col("text")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    got = spark.createDataFrame([("Às ab, cd",), ("ab",), ("",), (None,)], "text string").select(T.terms(F.col("text")).alias("t")).collect()
    assert [r.t for r in got] == [["as", "ab", "cd", "as ab", "ab cd"], ["ab"], [], None]


def test_sparse_and_dense_blocks_agree():
    rng = np.random.default_rng(2)
    row, bucket, count = linear._counted(pa.array([[3, 3, 1], [], [5, 7, 5], [0]], pa.list_(pa.int32())), 8)
    assert list(zip(row.tolist(), bucket.tolist(), count.tolist(), strict=True)) == [(0, 1, 1), (0, 3, 2), (2, 5, 2), (2, 7, 1), (3, 0, 1)]
    idf, w, shares = rng.random(8) + 1, rng.random((3, 8)), rng.random((4, 3))
    sparse, dense = linear._Block(row, bucket, count, 4, idf, 0), linear._Block(row, bucket, count, 4, idf)
    assert sparse.sparse and not dense.sparse and np.allclose(sparse.scores(w), dense.scores(w))
    sums = [np.zeros((3, 8)), np.zeros((3, 8))]
    for b, to in zip((sparse, dense), sums, strict=True):
        b.add(shares, to)
    assert np.allclose(*sums) and sums[0].any()


def test_classes_are_done_in_few_passes_of_their_own(spark, monkeypatch):
    rng = random.Random(7)
    names = [f"k{i:02d}" for i in range(24)]
    rows = [(i, " ".join(rng.choices([f"{c}w{j}" for j in range(5)], k=6) + rng.choices([f"common{j}" for j in range(20)], k=6)), c) for i, c in enumerate(rng.choices(names[:-1], [1 / (1 + j) for j in range(23)], k=900))]
    d = spark.createDataFrame(rows, "id long, text string, y string").repartition(3)
    for features, codes, squared in ((64, names, 64), (512, names[:20], 1)):
        asked, widths = [], []
        summed, labelled = linear._summed, linear._labelled
        monkeypatch.setattr(linear, "_summed", lambda *a, f=summed, to=asked: to.append(len(a[1])) or f(*a))
        monkeypatch.setattr(linear, "_labelled", lambda *a, f=labelled, to=widths: to.append(len((out := f(*a))[3])) or out)
        model = linear.fit(d, codes, "text", "y", features, 1e-2, passes=20)
        monkeypatch.undo()
        assert widths == [squared]  # covariances where they cost no more than a quarter of the passes, else variances
        terms = {r.id: r.t for r in d.select("id", linear._buckets(F.col("text"), features).alias("t")).collect()}
        x = np.zeros((len(rows), features))
        for i in range(len(rows)):
            np.add.at(x[i], terms[i], 1)
        x *= model.idf
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = np.array([[r[2] == c for c in codes] for r in rows], float)
        p = 1 / (1 + np.exp(-(x @ model.weights.T + model.bias)))
        g = np.hstack([(p - y).T @ x / len(rows) + 1e-2 * model.weights, (p - y).mean(axis=0)[:, None]])
        held = y.any(axis=0)
        first = np.abs(np.outer(y.mean(axis=0), x.mean(axis=0)) - y.T @ x / len(rows)).max(axis=1)
        assert (np.abs(g).max(axis=1)[held] <= np.minimum(2e-6, 2 * linear.SHARE * first[held])).all()
        assert held.sum() == 20 + 3 * (features == 64) and len(asked) <= 20 and asked[0] == len(codes) and sum(asked) < 10 * len(codes), asked
        assert np.isfinite(model.weights).all() and (model.bias[~held] < -5).all()


def test_packed_rows_are_blocks(spark):
    d = spark.createDataFrame([([i % 7, i % 5, 3] if i % 4 else [], [i % 3] if i % 2 else None) for i in range(2500)], "terms array<int>, ys array<int>").coalesce(1)
    blocks = linear._packed(d.withColumn("ys", F.coalesce("ys", F.array().cast("array<int>"))), 8).toArrow().to_batches()
    got = [x for x in linear._parts(iter(blocks), 100)]
    assert sum(b.num_rows for b in blocks) == 3 and max(x[0] for x in got) == 100
    i = 0
    for n, row, bucket, count, of, y in got:
        for r in range(n):
            own = [i % 7, i % 5, 3] if i % 4 else []
            assert {(b, own.count(b)) for b in own} == set(zip(bucket[row == r].tolist(), count[row == r].tolist(), strict=True))
            assert y[of == r].tolist() == ([i % 3] if i % 2 else [])
            i += 1
    assert i == 2500
