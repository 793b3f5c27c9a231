import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom.sources import storage, store
from codeloom.streaming.incremental import read_log, score_batch, score_stream


def test_two_writers_leave_one_whole_version(spark, tmp_path):
    root, ready, got = str(tmp_path / "s"), threading.Barrier(2), []

    def make(i):
        def frame():
            ready.wait(60)  # both have looked before either has written
            return spark.range(50).select("id", F.lit(i).alias("by"))

        return frame

    def work(i):
        got.append({r.by for r in store.kept(spark, root, "k", make(i), {"seed": 1}).collect()})

    threads = [threading.Thread(target=work, args=(i,)) for i in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert got[0] == got[1] and len(got[0]) == 1
    assert len([n for n in storage.names(spark, f"{root}/key=k") if n.startswith("v-")]) == 1


def test_readers_keep_their_version(spark, tmp_path):
    root = str(tmp_path / "s")
    first = store.kept(spark, root, "k", lambda: spark.range(3).withColumn("split", F.lit("train")), {"seed": 1}, ["train"])
    again = store.kept(spark, root, "k", lambda: spark.range(9).withColumn("split", F.lit("train")), {"seed": 1, "log": "x"}, ["train"], ignore=["log"])
    other = store.kept(spark, root, "k", lambda: spark.range(5).withColumn("split", F.lit("test")), {"seed": 2}, ["test"])
    more = store.kept(spark, root, "k", lambda: spark.range(7).withColumn("split", F.when(F.col("id") > 2, "train").otherwise("test")), {"seed": 1}, ["train", "test"])
    assert (first.count(), again.count(), other.count(), more.count()) == (3, 3, 5, 7)
    assert store.kept(spark, root, "k", lambda: spark.range(0), {"seed": 1}, ["train"]).count() == 7  # the last that fits
    assert len(store.prune(spark, root, "k")) == 2 and more.count() == 7
    assert storage.create(spark, f"{root}/key=k/_commits/00000009", "{half") and not storage.create(spark, f"{root}/key=k/_commits/00000009", "x")
    assert store.kept(spark, root, "k", lambda: spark.range(1), {"seed": 1}, ["test"]).count() == 7


def test_only_changed_sources_are_made_again(spark, tmp_path):
    made = []

    def make(name):
        def frame():
            made.append(name)
            return spark.createDataFrame([(name, len(made))], "s string, n long")

        return frame

    for keys in ({"a": "1", "b": "1"}, {"a": "1", "b": "2"}, {"a": "1", "b": "1"}):
        out = store.kept_by_source(spark, str(tmp_path / "s"), {n: (k, make(n)) for n, k in keys.items()})
    assert made == ["a", "b", "b"] and sorted(map(tuple, out.collect())) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        store.kept_by_source(spark, str(tmp_path / "s"), {})


SCORE = lambda x: x.select("id", F.upper("t").alias("out"))


def test_null_and_repeated_ids_of_a_batch(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "c")], "id long, t string")
    assert [score_batch(d, str(tmp_path / "log"), SCORE, "id") for _ in range(3)] == [2, 0, 0]
    assert score_batch(d.where("id is null"), str(tmp_path / "log"), SCORE, "id") == 0
    assert sorted(map(tuple, read_log(spark, str(tmp_path / "log")).collect())) == [(1, "A"), (2, "C")]
    with pytest.raises(ValueError):
        read_log(spark, str(tmp_path / "none"))


def test_stream_survives_failures_and_two_restarts(spark, tmp_path):
    log, state, source = (str(tmp_path / n) for n in ("log", "state", "in"))
    score_batch(spark.createDataFrame([(0, "batch")], "id long, t string"), log, SCORE, "id")
    calls = Counter()

    def fails_after_writing(x):
        calls["n"] += 1
        if calls["n"] == 1:
            SCORE(x).write.parquet(f"{log}/half")  # the work is done, and then the driver is lost
            raise RuntimeError("lost")
        return SCORE(x)

    def stream(score=SCORE, **kw):
        read = spark.readStream.schema("id long, t string, at timestamp").parquet(source)
        score_stream(read, log, state, score, "id", **kw).awaitTermination()

    rows = lambda ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, t string").withColumn("at", F.current_timestamp())
    rows([0, 1, 1, 2, None]).write.parquet(source)
    with pytest.raises(Exception, match="lost"):
        stream(fails_after_writing)
    stream(fails_after_writing)
    rows([2, 3, 1, 0]).write.mode("append").parquet(source)
    stream()
    stream()
    rows([4, 3, None]).write.mode("append").parquet(source)
    stream()
    assert Counter(r.id for r in read_log(spark, log).collect()) == Counter([0, 1, 2, 3, 4])


def test_stream_with_bounded_state(spark, tmp_path):
    log, source = str(tmp_path / "log"), str(tmp_path / "in")
    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:10:00"), (2, "b", "2024-01-01 00:20:00")], "id long, t string, at string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(source)
    for _ in range(2):
        score_stream(spark.readStream.schema(rows.schema).parquet(source), log, str(tmp_path / "state"), SCORE, "id", event_time="at", delay="1 hour").awaitTermination()
    assert Counter(r.id for r in read_log(spark, log).collect()) == Counter([1, 2])
