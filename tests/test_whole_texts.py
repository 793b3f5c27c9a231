"""The synthesis query merges whole texts, checked against a brute-force merge."""

import random

from pyspark.sql import functions as F

from codeloom.operators import augment as A
from codeloom.plans.registry import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_synthetic_multilabel_merges_whole_texts(spark, tmp_path):
    docs = {i: " ".join(f"w{i}x{j}" for j in range(5 + 40 * (i % 3))) for i in range(24)}
    spark.createDataFrame([(i, t, "en" if i % 2 else "de", f"s{i % 4 // 2}", len(t)) for i, t in docs.items()], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 24, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["synthetic_multilabel"](spark, str(tmp_path)).collect()
    assert len(got) == 12
    for r in got:
        assert r.text == ", ".join(docs[int(i)] for i in r.synthetic_record_ids.split(","))
    assert max(len(docs[int(i)]) for r in got for i in r.synthetic_record_ids.split(",")) > 80


def _shuffled(spark, work) -> int:
    """Bytes that the stages of some work shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, quantiles, None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (found.apply(i) for i in range(found.size()))}

    seen = stages()
    work()
    return sum(v for k, v in stages().items() if k not in seen)


def test_a_draws_longest_text_is_not_shuffled_for_each_draw(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    rows = [(str(i), f"g{i % 2}", f"L{i % 6}", text(60_000) if i < 2 else text(100)) for i in range(400)]  # two long texts, of labels 0 and 1
    rows += [(f"r{i}", f"g{i % 2}", f"rare{i % 2}", text(60_000)) for i in range(2)]
    d = spark.createDataFrame(rows, "record_id string, source_id string, label string, text string").repartition(4).cache()
    d.count()
    got = []
    moved = _shuffled(spark, lambda: got.extend(A.synthesise(d, 300, "label", "record_id", "text").collect()))
    texts = {r[0]: r[3] for r in rows}
    assert len(got) == 300 and all(r.text == ", ".join(texts[i] for i in r.synthetic_record_ids.split(",")) for r in got)
    assert sum("r0" in r.synthetic_record_ids.split(",") or "r1" in r.synthetic_record_ids.split(",") for r in got) > 60
    # Merged: over 60 times 60,000. Moved: the rows once, and a long text once for about 32 draws.
    assert moved < sum(len(r.text) for r in got) / 4


def test_synthesis_can_prepare_texts_below_a_join(spark):
    d = spark.createDataFrame([(str(i), f"g{i % 2}", f"L{i % 5}", None if i % 9 == 0 else f"text é {i}") for i in range(60)], "record_id string, source_id string, label string, text string")
    other = d.select(F.col("record_id").alias("k"), F.col("label").alias("l"))
    seen = []

    def made(change):
        seen.append(change)
        return d.withColumn("text", change(F.col("text"))).join(other, F.col("record_id") == F.col("k")).drop("k", "l")

    bodies = d.select("record_id", "text").unionAll(d.select("record_id", F.lit("another").alias("text")))  # an id's text is told by its hash
    got = [sorted(A.synthesise(*x, 40, "label", "record_id", "text", **kw).collect()) for x, kw in (((d,), {}), ((made,), {}), ((made,), {"texts": bodies}))]
    assert seen and len(got[0]) == 40 and list(map(repr, got[0])) == list(map(repr, got[1])) == list(map(repr, got[2]))
