"""Filtering stages tell rows apart by id and text, not by id alone."""

from codeloom.llm import decontaminate, language, simhash

PROSE = [" ".join(f"{c}{i}word" for i in range(40)) for c in "abcdefgh"]
SCHEMA = "doc_id long, text string, lang string"


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_language_rejects_rows_not_ids(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(PROSE)] + [(None, "1 2 3", None), (None, PROSE[0] + " x", "en"), (7, "4 5 6", None)], SCHEMA)
    kept = language.keep_known(docs, language.train(docs), 0.3)
    assert rows(kept) == sorted([*enumerate(PROSE), (None, PROSE[0] + " x")], key=str)


def test_decontamination_drops_rows_not_ids(spark):
    items = spark.createDataFrame([(1, PROSE[0]), (2, PROSE[1])], "item_id long, text string")
    docs = spark.createDataFrame([(None, PROSE[0], "en"), (None, PROSE[2], "en"), (5, PROSE[1], "en"), (5, PROSE[3], "en"), (6, None, None)], SCHEMA)
    assert rows(decontaminate.decontaminate(docs, items)) == sorted([(None, PROSE[2]), (5, PROSE[3]), (6, None)], key=str)


def test_near_dedup_keeps_one_row_a_class(spark):
    docs = [
        (1, PROSE[0], "en"), (1, PROSE[0], "en"), (2, PROSE[0], "en"),  # equal rows, then a copy
        (None, PROSE[1], "en"), (None, PROSE[1], "en"), (None, PROSE[1], "de"),  # a class of null ids only
        (None, PROSE[2], "en"), (3, PROSE[2], "en"),  # null ids come last
        (4, PROSE[3], "en"), (4, PROSE[0], "en"),  # one id with two texts: a class's only row, and a copy
    ]
    want = sorted([(1, PROSE[0]), (None, PROSE[1]), (3, PROSE[2]), (4, PROSE[3])], key=str)
    one = simhash.keep_first(spark.createDataFrame(docs, SCHEMA).repartition(3))
    two = simhash.keep_first(spark.createDataFrame(docs[::-1], SCHEMA).coalesce(1))
    assert rows(one) == rows(two) == want
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)
