import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import scalars as S
from codeloom.sources import delimited
from codeloom.sources import files as I


def plain(text, sep):
    """Python's csv reader: blank lines left out, wider records than the first dropped, empty fields null."""
    lines, out, width = [], [], None

    def feed():
        for line in io.StringIO(text, newline=""):
            lines.append(line)
            yield line

    for row in csv.reader(feed(), delimiter=sep):
        own, lines[:] = list(lines), []
        if len(own) == 1 and not own[0].strip(" \t\r\n"):
            continue
        if width is None:
            width = len(row)
        elif len(row) <= width:
            out.append([x or None for x in row] + [None] * (width - len(row)))
    return out


def made_up(rng, sep, eol):
    def field():
        kind = rng.random()
        if kind < 0.35:
            return "".join(rng.choice("abcé 12") for _ in range(rng.randrange(8)))
        if kind < 0.8:
            return '"' + "".join(rng.choice(["a", "b", sep, "\n", "\r\n", '""', "\\", "é", "x" * rng.choice([1, 1, 300])]) for _ in range(rng.randrange(8))) + '"'
        return rng.choice(['5" pipe', 'a"b"', '"a"b', '"q\\"', ""])

    text = "h1" + sep + "h2" + sep + '"h ""3"""' + eol
    for _ in range(120):
        text += sep.join(field() for _ in range(rng.choice([3, 3, 3, 2, 1, 4]))) + eol + eol * (rng.random() < 0.05)
    return text


@pytest.fixture
def ranges(spark):
    """Sets the bytes of a range."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed,sep,eol,size", [(1, ";", "\n", 150), (2, ",", "\r\n", 400), (3, "\t", "\n", 2000)])
def test_ranges_against_the_csv_module(spark, tmp_path, ranges, seed, sep, eol, size):
    text = made_up(random.Random(seed), sep, eol)
    (tmp_path / "a.csv").write_text(text, encoding="utf-8", newline="")
    ranges(size)
    assert delimited.lines_of(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions() > 2
    rows = [list(r) for r in delimited.read(spark, str(tmp_path / "a.csv"), sep).orderBy("_row").collect()]
    assert [r[:-1] for r in rows] == plain(text, sep) and [r[-1] for r in rows] == list(range(len(rows)))


def test_files_one_after_the_other_long_fields_and_odd_ends(spark, tmp_path, ranges):
    d = tmp_path / "many"
    d.mkdir()
    long = "x;\n" * 350_000
    (d / "a.csv").write_text(f'﻿t;c\n"one\n\ntwo";A\n"{long}";B\n', encoding="utf-8")
    (d / "b.csv").write_text('t;c\nlast;C\n"he said ""hi"" there";D\n"ends \\";E\nbroken;"never closed\nF', encoding="utf-8")
    (d / "c.csv").write_text("t;c\n", encoding="utf-8")
    (d / "d.csv").write_text("")
    ranges(100_000)
    rows = delimited.read(spark, str(d), ";").orderBy("_row").collect()
    assert [(r.t, r.c, r._row) for r in rows] == [("one\n\ntwo", "A", 0), (long, "B", 1), ("last", "C", 2), ('he said "hi" there', "D", 3), ("ends \\", "E", 4), ("broken", "never closed\nF\n", 5)]
    assert delimited.read(spark, str(d / "c.csv"), ";").count() == 0 and delimited.read(spark, str(d / "d.csv"), ";").columns == ["_row"]


def test_ranges_stay_where_few_files_have_records_that_cross(spark, tmp_path, ranges):
    d = tmp_path / "mixed"
    d.mkdir()
    (d / "a.csv").write_text("t;c\n" + "plain;1\n" * 2000)
    quoted = ["q\n" * n + "end" for n in range(60)]
    (d / "b.csv").write_text("t;c\n" + "".join(f'"{q}";2\n' for q in quoted))
    ranges(1 << 27)  # a range is then a share of what is scanned
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.set("spark.sql.files.minPartitionNum", "12")
    try:
        rows = delimited.read(spark, str(d), ";").orderBy("_row").collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)
    assert [(r.t, r.c, r._row) for r in rows] == [(t, c, i) for i, (t, c) in enumerate([*[("plain", "1")] * 2000, *[(q, "2") for q in quoted]])]


def test_encodings_names_and_frames_without_header(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("naïve,,x,X\n1,2,3,4\n".encode("latin-1"))
    assert delimited.read(spark, str(tmp_path / "l.csv"), ",", "ISO-8859-1").columns == ["naïve", "_c1", "x2", "X3", "_row"]
    assert [tuple(r) for r in delimited.read(spark, str(tmp_path / "l.csv"), ",", "ISO-8859-1", header=False).orderBy("_row").collect()] == [("naïve", None, "x", "X", 0), ("1", "2", "3", "4", 1)]
    with pytest.raises(ValueError):
        delimited.read(spark, "x.csv", ";;")
    with pytest.raises(ValueError):
        delimited.read(spark, "x.csv", ";", "UTF-16")


def test_written_values_come_back(spark, tmp_path):
    values = ['a "quoted" one', "line\nbreak, comma", "  spaces  ", "back\\slash", '"', "\r\n", "é", None]
    I.write_by_extension(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "record_id long, text string"), str(tmp_path / "out.csv"))
    back = I.read_scoring_input(spark, str(tmp_path / "out.csv"))
    assert {int(r.record_id): r.text or None for r in back.collect()} == dict(enumerate(values))


def objects(spark, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(S.first_object("t")).collect()]


def test_balanced_objects(spark):
    long = '{"why": "' + "} \\\" { " * 150_000 + '", "of": ' + '{"x": ' * 50 + "1" + "}" * 50 + ', "codes": ["A00.000"]}'
    assert len(long) > 1_000_000
    got = objects(spark, "so " + long + " end", '{"code": "a"} {"code": "b"}', 'x { y {"code": {"d": 1}}', '{"codes": [} {"code": "c"}', "{" * 100_000 + '{"code": 1}', '"{"code": 2}', None, "no", '{"a": {"code": 3}} }', '{"a": "{\\"code\\": 1}"} {"code": 4}')
    assert got == [long, '{"code": "a"}', '{"code": {"d": 1}}', '{"code": "c"}', '{"code": 1}', '{"code": 2}', None, None, '{"a": {"code": 3}}', '{"code": 4}']
    fenced = "```json\n" + '{"why": "' + "x } { " * 180_000 + '", "codes": ["B01.000", " ", "C"]}' + "\n```"
    rows = spark.createDataFrame([(long,), (fenced,), ('{"a": {"code": "q"}}',), (None,)], "t string").select(S.parse_json_answers("t").alias("c")).collect()
    assert [r.c for r in rows] == [["A00.000"], ["B01.000", "C"], [], []]


def test_overrides_set_label_and_codes(spark):
    from codeloom.operators import curate as C

    d = spark.createDataFrame([("s", "1", "A", ["A"]), ("s", "2", "A", ["A"]), ("t", "1", None, [])], "source_id string, record_id string, label string, y_codes array<string>")
    o = spark.createDataFrame([("s", "1", "A", "B,C"), ("t", "1", None, "D")], "source_id string, record_id string, old_label string, new_label string")
    assert {(r.source_id, r.record_id): (r.label, r.y_codes) for r in C.apply_overrides(d, o).collect()} == {("s", "1"): ("B,C", ["B", "C"]), ("s", "2"): ("A", ["A"]), ("t", "1"): ("D", ["D"])}
    assert C.apply_overrides(d.drop("y_codes"), o).columns == ["source_id", "record_id", "label"]


def test_injected_texts_keep_their_words(spark):
    from codeloom.plans.prepare import Plan, prepare_splits

    d = spark.createDataFrame([(f"r{i}", "s", f"text {i}", "A") for i in range(20)], "record_id string, source_id string, text string, label string")
    book = spark.createDataFrame([("b1", "X", "pneumonia of the lung"), ("b2", "Y", "fever")], "record_id string, label string, text string")
    rows = prepare_splits(d, Plan(inject=4, inject_steps=2), codebook=book).where("injected").collect()
    assert len(rows) == 8 and all(r.split == "train" for r in rows)
    for r in rows:
        old = "pneumonia of the lung" if r.label == "X" else "fever"
        assert abs(len(r.text) - len(old)) <= 2 and (r.text == old or r.perturbed) and sum(x != y for x, y in zip(sorted(r.text), sorted(old), strict=False)) <= len(old)
        assert len(set(old) & set(r.text)) >= len(set(old)) - 2
    with pytest.raises(ValueError):
        prepare_splits(d, Plan(inject=4, inject_steps=0), codebook=book)
