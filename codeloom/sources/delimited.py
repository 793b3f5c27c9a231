"""Delimited text with quoted separators and line breaks, read in ranges of whole files.

A range of a file can begin inside a quoted field, and only what is before it tells. So a first scan works out of each
range where it ends (inside quotes or not) for both ways it may begin; these are chained in file order (a row a range),
and then each range is parsed from its true state. Records are those of Python's csv reader (doubled quotes, quotes
within unquoted fields, lines that end in any usual way); the csv module parses the lines where they are read. What a
range holds of a record that began in an earlier one is brought together by the number of the range where it began.

Rows are numbered from the ranges' counts, so that later scans know their numbers without a shuffle. Three scans in
all: state and counts, for files in which a record crosses ranges the counts again, and the rows. The ranges' states,
34 bytes each, are broadcast; a file set has as many ranges as the scan has tasks, or fewer.

Defined results: blank lines aren't records; empty fields are null; a quote that is never closed runs to the end of
its file; bytes that aren't of the encoding become replacement characters; a file without lines has no records.
"""

from __future__ import annotations

import csv
import io
import itertools
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.operators.ordering import settled

_END = "\0end\0"


def lines_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, range, line): lines as bytes with their file and the start of the byte range that they were read in."""
    read = spark.read.option("lineSep", "\n").text(paths)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("line"))


def _broken(line: bytes, encoding: str) -> list[str]:
    """A line with its end; at carriage returns inside it, several."""
    text = line.decode(encoding, "replace") + "\n"
    if "\r" not in text or text.find("\r") == len(text) - 2:
        return [text]
    parts = text.split("\r")
    own = [p + "\r" for p in parts[:-1]]
    return [*own[:-1], own[-1] + "\n"] if parts[-1] == "\n" else [*own, parts[-1]]


class Records:
    """(fields, lines) of each record of some lines; `pending` has the lines of one that isn't closed at the end."""

    def __init__(self, lines: Iterable[str], sep: str, inside: bool = False):
        csv.field_size_limit(sys.maxsize)
        self.lines, self.sep, self.inside = lines, sep, inside
        self.pending: list[str] = []
        self.ended = self.open = False

    def _feed(self) -> Iterator[str]:
        inside = self.inside
        for line in self.lines:
            self.pending.append(line)
            yield '"' + line if inside else line
            inside = False
        self.ended = True
        yield _END

    def __iter__(self) -> Iterator[tuple[list[str], list[str]]]:
        for row in csv.reader(self._feed(), delimiter=self.sep):
            if self.ended:
                self.open = bool(self.pending)
                return
            taken, self.pending = self.pending, []
            yield row, taken


def blank(lines: list[str]) -> bool:
    return len(lines) == 1 and not lines[0].strip(" \t\r\n")


def _ends(lines: list[str], sep: str) -> tuple[set[int], bool]:
    """Where records end (as numbers of lines) that begin inside quotes, and whether the last isn't closed."""
    r, at, out = Records(lines, sep, inside=True), 0, set()
    for _, taken in r:
        at += len(taken)
        out.add(at)
    return out, r.open


@dataclass
class _Shape:
    sep: str
    encoding: str
    header: bool
    width: int

    def ranges(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
        """Each (file, range) of the batches with its lines; the first line of a file loses its byte order mark."""
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for key, own in itertools.groupby(rows, key=lambda r: r[:-1]):
            lines = (t for r in own for t in _broken(r[-1], self.encoding))
            if key[-1] == 0:
                lines = (t.removeprefix("﻿") if i == 0 else t for i, t in enumerate(lines))
            yield key, lines

    def kept(self, records: Iterable[tuple[list[str], list[str]]], first: bool) -> Iterator[list[str]]:
        """The fields of the records that count: not blank, not the header, not wider than it."""
        skip = self.header and first
        for row, taken in records:
            if not blank(taken):
                if not skip and len(row) <= self.width:
                    yield row
                skip = False

    def scan(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each range: whether it ends inside quotes, if it begins outside (end0) or inside (end1), and its rows, if outside."""
        for (file, h, start), lines in self.ranges(batches):
            held: list[str] = []  # from the first quote on, until both ways end a record at the same place
            quoted, agreed, at, edges, tried = False, False, 0, set(), 0

            def watched(lines=lines):
                nonlocal quoted
                for t in lines:
                    quoted = quoted or '"' in t
                    if quoted and not agreed:
                        held.append(t)
                    yield t

            def counted(records):
                nonlocal at, agreed, tried
                for row, taken in records:
                    if held and not agreed:
                        at += len(taken) if at else len(held)
                        edges.add(at)
                        if len(edges) > 2 * tried:
                            tried = len(edges)
                            agreed = bool(edges & _ends(held, self.sep)[0])
                            if agreed:
                                held.clear()
                    yield row, taken

            records = Records(watched(), self.sep)
            rows = sum(1 for _ in self.kept(counted(records), start == 0))
            end1 = records.open if agreed else _ends(held, self.sep)[1] if quoted else True
            last = records.open and any(True for _ in self.kept([(next(csv.reader(iter(records.pending), delimiter=self.sep)), records.pending)], False))
            yield pa.RecordBatch.from_pylist([{"file": file, "h": h, "start": start, "end0": records.open, "end1": end1, "rows": rows, "last": last}])


def _key(h: int, start: int) -> int:
    """One signed 64-bit number for a file's hash and the start of a range."""
    return ((h * 0x9E3779B97F4A7C15 + start) & (1 << 64) - 1) - (1 << 63)


@dataclass
class _Ranges:
    """What is known of each range, in the order of the keys: whether it begins inside quotes, whether what is open at its
    end is its file's last record, the number of its first row, and its place in file order."""

    key: np.ndarray
    inside: np.ndarray
    final: np.ndarray
    base: np.ndarray
    place: np.ndarray

    def __call__(self, h: int, start: int) -> int:
        at = int(np.searchsorted(self.key, _key(h, start)))
        if at == len(self.key) or self.key[at] != _key(h, start):
            raise ValueError("the files' ranges have changed since they were looked at; read them again")
        return at


def header_of(spark: SparkSession, file: str, sep: str, encoding: str) -> list[str]:
    """Fields of the first record of a file."""
    n = 16
    while True:
        lines = [t for r in spark.read.option("lineSep", "\n").text(file).select(F.col("value").cast("binary")).limit(n).collect() for t in _broken(bytes(r[0]), encoding)]
        if lines:
            lines[0] = lines[0].removeprefix("﻿")
        records = Records(lines, sep)
        row = next((row for row, taken in records if not blank(taken)), None)
        if row is not None or len(lines) < n:
            return row or []
        n *= 4


def column_names(header: list[str]) -> list[str]:
    """Names for the fields: those that are empty or occur twice get their position."""
    lower = [x.strip().lower() for x in header]
    return [f"_c{i}" if not low else f"{x}{i}" if lower.count(low) > 1 else x for i, (x, low) in enumerate(zip(header, lower, strict=True))]


def read(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", header: bool = True, number: str = "_row") -> DataFrame:
    """All columns as strings and the rows' numbers in file order (files by name), from 0 after the header.

    Records that are wider than the first of the first file are left out, shorter ones filled with nulls.
    """
    if len(sep) != 1 or encoding.upper().replace("-", "").startswith(("UTF16", "UTF32")):
        raise ValueError("a separator is one character, and an encoding one in which line ends are single bytes")
    files = sorted(spark.read.text(path).inputFiles())
    fields = header_of(spark, files[0], sep, encoding) if files else []
    names = column_names(fields) if header else [f"_c{i}" for i in range(len(fields))]
    shape = _Shape(sep, encoding, header, len(names))
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in names], T.StructField(number, T.LongType())])
    if not names:
        return spark.createDataFrame([], schema)
    lines = lines_of(spark, path).withColumn("h", F.xxhash64("file"))
    ranges = sorted(lines.select("file", "h", "range", "line").mapInArrow(shape.scan, "file string, h long, start long, end0 boolean, end1 boolean, rows long, last boolean").collect())  # a row a range
    inside, final, crossed, state = np.zeros(len(ranges), bool), np.zeros(len(ranges), bool), set(), False
    for i, r in enumerate(ranges):
        inside[i] = state
        if state:
            crossed.add(r["file"])
        state = r["end1"] if state else r["end0"]
        if i + 1 == len(ranges) or ranges[i + 1]["file"] != r["file"]:
            final[i], state = state, False
    whole = np.array([r["file"] in crossed for r in ranges], bool)
    final &= ~whole  # there, what is open is put together below
    rows = np.array([r["rows"] + (r["last"] and f) for r, f in zip(ranges, final, strict=True)], np.int64)
    keys = np.array([_key(r["h"], r["start"]) for r in ranges], np.int64)
    order = np.argsort(keys)
    known = _Ranges(keys[order], inside[order], final[order], np.zeros(len(ranges), np.int64), np.arange(len(ranges))[order])
    joined = None
    if crossed:
        own = spark.sparkContext.broadcast(known)
        # The test needs the line too: one of file names alone would leave files out of the scan, whose total size sets the ranges.
        size = F.length("line")
        parts = lines.where(size + F.col("file").isin(sorted(crossed)).cast("int") > size).select("h", "range", "line").mapInArrow(lambda b: _pieces(shape, own.value, b), "place long, rows long, head string, tail string")
        parts = settled(parts)  # counts, and what crosses ranges
        owner, begun = [], None
        for r in parts.select("place", "rows", F.col("head").isNotNull().alias("head"), F.col("tail").isNotNull().alias("tail")).orderBy("place").collect():  # a row a range
            rows[r["place"]] = r["rows"]
            if not inside[r["place"]]:
                begun = None  # but for a header that crosses ranges
            if r["head"] and begun is not None:
                owner.append((r["place"], 0, begun))
            if r["tail"]:
                begun = r["place"]
                owner.append((r["place"], 1, begun))
        sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("text")) for k, c in ((0, "head"), (1, "tail"))])).alias("x")
        each = parts.select("place", sides).select("place", "x.*").where("text is not null").join(spark.createDataFrame(owner, "place long, side int, owner long"), ["place", "side"])
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "side", "text"))), lambda x: x["text"]), "")
        crossing = each.groupBy("owner").agg(text.alias("text")).mapInArrow(lambda b: _parsed(shape, b), "owner long, fields array<string>")
        joined = settled(crossing)
        for r in joined.where("fields is not null").select("owner").collect():
            rows[r["owner"]] += 1
    base = np.cumsum(rows) - rows
    known.base = base[order]
    shared = spark.sparkContext.broadcast(known)  # 34 bytes a range
    out = lines.select("h", "range", "line").mapInArrow(lambda b: _frames(shape, shared.value, schema.names, b), schema)
    if joined is None:
        return out
    at = spark.createDataFrame([(i, int(base[i] + rows[i] - 1)) for i in sorted({o for _, _, o in owner})], "owner long, n long")
    kept = joined.where("fields is not null").join(at, "owner")
    return out.unionByName(kept.select(*[F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(names)], F.col("n").alias(number)))


def _pieces(shape: _Shape, known: _Ranges, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range its rows, the rest of a record that began before it, and what is open at its end."""
    for (h, start), lines in shape.ranges(batches):
        at = known(h, start)
        records = Records(lines, shape.sep, bool(known.inside[at]))
        head: list[str] = []
        named = not shape.header or start > 0

        def own(records=records, head=head, inside=bool(known.inside[at])):
            nonlocal named
            for i, (row, taken) in enumerate(records):
                if i == 0 and inside:
                    head.append("".join(taken))
                else:
                    named = named or not blank(taken)
                    yield row, taken

        rows = sum(1 for _ in shape.kept(own(), start == 0))
        through = bool(known.inside[at]) and not head  # inside one field all the time
        rest = "".join(records.pending)
        yield pa.RecordBatch.from_pydict(
            {"place": pa.array([int(known.place[at])]), "rows": pa.array([rows]), "head": pa.array([rest if through else head[0] if head else None], pa.string()), "tail": pa.array([rest if records.open and not through and named else None], pa.string())}
        )


def _values(row: list[str], width: int) -> list[str | None]:
    return [x or None for x in row] + [None] * (width - len(row))


def _parsed(shape: _Shape, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fields of records that were put together; null for one that is too wide."""
    for b in batches:
        csv.field_size_limit(sys.maxsize)
        rows = [next(csv.reader(io.StringIO(t, newline=""), delimiter=shape.sep)) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_values(r, shape.width) if len(r) <= shape.width else None for r in rows], pa.list_(pa.string()))], ["owner", "fields"])


def _frames(shape: _Shape, known: _Ranges, names: list[str], batches: Iterator[pa.RecordBatch], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """The rows of each range and their numbers."""
    for (h, start), lines in shape.ranges(batches):
        at = known(h, start)
        inside = bool(known.inside[at])
        records = Records(lines, shape.sep, inside)

        def own(records=records, inside=inside, final=bool(known.final[at])):
            yield from itertools.islice(records, 1 if inside else 0, None)
            if records.open and final:
                yield next(csv.reader(iter(records.pending), delimiter=shape.sep)), records.pending

        number = int(known.base[at])
        rows = (_values(r, shape.width) for r in shape.kept(own(), start == 0))
        while some := list(itertools.islice(rows, size)):
            columns = [pa.array(c, pa.string()) for c in zip(*some, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(range(number, number + len(some)), pa.int64())], names)
            number += len(some)
