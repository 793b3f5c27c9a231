"""Runs of periodic words in whole texts, by internal pattern matching.

A run is a stretch of words with smallest period q that is `times` periods and `least` words long or longer and
can't be extended by a word with the same period. A run of period p, 2**k <= p < 2**(k+1), holds a block of 2**k
words that starts at a multiple of 2**k within its first 2**k places, and that block again p places on. So for each
such block the occurrences in the neighbouring window of 2**k starts are asked for: the block's range of the suffix
order is its name (wavelet.Names), and a wavelet matrix over that order gives how many of its places fall in the
window and the least of them (range successor). One or two occurrences give periods as they are. More of them form
an arithmetic progression, whose difference d is the block's own period: all lie in one stretch of period d, and
only the distances that bring that stretch's begin or end, or its first block, over the block's own are periods of
something longer. Short periods share the blocks of `base` words. Each candidate is extended both ways by names of
stretches of 2**k words; of the periods of one stretch the smallest stays.

Documents are independent rows, taken in runs of RUN_BYTES (a longer document is one by itself); nothing is
shuffled. Documents in which no stretch of words occurs twice that every run repeats have none, and skip the search.

Nulls and odd input: null and empty texts, and those of white space, have no words and no runs; null and repeated
ids are kept as rows; an empty table gives none; columns besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import PLAIN_WORD, gram_hash, mix, runs, span_hash, text_view, words
from codeloom.llm.wavelet import Names, WaveletMatrix

LEAST, TIMES = 24, 3
WORD = r"[^\x20\x09-\x0D]+"
#: Words whose hashes are worked out together.
_HASHED = 1 << 18


def _stretch(names: Names, s: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the longest stretch of period p around s and s + p."""
    return s - names.before(s, s + p), s + p + names.after(s, s + p)


def _window(matrix: WaveletMatrix, names: Names, s: np.ndarray, low: np.ndarray, high: np.ndarray, near: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, candidate period) for the blocks at s whose occurrences are [low, high) of the order, from near to far words on."""
    first = matrix.below(low, high, s + near)
    n = matrix.below(low, high, s + far) - first
    some = n > 0
    s, low, high, first, n = (x[some] for x in (s, low, high, first, n))
    one = matrix.least(low, high, first)
    places, periods = [s], [one - s]
    more = n > 1
    s, low, high, first, n, one = (x[more] for x in (s, low, high, first, n, one))
    two = matrix.least(low, high, first + 1)
    pair = n == 2
    places.append(s[pair])
    periods.append(two[pair] - s[pair])
    s, one, d = s[~pair], one[~pair], (two - one)[~pair]
    begin, end = _stretch(names, s, d)
    begin2, end2 = _stretch(names, one, d)
    for p in (begin2 - begin, end2 - end):
        good = (p >= near) & (p < far)
        places.append(s[good])
        periods.append(p[good])
    return np.concatenate(places), np.concatenate(periods)


def find_runs(text: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a sequence of symbols whose parts, of up to `longest`, end in unique ones."""
    base = max(0, (least // 3).bit_length() - 1)
    names = Names(text, max(base, (max(longest, 3) // times).bit_length() - 1))
    found = []
    if len(names.levels) > base:
        matrix = WaveletMatrix(names.order)
        for k in range(base, len(names.levels)):
            m, sizes = 1 << k, names.sizes(k)
            s = np.arange(0, len(text) - m + 1, m)
            low = names.levels[k][s].astype(np.int64)
            s, low = s[sizes[low] > 1], low[sizes[low] > 1]
            for near, far in ((1, m), (m, 2 * m)) if k == base else ((m, 2 * m),):
                if near < far and len(s):
                    at, p = _window(matrix, names, s, low, low + sizes[low], near, far)
                    begin, end = _stretch(names, at, p)
                    good = end - begin >= np.maximum(least, times * p)
                    found.append(np.unique(np.stack([begin[good], end[good], p[good]], axis=1), axis=0))
    all_of = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    # Of the periods of a stretch the smallest.
    first = np.concatenate([[True], (all_of[1:, :2] != all_of[:-1, :2]).any(axis=1)]) if len(all_of) else np.zeros(0, bool)
    begin, end, p = all_of[first].T
    by = np.lexsort((p, begin))
    return begin[by], (end - begin)[by], p[by]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    parts = [np.zeros(0, np.uint64)]
    for i in range(0, len(starts), _HASHED):
        a, b = starts[i : i + _HASHED], ends[i : i + _HASHED]
        parts.append(span_hash(data[a[0] : b[-1]], a - a[0], b - a[0]))
    return np.concatenate(parts)


def _candidates(hashes: np.ndarray, first: np.ndarray, gram: int) -> np.ndarray:
    """Documents in which some stretch of `gram` words occurs twice, and perhaps others (equal hashes)."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(np.arange(len(doc)) + gram <= first[doc + 1])
    key = gram_hash(hashes, gram, at) ^ mix(doc[at].astype(np.uint64))
    order = np.argsort(key)
    return np.unique(doc[at[order[1:][key[order[1:]] == key[order[:-1]]]]])


class Found:
    """Runs of all texts of a batch, and the words that are left of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int, times: int):
        starts, ends, first = words(data, offsets, PLAIN_WORD)
        self.n_words = np.diff(first)
        keep = np.ones(len(starts), bool)
        gram = min(max(least, times * p) - p for p in range(1, least + 1))
        docs = _candidates(_hashes(data, starts, ends), first, gram) if len(starts) else np.zeros(0, np.int64)
        own, self.runs = np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 3
        if len(docs):
            n = self.n_words[docs]
            base = np.concatenate([[0], np.cumsum(n + 1)])  # each text is followed by a symbol of its own
            of = np.repeat(np.arange(len(docs)), n)
            word = first[docs][of] + np.arange(len(of)) - (base[:-1] - np.arange(len(docs)))[of]
            place = base[of] + word - first[docs][of]
            lengths = (ends - starts)[word]
            at = np.concatenate([[0], np.cumsum(lengths)])
            raw = data[np.repeat(starts[word] - at[:-1], lengths) + np.arange(at[-1])]
            spelled = pa.Array.from_buffers(pa.large_binary(), len(word), [None, pa.py_buffer(at), pa.py_buffer(raw)]).dictionary_encode()
            symbols = np.empty(base[-1], np.int64)
            symbols[place] = spelled.indices.to_numpy()
            symbols[base[1:] - 1] = len(spelled.dictionary) + np.arange(len(docs))
            begin, length, period = find_runs(symbols, int(n.max()), least, times)
            own = np.searchsorted(base, begin, "right") - 1
            self.runs = [begin - base[own], length, period]
            change = np.zeros(base[-1] + 1, np.int64)
            np.add.at(change, begin + period, 1)
            np.add.at(change, begin + length, -1)
            keep[word] = (np.cumsum(change) == 0)[place]
            own = docs[own]
        self.offsets = np.searchsorted(own, np.arange(len(offsets)))
        # What is left: the kept words' bytes, a space after each but a text's last.
        left = np.flatnonzero(keep)
        self.text_ends = np.concatenate([[0], np.cumsum(self._lengths(left, starts, ends, first))])
        size = (ends - starts)[left] + 1
        last = np.searchsorted(left, first[1:]) - 1  # of each text with words left
        size[np.unique(last[np.searchsorted(left, first[1:]) > np.searchsorted(left, first[:-1])])] -= 1
        at = np.concatenate([[0], np.cumsum(size)])
        pad = np.append(data, np.uint8(0x20))
        raw = pad[np.repeat(starts[left] - at[:-1], size) + np.arange(at[-1])]
        raw[PLAIN_WORD[raw] == False] = 0x20  # noqa: E712  a word is followed by some white space
        self.left = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(self.text_ends.astype(np.int32)), pa.py_buffer(raw)])

    @staticmethod
    def _lengths(left: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum((ends - starts)[left] + 1)])
        edges = total[np.searchsorted(left, first)]
        return np.maximum(np.diff(edges) - 1, 0)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(id, n_words, runs, left): runs as (start, length, period) by start, then period, in words from 0; `left` is
    the text with single spaces, of each run only the words of its first period.

    times must be 3 or more: shorter repeats don't hold two blocks of their period's size.
    """
    if times < 3 or least < 3:
        raise ValueError("runs are three periods and three words at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_view(batch.column(1))
            for i, j in runs(offsets):
                part = batch.slice(i, j - i)
                found = Found(*text_view(part.column(1)), least, times)
                spans = pa.StructArray.from_arrays([pa.array(x) for x in found.runs], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.n_words), pa.ListArray.from_arrays(pa.array(found.offsets.astype(np.int32)), spans), found.left], ["id", "n_words", "runs", "left"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, left string")


def with_cycles(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text; for a tenth of the ids (crc32 of the id) it goes round in a cycle of words from some word on, with single spaces."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def turned(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, at(i).cast("int"))), " ")).otherwise("")

    # Inside a one-element array the words are worked out once and not for each place.
    text = F.col(text_col).cast("string")
    return F.when((h % 10 == 0) & text.rlike(WORD), F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), turned), F.lit(0))).otherwise(text)


def strongest(spans: str) -> Column:
    """The run with the greatest length over period, exactly; the first of those; null where there are none."""
    none = F.get(F.slice(F.col(spans), 1, 1), F.lit(0))
    return F.aggregate(F.col(spans), none, lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def periodic_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", with_cycles().alias("text"))).withColumn("best", strongest("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("left").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: crc32 by the bit-wise rule (its table in t). Words q apart are alike over 16 words or more in a row in every run, so
#: pairs of equal 16-word stretches give all periods; islands of such pairs are the stretches.
ORACLE = r"""
WITH RECURSIVE bits AS (SELECT i AS i, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
t AS (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS tab FROM bits WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM documents, t),
e AS (SELECT *, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
f AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM e),
m AS MATERIALIZED (SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM f),
x AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n, w FROM m),
g AS MATERIALIZED (SELECT doc_id, i, n, array_to_string(w[i + 1:i + 16], ' ') AS gram FROM x WHERE i + 16 <= n),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS p FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.gram = b.gram AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
islands AS (SELECT doc_id, p, min(i) AS start, count(*) + 15 + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM pairs) GROUP BY doc_id, p, island),
r AS MATERIALIZED (SELECT doc_id, start, length, min(p) AS period FROM islands WHERE length >= greatest(24, 3 * p) GROUP BY doc_id, start, length),
s AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period)) AS runs_sha256 FROM r GROUP BY doc_id),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / CAST(period AS DOUBLE) DESC, start, period) = 1),
c AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256 FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.period AND x.i < r.start + r.length) GROUP BY doc_id)
SELECT m.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM m LEFT JOIN s USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
"""
