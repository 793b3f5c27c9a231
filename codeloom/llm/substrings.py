"""Substring dedup: every word inside a run of SPAN words that also starts elsewhere is removed.

Sharding. Each window of SPAN words has an anchor, the least hash of its K-word grams; equal windows have
equal anchors. Consecutive windows with one anchor make a fragment (their words, SPAN - 1 more than
windows). An anchor with one fragment in the corpus can't hold a repeated window, unless the anchor is in
it twice. The others' fragments are grouped by content first (blake2b of the words), so that a passage
shared by a third of all documents is one row with a count, and each distinct fragment goes to the shard
that its anchor names: every window meets all its equals in one shard, and each shard is bounded
(SHARD_WORDS on average).

Index. A shard's distinct fragments are indexed with an FM-index over a wavelet matrix (fm_index). The
stretches of documents that the fragments stand for are streamed through it, each distinct one once, by
backward search on the words themselves; matching statistics that reach SPAN words with a total count of
two or more are the repeated windows.

A heavy anchor, whose distinct fragments alone hold over SHARD_WORDS words (such as a very common passage
with different words around it), would fill a shard; its fragments are cut into single windows, which are
counted and sharded by their own hash.

Results come back by fragment content, and each document removes the words that repeated windows cover.
Windows are judged on the input. Rows are keyed by id and whole text: equal rows are separate
occurrences (so all their windows repeat) with equal results.

Nulls and odd input: a null or empty text has no words; texts shorter than SPAN words keep all; null ids
are kept; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import PLAIN_WORD, gram_hash, materialise, row_key, runs, sliding_min, span_hash, text_view, winnow, words
from codeloom.llm.fm_index import FMIndex, repeated_windows

SPAN, K = 35, 8
#: Windows in a fragment; their results are bits of a 64-bit integer.
MOST_WINDOWS = 32
SHARD_WORDS = 400_000
_KEYS = ["key_a", "key_b"]
_CONTENT = ["anchor", "digest_a", "digest_b"]


def _normal(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with one space between words, the words' byte starts and ends, and the words before each text."""
    data, offs = text_view(column)
    raw = memoryview(data)
    texts = [b" ".join(bytes(raw[a:b]).split()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    whole = b"".join(texts)
    offs = np.cumsum([0, *map(len, texts)])
    return whole, *words(np.frombuffer(whole, np.uint8), offs, PLAIN_WORD)


def _digests(pieces: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """128-bit content digests as two integers."""
    blake = hashlib.blake2b
    both = np.frombuffer(b"".join([blake(x, digest_size=16).digest() for x in pieces]), "<i8").reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def _fragments(h: np.ndarray, first: np.ndarray, span: int, k: int):
    """First word (of all), windows, anchor of each fragment, and whether it may repeat itself.

    A fragment with two equal windows has its anchor at two places, which follow one another among the
    places that are least in some window.
    """
    width = span - k + 1
    grams = gram_hash(h, k)
    low = sliding_min(grams, width)
    room = np.diff(first) - span + 1
    docs = np.flatnonzero(room > 0)
    if not len(docs):
        return [np.zeros(0, np.int64)] * 4
    room = room[docs]
    at = np.repeat(first[docs] - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum())
    value = low[at]
    new = np.concatenate([[True], (np.diff(at) != 1) | (value[1:] != value[:-1])])
    head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - head) % MOST_WINDOWS == 0
    begin = np.flatnonzero(new)
    n = np.diff(np.concatenate([begin, [len(at)]]))
    s = at[begin]
    least = winnow(grams, width)
    pair = np.flatnonzero(grams[least[1:]] == grams[least[:-1]])
    again = np.searchsorted(least[pair + 1], s + n + width - 1) > np.searchsorted(least[pair], s)
    return s, n, value[begin].view(np.int64), again


def fragments(docs: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """All fragments of (key_a, key_b, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in runs(text_view(batch.column(2))[1]):
                part = batch.slice(i, j - i)
                whole, starts, ends, first = _normal(part.column(2))
                s, n, anchor, again = _fragments(span_hash(np.frombuffer(whole, np.uint8), starts, ends), first, span, k)
                content = [whole[a:b] for a, b in zip(starts[s].tolist(), ends[s + n + span - 2].tolist(), strict=True)]
                doc = np.searchsorted(first, s, "right") - 1
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array((s - first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor), *_digests(content), pa.array(again.astype(bool))],
                    [*_KEYS, "start", "n", *_CONTENT, "again"],
                )

    return docs.select(*_KEYS, "text").mapInArrow(run, "key_a long, key_b long, start int, n int, anchor long, digest_a long, digest_b long, again boolean")


_WANTED = "struct<start:int,n:int,anchor:long,digest_a:long,digest_b:long,times:long,heavy:boolean>"
_PIECE = "anchor long, digest_a long, digest_b long, times long, heavy boolean, n int, words binary, whole_anchor long, whole_a long, whole_b long, place int"


def _cut(span: int):
    """The words of wanted fragments, from (key_a, key_b, text, wanted) rows; heavy ones window by window.

    Of equal rows the first in a task is enough (those in other tasks are dropped in the shard).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            fresh = [not (k in seen or seen.add(k)) for k in keys]
            if not all(fresh):
                batch = batch.filter(pa.array(fresh))
            for i, j in runs(text_view(batch.column(2))[1]):
                part = batch.slice(i, j - i)
                whole, starts, ends, first = _normal(part.column(2))
                want = part.column(3).flatten()
                column = {x.name: want.field(x.name).to_numpy(zero_copy_only=False) for x in want.type}
                s = np.repeat(first[:-1], np.diff(part.column(3).offsets.to_numpy())) + column["start"]
                light = ~column["heavy"].astype(bool)
                times = np.where(light, 1, column["n"])  # pieces of a fragment
                row = np.repeat(np.arange(len(s)), times)
                place = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                light, s = light[row], s[row] + place
                n = np.where(light, column["n"][row], 1)
                pieces = [whole[a:b] for a, b in zip(starts[s].tolist(), ends[s + n + span - 2].tolist(), strict=True)]
                own = [column[c][row] for c in _CONTENT]
                heavy = np.flatnonzero(~light)
                digests = _digests([pieces[x] for x in heavy.tolist()])
                content = [x.copy() for x in own]
                for x, d in zip(content, (digests[0], *digests), strict=True):
                    x[heavy] = d.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, content), pa.array(column["times"][row]), pa.array(~light), pa.array(n.astype(np.int32)), pa.array(pieces, pa.binary()), *[pa.array(x, mask=light) for x in own], pa.array(place.astype(np.int32), mask=light)],
                    [f.split()[0] for f in _PIECE.split(", ")],
                )

    return run


def _search(span: int):
    """One shard: which windows of its distinct fragments occur twice or more, as bits."""

    def run(table: pa.Table) -> pa.Table:
        content = np.stack([table.column(c).to_numpy() for c in _CONTENT[1:]], axis=1)
        table = table.take(pa.array(np.unique(content, axis=0, return_index=True)[1]))
        pieces = pc.split_pattern(table.column("words").combine_chunks().cast(pa.string()), " ")
        n = np.diff(pieces.offsets.to_numpy()).astype(np.int64)
        begin = np.cumsum(n + 1) - (n + 1)
        text = np.zeros(int((n + 1).sum()), np.int64)  # fragments end with symbol 0
        at = np.arange(int(n.sum())) + np.repeat(np.arange(len(n)), n)
        text[at] = pieces.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        index = FMIndex(text, span + MOST_WINDOWS, np.repeat(table.column("times").to_numpy() > 1, n + 1))
        owner, first, last = repeated_windows(index, text, begin, table.column("n").to_numpy().astype(np.int64), span)
        mask = np.zeros(len(n), np.uint64)
        np.bitwise_or.at(mask, owner, ((np.uint64(1) << (last - first + 1).astype(np.uint64)) - np.uint64(1)) << first.astype(np.uint64))
        return pa.table({**{c: table.column(c) for c in (*_CONTENT, "heavy")}, "mask": pa.array(mask.view(np.int64))})

    return run


def repeated(docs: DataFrame, span: int = SPAN, k: int = K, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(key_a, key_b, spans) of the (key_a, key_b, text) rows with repeated windows.

    spans: array of (start, mask); bit i tells that the window from word start + i occurs elsewhere too.
    """
    found = materialise(fragments(docs, span, k))
    anchors = materialise(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), F.max("again").alias("again")).where("times > 1 OR again").select("anchor"))
    hits = materialise(found.drop("again").join(anchors, "anchor"))
    reps = materialise(hits.groupBy(*_CONTENT).agg(F.count(F.lit(1)).alias("times"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in (*_KEYS, "start")]))
    weights = reps.groupBy("anchor").agg(F.sum(F.col("n") + span - 1).alias("words"))
    heavy = materialise(weights.where(F.col("words") > shard_words).select("anchor", F.lit(True).alias("heavy")))
    shards = int((reps.agg(F.sum(F.col("n") + span)).first()[0] or 0) // shard_words + 1)

    wanted = reps.join(heavy, "anchor", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    wanted = wanted.groupBy(*_KEYS).agg(F.collect_list(F.struct("start", "n", *_CONTENT, "times", "heavy").cast(_WANTED)).alias("wanted"))
    pieces = materialise(docs.join(wanted.hint("shuffle_hash"), _KEYS).select(*_KEYS, "text", "wanted").mapInArrow(_cut(span), _PIECE))
    # Distinct fragments are distinct already; windows of heavy ones are counted before they are moved to their shards.
    kept = [*_CONTENT, "heavy", "n", "times", "words"]
    windows = pieces.where("heavy").groupBy(*_CONTENT).agg(F.sum("times").alias("times"), F.first("n").alias("n"), F.first("words").alias("words")).withColumn("heavy", F.lit(True))
    every = pieces.where("NOT heavy").select(*kept).unionByName(windows.select(*kept))
    masks = every.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")).applyInArrow(_search(span), "anchor long, digest_a long, digest_b long, heavy boolean, mask long")
    masks = materialise(masks.where("mask <> 0"))
    back = pieces.where("heavy").select(*_CONTENT, "whole_anchor", "whole_a", "whole_b", "place").join(masks.where("heavy"), _CONTENT)
    back = back.groupBy(*[F.col(w).alias(c) for w, c in zip(("whole_anchor", "whole_a", "whole_b"), _CONTENT, strict=True)]).agg(F.bit_or(F.expr("shiftleft(mask, place)")).alias("mask"))
    whole = masks.where("NOT heavy").select(*_CONTENT, "mask").unionByName(back)
    return hits.join(whole, _CONTENT).groupBy(*_KEYS).agg(F.collect_set(F.struct("start", "mask")).alias("spans"))


def _covered(first: np.ndarray, spans: pa.Array, span: int) -> np.ndarray:
    """Which of all words are inside a repeated window; first: words before each text."""
    found = spans.flatten()
    start = np.repeat(first[:-1], np.diff(spans.offsets.to_numpy())) + found.field("start").to_numpy(zero_copy_only=False)
    mask = np.ascontiguousarray(found.field("mask").to_numpy(zero_copy_only=False), "<i8")
    which, bit = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    at, n = start[which].astype(np.int64) + bit, int(first[-1]) + 1
    return np.cumsum(np.bincount(at, minlength=n) - np.bincount(at + span, minlength=n))[:-1] > 0


_RANGES = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def _strip(span: int):
    """(id, n_words, intervals, n_removed, kept_sha256) from (id, text, spans) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_view(batch.column(1))
            raw = memoryview(data)
            for i, j in runs(offs):
                own = [bytes(raw[a:b]).split() for a, b in zip(offs[i:j].tolist(), offs[i + 1 : j + 1].tolist(), strict=True)]
                first = np.cumsum([0, *map(len, own)])
                gone = _covered(first, batch.column(2)[i:j].fill_null([]), span)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
                stays = (~gone).tolist()
                kept = [b" ".join(compress(w, stays[a:b]) if r else w) for w, r, a, b in zip(own, removed.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)]
                # Ranges end at the ends of texts.
                edge = np.concatenate([gone, [False]])
                new, old = edge.copy(), np.concatenate([[False], gone])
                cut = np.zeros(len(edge), bool)
                cut[first] = True
                begin, end = np.flatnonzero(new & (~old | cut)), np.flatnonzero(old & (~new | cut))
                doc = np.searchsorted(first, begin, "right") - 1
                ranges = pa.StructArray.from_arrays([pa.array(begin - first[doc]), pa.array(end - first[doc])], ["from", "to"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, first).astype(np.int32)), ranges).cast(_RANGES)
                sha = [hashlib.sha256(x).hexdigest() for x in kept]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(first)), lists, pa.array(removed.astype(np.int64)), pa.array(sha, pa.string())], ["id", "n_words", "intervals", "n_removed", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, **kw) -> DataFrame:
    """(id, n_words, intervals, n_removed, kept_sha256) of every document.

    intervals: array of (from, to) word ranges that are removed.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), *row_key(id_col, text_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = repeated(source.select(*_KEYS, "text"), span, **kw)
    both = source.join(spans.hint("shuffle_hash"), _KEYS, "left").select("id", "text", "spans")
    return both.mapInArrow(_strip(span), "id long, n_words long, intervals array<struct<from:long,to:long>>, n_removed long, kept_sha256 string")


def substrings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


#: Windows as joined words; those whose text occurs twice cover their 35 words.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 34), ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35) u),
rep AS (SELECT doc_id, p FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT doc_id, list(DISTINCT q) AS g FROM (SELECT doc_id, unnest(range(p, p + 35)) AS q FROM rep) u GROUP BY doc_id),
word AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) u),
hit AS (SELECT doc_id, unnest(g) AS i, true AS gone FROM gone),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) AS t, count(*) AS n FROM word LEFT JOIN hit ON word.doc_id = hit.doc_id AND word.i = hit.i WHERE gone IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
