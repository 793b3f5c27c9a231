"""Benchmark decontamination by winnowing.

Of each run of WINDOW consecutive K-word hashes the least is kept as a fingerprint. With K + WINDOW - 1
equal to the span length (13 words), a document and an item that share a span share the fingerprint which
that span selects, so joining the fingerprints of both sides misses none. An item shorter than a span is one
window; such items are fingerprinted by their whole length (a window of one).

Both sides are fingerprinted where they are read. A bitmap of the benchmark's fingerprints, of FILTER_BITS
bits whatever its size, is the only broadcast; documents write the fingerprints that pass it, with the words
around them. Those are joined with the benchmark's by hash and length. Each joined fingerprint is extended:
the spans around it are joined with the items' spans by a digest (blake2b) of their words, so no other words
count. Items that share a span are a list with a key of its own, which is made once and joined to documents
by that key, so a span of many documents and many items makes no pairs of them.

Nulls and odd input: null texts (either side) have no words; an item with a null id still makes words hit
but is not listed; items of one id count once; repeated documents are kept as rows; empty tables work;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import ALNUM_WORD, LOWER, gram_hash, materialise, mix, row_key, runs, span_hash, text_view, winnow, without_rows, words

SPAN, K = 13, 6
WINDOW = SPAN - K + 1
#: Bits of the filter; with more fingerprints than that it lets more through, and the joins still decide.
FILTER_BITS = 1 << 26
_U = np.uint64


def _slots(prints: np.ndarray, m: int, n_bits: int) -> np.ndarray:
    """Places of fingerprints of spans of m words in a filter of n_bits, a power of two."""
    return (mix(prints ^ _U(m * 0x9E3779B97F4A7C15 % (1 << 64))) & _U(n_bits - 1)).astype(np.int64)


class _Words:
    """Lower-cased words of some texts: bytes, byte starts and ends, words before each text, and their hashes."""

    def __init__(self, column: pa.Array):
        data, offs = text_view(column)
        self.data = LOWER[data]
        self.starts, self.ends, self.first = words(self.data, offs, ALNUM_WORD)
        self.hash = span_hash(self.data, self.starts, self.ends)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, joined by spaces."""
        return b" ".join([self.data[x:y].tobytes() for x, y in zip(self.starts[a:b], self.ends[a:b], strict=True)])


def _gram(m: int) -> tuple[int, int]:
    """Gram length and winnowing window of spans of m words."""
    return (K, WINDOW) if m == SPAN else (m, 1)


def _digest(span: bytes) -> tuple[int, int]:
    raw = hashlib.blake2b(span, digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


_SPANS = ["digest_a", "digest_b"]
_NEAR = pa.struct([("m", pa.int32()), ("print", pa.int64()), ("place", pa.int64()), ("words", pa.binary())])


def item_spans(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """(item, m, print, slot, digest_a, digest_b): every window of every item, with the fingerprint that it selects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in runs(text_view(batch.column(1))[1]):
                w = _Words(batch.column(1)[i:j])
                out = []
                for row, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                    m = min(SPAN, b - a)
                    if not m:
                        continue
                    k, width = _gram(m)
                    grams = gram_hash(w.hash[a:b], k)
                    for s in range(b - a - m + 1):
                        own = grams[s : s + width].min()
                        out.append((i + row, m, int(own.view(np.int64)), int(_slots(np.array([own]), m, filter_bits)[0]), *_digest(w.text(a + s, a + s + m))))
                rows, *cols = zip(*out, strict=True) if out else [[]] * 6
                kinds = [pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["item", "m", "print", "slot", *_SPANS])

    source = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    return source.mapInArrow(run, "item string, m int, print long, slot long, digest_a long, digest_b long")


def _near(docs: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """(id, key_a, key_b, n_words, near): each document with the fingerprints that pass the filter and the words around them."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for i, j in runs(text_view(batch.column(3))[1]):
                part = batch.slice(i, j - i)
                w = _Words(part.column(3))
                near: list[list] = [[] for _ in range(j - i)]
                for m in lengths:
                    if len(w.hash) < m:
                        continue
                    k, width = _gram(m)
                    grams = gram_hash(w.hash, k)
                    at = winnow(grams, width) if width > 1 else np.arange(len(grams))
                    slot = _slots(grams[at], m, 8 * len(table))
                    at = at[table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1]
                    doc = np.searchsorted(w.first, at, "right") - 1
                    low, high = w.first[doc], w.first[doc + 1]
                    whole = at + k <= high
                    for p, d, a, b in zip(at[whole].tolist(), doc[whole].tolist(), low[whole].tolist(), high[whole].tolist(), strict=True):
                        s, e = max(a, p - (m - k)), min(b, p + m)
                        if e - s >= m:
                            near[d].append({"m": m, "print": int(grams[p].view(np.int64)), "place": s - a, "words": w.text(s, e)})
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.diff(w.first), pa.int64()), pa.array(near, pa.list_(_NEAR))], ["id", "key_a", "key_b", "n_words", "near"])

    return docs.mapInArrow(run, "id long, key_a long, key_b long, n_words long, near array<struct<m:int,print:long,place:long,words:binary>>")


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key_a, key_b, m, start, digest_a, digest_b): every span of m words in the words around a fingerprint."""
    for batch in batches:
        out = []
        for a, b, m, place, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = near.split(b" ")
            out += [(a, b, m, place + s, *_digest(b" ".join(own[s : s + m]))) for s in range(len(own) - m + 1)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3]
        cols = zip(*out, strict=True) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key_a", "key_b", "m", "start", *_SPANS])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keyed: bool = False, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per document: id, n_words, hit_words (array of word positions), items (sorted array of ids).

    With `keyed`, the row's key_a and key_b (see common.row_key) come last.
    """
    keys = ["key_a", "key_b"]
    spans = materialise(item_spans(benchmark, item_id, item_text, filter_bits))
    bits = np.zeros(filter_bits // 8, np.uint8)
    filled = spans.groupBy(F.shiftright("slot", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, CAST(slot & 7 AS INT))")).alias("bits"))
    for r in filled.toLocalIterator():  # at most filter_bits / 8 small rows
        bits[r["at"]] = r["bits"]
    lengths = sorted(r["m"] for r in spans.select("m").distinct().collect())  # 1 to SPAN
    source = docs.select(F.col(id_col).cast("long").alias("id"), *row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    found = materialise(_near(source, lengths, bits))

    prints = spans.select("m", "print").distinct()
    near = found.select(*keys, F.explode("near").alias("x")).select(*keys, "x.*").distinct().join(prints, ["m", "print"], "left_semi")
    extended = near.select(*keys, "m", "place", "words").mapInArrow(_extend, "key_a long, key_b long, m int, start long, digest_a long, digest_b long").distinct()
    # Spans with the items that have them; equal lists of items are one.
    lists = spans.groupBy("m", *_SPANS).agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("list", F.md5(F.to_json("items")))
    lists = materialise(lists)
    hits = materialise(extended.join(lists.select("m", *_SPANS, "list"), ["m", *_SPANS]).select(*keys, "m", "start", "list"))
    # Of each hit only the words beyond the hits that start before it, so that a word is held once.
    reach = hits.groupBy(*keys, "start").agg((F.col("start") + F.max("m")).alias("end"))
    before = F.max("end").over(Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = reach.withColumn("begin", F.greatest("start", F.coalesce(before, F.col("start")))).where("begin < end")
    spots = fresh.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list(F.sequence("begin", F.col("end") - 1)))).alias("hit_words"))
    named = hits.select(*keys, "list").distinct().join(lists.select("list", "items").dropDuplicates(["list"]), "list")
    named = named.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.array().cast("array<long>"), F.array().cast("array<string>")
    out = found.select("id", *keys, "n_words").join(spots.join(named, keys), keys, "left")
    return out.select("id", "n_words", F.coalesce("hit_words", none[0]).alias("hit_words"), F.coalesce("items", none[1]).alias("items"), *(keys if keyed else []))


def contaminated(share: int = 20) -> Column:
    """At least one word in `share` is hit."""
    n_hit = F.size("hit_words").cast("long")
    return (n_hit > 0) & (n_hit * share >= F.col("n_words"))


def verdict(found: DataFrame, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(share).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents that are not contaminated, with their columns. Other rows with a contaminated row's id stay."""
    return without_rows(docs, id_col, text_col, contamination(docs, benchmark, id_col, text_col, keyed=True, **kw).where(contaminated()))


def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return verdict(contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


#: A document's words are numbered; windows of 13 item words (or whole shorter items) are joined on their text.
ORACLE = r"""
WITH iw AS (SELECT item_id, string_split(trim(regexp_replace(lower_az, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' ') AS w
            FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark) b),
i AS (SELECT item_id, list_filter(w, lambda x: x <> '') AS w FROM iw),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(list_slice(w, p, p + least(13, len(w)) - 1), ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0) u),
dw AS (SELECT doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
pos AS (SELECT doc_id, m, p, array_to_string(list_slice(w, p, p + m - 1), ' ') AS s
        FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM dw CROSS JOIN (SELECT DISTINCT m FROM win) ms WHERE len(w) >= m) u),
hits AS (SELECT pos.doc_id, pos.p, pos.m, win.item_id FROM pos JOIN win ON pos.m = win.m AND pos.s = win.s),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hits) u GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) u GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""
