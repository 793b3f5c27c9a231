"""Token counts of whole texts by a map-side two-tier lookup, without moving any pre-token between tasks.

A text is cut into pre-tokens by array operations over its bytes (classes of characters are asked of the library,
once a character and worker). The number of tokens of a pre-token is then looked up

1. in a table of the frequent ones that is broadcast: an open-addressing hash table over pre-tokens of up to 15
   bytes, which are its keys as they are (two 64-bit words), so that a hit is always right; its size is fixed;
2. in a cache of the worker, which asks the library's merge model for what is new.

The frequent ones come from the first texts of a few partitions spread over the table (SAMPLE_PARTS of them and
SAMPLE_BYTES of each, the rest isn't read). They decide where a count is looked up, never what it is. One text of
each batch goes through the library as a check.

Long texts are cut where a single space stands between two ASCII characters that are none, which every byte-level
pattern cuts too, so a task holds a few MB at a time. Texts with the string of an added token go to the library
whole, as all texts do where the tokenizer is no plain byte-level one (.model files: sentencepiece).

Nulls and odd input: a null or empty text has no bytes and no tokens; rows with a null or repeated id are counted
as rows; an empty table gives none; columns besides id and text are ignored.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import mix, runs, span_hash, text_view

#: Pre-tokens of the broadcast table and its slots (17 bytes each); the longest that two words of 64 bits hold.
FREQUENT, SLOTS, WIDEST = 1 << 16, 1 << 18, 15
#: Partitions that are looked at for them, bytes of text and pre-tokens taken from each.
SAMPLE_PARTS, SAMPLE_BYTES, SAMPLE_WORDS = 16, 4_000_000, 1 << 15
#: Entries of a worker's cache, and the longest pre-token kept in it.
CACHE_ENTRIES, CACHE_BYTES = 400_000, 64
#: Bytes of text worked through together; longer texts are cut into parts of about a quarter of that.
RUN = 4_000_000
LETTER, NUMBER, OTHER, WHITE, SPACE, EDGE, UNKNOWN = 0, 1, 2, 3, 4, 5, 255
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def plain_byte_level(tokenizer) -> bool:
    """Whether texts are cut by the byte-level pattern alone: no normaliser, no space in front, merges inside pre-tokens only."""
    import json

    spec = json.loads(tokenizer.to_str())
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    added = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
    return (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) == ("ByteLevel", False, True) and not spec.get("normalizer") and model["type"] == "BPE" and not model.get("dropout") and not added


class Cutter:
    """Places where pre-tokens begin, for the byte-level pattern."""

    def __init__(self, tokenizer):
        self.cut = tokenizer.pre_tokenizer.pre_tokenize_str
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self._learn(np.arange(128))
        self.ascii = np.full(256, UNKNOWN, np.uint8)
        self.ascii[:128] = self.classes[:128]

    def _learn(self, points: np.ndarray) -> None:
        """A character is of the class of whose pre-tokens it becomes a part."""
        for p in points.tolist():
            c = chr(p)
            own = next((k for k, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.cut(before + c)) == 1), WHITE)
            self.classes[p] = SPACE if c == " " else own

    def _classes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class of each byte's character, the first bytes of wide characters and their sizes."""
        out = self.ascii[data]
        wide = np.flatnonzero(data >= 0xC0)
        if not len(wide):
            return out, wide, wide
        pad = np.append(data, np.zeros(3, np.uint8))
        a, b, c, d = (pad[wide + k].astype(np.int32) & (0xFF if k == 0 else 0x3F) for k in range(4))
        size = 2 + (a >= 0xE0) + (a >= 0xF0)
        point = np.where(size == 2, (a & 0x1F) << 6 | b, np.where(size == 3, (a & 0x0F) << 12 | b << 6 | c, (a & 0x07) << 18 | b << 12 | c << 6 | d))
        kind = self.classes[point]
        if (kind == UNKNOWN).any():
            self._learn(np.unique(point[kind == UNKNOWN]))
            kind = self.classes[point]
        for k in range(4):
            own = size > k
            out[wide[own] + k] = kind[own]
        return out, wide, size

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens of all texts; each ends where the next begins."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        edge = np.zeros(n + 4, bool)
        edge[offsets] = True
        kind, wide, size = self._classes(data)
        before, after = np.full(n, EDGE, np.uint8), np.full(n, EDGE, np.uint8)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        before[edge[:n]] = EDGE
        after[edge[1 : n + 1]] = EDGE
        gaps = kind[wide] == WHITE
        after[wide[gaps]] = after[wide[gaps] + size[gaps] - 1]
        white = kind >= WHITE
        ended = (after < WHITE) | ((before != WHITE) & (before != SPACE))  # the last of a run of white space goes by itself or to what follows
        begin = np.where(white, ended, (before != kind) & (before != SPACE)) & ((data & 0xC0) != 0x80)
        # Fixed values: 's 't 'm 'd 're 've 'll are pre-tokens of their own where one may begin.
        at = np.flatnonzero((data == 0x27) & begin)
        pad = np.append(data, np.zeros(3, np.uint8))
        one, two = pad[at + 1].astype(np.int32), pad[at + 1].astype(np.int32) << 8 | pad[at + 2]
        inner = ~edge[at + 1]
        short, long = inner & np.isin(one, [ord(c) for c in "stmd"]), inner & ~edge[at + 2] & np.isin(two, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])
        begin[at[short | long] + 1] = False
        ends = np.concatenate([at[short] + 2, at[long] + 3])
        begin[ends[ends < n]] = True
        return np.flatnonzero(begin)


def keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words for each pre-token of up to WIDEST bytes: its bytes, and its length in the highest byte."""
    pad = np.append(data, np.zeros(16, np.uint8))
    word = np.ndarray((len(pad) - 7,), "<u8", pad, strides=(1,))
    low = word[starts] & _MASK[np.minimum(lengths, 8)]
    high = word[starts + 8] & _MASK[np.clip(lengths - 8, 0, 7)]
    return low, high | lengths.astype(np.uint64) << np.uint64(56)


class Table:
    """Token numbers of frequent pre-tokens by their keys, with linear probing."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.low, self.high, self.n = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint8)
        offs = np.cumsum([0, *map(len, words)])
        low, high = keys(np.frombuffer(b"".join(words), np.uint8), offs[:-1], np.diff(offs))
        self.probes = 0
        for a, b, c, slot in zip(low, high, counts, self._slot(low, high).tolist(), strict=True):
            probes = 1
            while self.high[slot]:
                slot, probes = (slot + 1) % SLOTS, probes + 1
            self.low[slot], self.high[slot], self.n[slot] = a, b, c
            self.probes = max(self.probes, probes)

    @staticmethod
    def _slot(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high)) & np.uint64(SLOTS - 1)).astype(np.int64)

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of tokens, or 0 for what isn't in the table."""
        slot, out = self._slot(low, high), np.zeros(len(low), np.int64)
        left = np.arange(len(low))
        for _ in range(self.probes):
            have = self.high[slot]
            hit = (have == high) & (self.low[slot] == low)
            out[left[hit]] = self.n[slot[hit]]
            on = ~hit & (have != 0)
            if not on.any():
                break
            left, low, high, slot = left[on], low[on], high[on], (slot[on] + 1) % SLOTS
        return out


def pieces_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Spans of the bytes as a binary array."""
    offs = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts - offs[:-1], lengths) + np.arange(offs[-1])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data[at])])


class Counts:
    """Numbers of tokens of texts, by the table and a cache, or by the library alone."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.cutter, self.added = None, []
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            pieces = SentencePieceProcessor(model_file=path)
            self.library = lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.library = lambda texts: [len(e.ids) for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        if plain_byte_level(self.tok):
            self.cutter = Cutter(self.tok)
            self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
            # The vocabulary's letters for bytes: printable Latin-1 characters stand for themselves, the others follow from 256 on.
            same = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
            spare = iter(range(256, 512))
            self.letters = {b: chr(b if b in same else next(spare)) for b in range(256)}
            self.cache: dict[bytes, int] = {}

    def merged(self, word: bytes) -> int:
        """Tokens of one pre-token, by the library's merge model."""
        return len(self.tok.model.tokenize(word.decode("latin-1").translate(self.letters)))

    def _missed(self, words: list[bytes]) -> list[int]:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        out = []
        for w in words:
            n = self.cache.get(w)
            if n is None:
                n = self.merged(w)
                if len(w) <= CACHE_BYTES:
                    self.cache[w] = n
            out.append(n)
        return out

    def _cut(self, data: np.ndarray, offsets: np.ndarray, table: Table) -> np.ndarray:
        """Tokens of texts, or parts of texts, that hold no added token."""
        starts = self.cutter(data, offsets)
        lengths = np.diff(np.append(starts, len(data)))
        short = np.flatnonzero(lengths <= WIDEST)
        n = np.zeros(len(starts), np.int64)
        n[short] = table(*keys(data, starts[short], lengths[short]))
        rare = np.flatnonzero(n == 0)
        if len(rare):
            own = pieces_of(data, starts[rare], lengths[rare]).dictionary_encode()
            n[rare] = np.array(self._missed(own.dictionary.to_pylist()), np.int64)[own.indices.to_numpy()]
        before = np.concatenate([[0], np.cumsum(n)])
        return np.diff(before[np.searchsorted(starts, offsets)])

    def __call__(self, texts: pa.Array, table: Table) -> np.ndarray:
        texts = texts.fill_null("")
        if self.cutter is None:
            return np.array(self.library(texts.to_pylist()), np.int64)
        whole = pa.array(np.zeros(len(texts), bool))
        for a in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, a))
        data, offsets = text_view(pc.if_else(whole, "", texts))
        parts = with_parts(data, offsets, RUN // 4)
        n = np.concatenate([np.zeros(0, np.int64), *[self._cut(data[parts[i] : parts[j]], parts[i : j + 1] - parts[i], table) for i, j in runs(parts, RUN)]])
        before = np.concatenate([[0], np.cumsum(n)])
        out = np.diff(before[np.searchsorted(parts, offsets, "right") - 1])
        whole = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        check = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < 20_000))[:1]
        if len(check) and self.library([texts[int(check[0])].as_py()]) != [out[check[0]]]:
            raise ValueError("token counts differ from the library's")
        for i in whole.tolist():
            out[i] = self.library([texts[i].as_py()])[0]
        return out


def with_parts(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """The offsets, without repeats of empty texts, and cuts of longer texts into parts of about `size` bytes."""
    cuts = [np.unique(offsets)]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a > size:
            d = data[a:b]
            plain = (d > 0x20) & (d < 0x7F)
            at = np.flatnonzero((d[1:-1] == 0x20) & plain[:-2] & plain[2:]) + 1
            cuts.append(a + at[np.unique(np.minimum(np.searchsorted(at, np.arange(size, b - a, size)), len(at) - 1))] if len(at) else at)
    return np.unique(np.concatenate(cuts)) if len(data) else np.zeros(1, np.int64)


@lru_cache(maxsize=2)
def _counts(path: str) -> Counts:
    return Counts(path)


def frequent(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> Table:
    """The table of the most frequent pre-tokens in a bounded sample; empty where texts aren't cut."""
    counts = _counts(tokenizer_path)
    if counts.cutter is None:
        return Table([], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, left = _counts(tokenizer_path).cutter, SAMPLE_BYTES
        for batch in batches:
            data, offsets = text_view(batch.column(0))
            end = min(left, len(data))
            while end < len(data) and data[end] & 0xC0 == 0x80:  # not inside a character
                end -= 1
            data, offsets = data[:end], np.append(offsets[offsets < end], end)
            starts = cutter(data, offsets)
            lengths = np.diff(np.append(starts, len(data)))
            short = lengths <= WIDEST
            starts, lengths = starts[short], lengths[short]
            if len(starts):
                _, first, n = np.unique(span_hash(data, starts, starts + lengths), return_index=True, return_counts=True)
                top = np.argsort(-n, kind="stable")[:SAMPLE_WORDS]
                yield pa.RecordBatch.from_arrays([pieces_of(data, starts[first[top]], lengths[first[top]]), pa.array(n[top])], ["word", "n"])
            left -= len(data)
            if left <= 4:
                return

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n long").rdd
    parts = found.getNumPartitions()
    asked = sorted({i * parts // SAMPLE_PARTS for i in range(SAMPLE_PARTS)}) if parts else []
    total: Counter = Counter()
    # SAMPLE_PARTS partitions and SAMPLE_WORDS pre-tokens of each batch of them, whatever the table's size.
    for word, n in docs.sparkSession.sparkContext.runJob(found, lambda rows: [(bytes(r[0]), r[1]) for r in rows], asked) if asked else []:
        total[word] += n
    words = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]]
    return Table(words, [counts.merged(w) for w in words])


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each whole text, without begin, end or other special tokens added."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, tokenizer_path, text_col))  # 17 bytes a slot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, table = _counts(tokenizer_path), shared.value
        for batch in batches:
            _, offsets = text_view(batch.column(1))
            for i, j in runs(offsets, RUN):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets[i : j + 1])), pa.array(counts(part.column(1), table))], ["id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, n_bytes long, n_tokens long")


def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
