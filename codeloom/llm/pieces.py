"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Each text is one symbol per character; an agenda holds the adjacent pairs whose joined string is a piece, best
score first and leftmost first among equals; the best pair is merged and its new neighbours go on the agenda
until none is left. Symbols that are no piece fall back to bytes. The agendas of all new short stretches of a
batch are rows of one matrix of scores, so that a step takes the best pair of every stretch at once (a heap for
each takes about twice the CPU); a long stretch has a heap, whose cost grows with n log n.

No merge crosses a pair of characters that no piece contains side by side, so texts are cut before each
space (no piece has a space after another character; a vocabulary with such pieces is refused) and a chunk
further at every such pair. Distinct chunks are merged once in a worker; the new chunks of each Arrow batch
are encoded by the sentencepiece library too, and a difference raises.

Decoding looks every id's text up, byte pieces as bytes; a text of ids whose bytes are no UTF-8, or with an
unknown id, is decoded by the library. One text of each run is decoded by both, and a difference raises.

Nulls and odd input: a null text is encoded as the empty text (end id only); equal rows are kept; columns
besides id and text are passed through untouched where the caller selects them; an empty table gives none.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import runs, text_view

META = "▁"
CACHE_ENTRIES = 300_000
#: New chunks that are worked out together.
LEARNED = 40_000
#: Longer chunks are worked out each time they occur, so the cache's bytes are bounded.
CACHE_CHARS = 64
#: Bytes of text whose chunks are looked up together.
RUN = 3_000_000
#: Up to so many characters the agendas of a batch's stretches are rows of a matrix; rows of one matrix.
SHORT, ROWS = 32, 4096
_SIDE, _GONE, _NONE = 24, -2, np.iinfo(np.int32).max
_CHUNK = re.compile(" +[^ ]*")
#: Texts whose chunks aren't just what is between spaces.
_ODD = f"^$|^ |  |{META}"
#: Runs of letters with the spaces before them, or single other characters.
_RUN = re.compile(rf"{META}*[^\W\d_]+|{META}+|[\W\d_]", re.S)


class PairTable:
    """Values of non-negative 64-bit keys, found for many keys at once; -1 for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(8 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        self.probes = 0
        while len(keys):
            slot = self._slot(keys)
            free = np.flatnonzero(self.keys[slot] < 0)
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values = keys[left], values[left]
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (mixed.astype(np.int64) + self.probes) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        for probe in range(1, self.probes):
            more = np.nonzero((there != keys) & (there >= 0))
            if not len(more[0]):
                break
            slot[more] = (slot[more] + 1) & ((1 << self.bits) - 1)
            there[more] = self.keys[slot[more]]
            out[more] = np.where(there[more] == keys[more], self.values[slot[more]], -1)
        return out


class Pieces:
    """A loaded vocabulary with its encoder and decoder."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(re.search(f"[^{META}]{META}", text[i]) for i in plain):
            raise ValueError("pieces with a space inside aren't supported")
        ids = {text[i]: i for i in plain}
        place = {score: r for r, score in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = [place.get(sp.get_score(i), 0) for i in range(n)]
        # Symbols are pieces, by their ids, and the characters of pieces that are none themselves, from n on.
        chars = sorted({c for p in ids for c in p} - set(ids))
        self.symbols = ids | {c: n + i for i, c in enumerate(chars)}
        self.size = n
        self.pairs = {self.symbols[p[:k]] << _SIDE | self.symbols[p[k:]]: i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in self.symbols and p[k:] in self.symbols}
        self.bytes = {int(text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        self.side = {a + b for p in ids for a, b in zip(p, p[1:], strict=False)}
        self.table = PairTable(np.array(list(self.pairs), np.int64), np.array(list(self.pairs.values()), np.int32))
        self.ranks = np.array(self.rank, np.int32)
        self.of_char = -3 - np.arange(0x110000, dtype=np.int32)  # characters that no piece has
        for c, x in self.symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = x
        self.cache: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        # The bytes of each id; n further on, without the space that a text begins with.
        raw = [b""] * n
        for i in plain:
            raw[i] = text[i].replace(META, " ").encode()
        for b, i in self.bytes.items():
            raw[i] = bytes([b])
        self.raw = pa.array(raw + [x[1:] if x[:1] == b" " and i not in self.bytes.values() else x for i, x in enumerate(raw)], pa.binary())
        self.checked = np.zeros(n, bool)  # ids whose texts the library may have to decode
        self.checked[[*self.bytes.values(), self.unknown]] = True

    def merge(self, text: str) -> list[int]:
        """Ids of one stretch of characters by the agenda of adjacent pairs.

        An entry is the rank of a pair's piece and the place of its left symbol, in one number; it holds if
        the pair at that place still has that rank.
        """
        pair, rank, n = self.pairs.get, self.rank, len(text)
        sym = [self.symbols.get(c, -1) for c in text]  # no pair has -1
        shift = n.bit_length()
        low = (1 << shift) - 1
        agenda = [rank[p] << shift | i for i, (a, b) in enumerate(zip(sym, sym[1:], strict=False)) if (p := pair(a << _SIDE | b)) is not None]
        heapify(agenda)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            entry = heappop(agenda)
            i = entry & low
            j = right[i]
            if j == n or (new := pair(sym[i] << _SIDE | sym[j])) is None or rank[new] != entry >> shift:
                continue  # one of them has been merged meanwhile
            sym[i], sym[j] = new, _GONE
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (p := pair(new << _SIDE | sym[k])) is not None:
                    heappush(agenda, rank[p] << shift | i)
            if (h := left[i]) >= 0 and (p := pair(sym[h] << _SIDE | new)) is not None:
                heappush(agenda, rank[p] << shift | h)
        if self.bytes and (-1 in sym or max(sym) >= self.size):
            return [x for c, s in zip(text, sym, strict=True) if s != _GONE for x in ((s,) if 0 <= s < self.size else [self.bytes[b] for b in c.encode()])]
        return [s if 0 <= s < self.size else self.unknown for s in sym if s != _GONE]

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pieces that pairs of symbols make, or _NONE."""
        found = self.table.find(a.astype(np.int64) << _SIDE | b)
        return np.where((a >= 0) & (b >= 0) & (found >= 0), self.ranks[found], _NONE)

    def merge_all(self, stretches: list[str]) -> dict[str, bytes]:
        """Ids of distinct stretches: the agendas of short ones are worked off together, row by row of a matrix."""
        out = {t: array("i", self.merge(t)).tobytes() for t in stretches if len(t) > SHORT}
        stretches = sorted((t for t in stretches if len(t) <= SHORT), key=len)
        for i in range(0, len(stretches), ROWS):
            own = stretches[i : i + ROWS]
            size = np.array([len(t) for t in own])
            width = int(size[-1])
            sym = np.full((len(own), width + 1), _GONE, np.int32)
            sym[np.arange(width + 1) < size[:, None]] = self.of_char[np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)]
            done = np.full_like(sym, _GONE)
            score = self._pair(sym[:, :-1], sym[:, 1:])
            row, cols = np.arange(len(own)), np.arange(width)
            while len(row):
                best = score.argmin(axis=1)
                live = score[np.arange(len(row)), best] < _NONE
                done[row[~live]] = sym[~live]
                row, sym, score, best = row[live], sym[live], score[live], best[live]
                at = np.arange(len(row))
                new = self.table.find(sym[at, best].astype(np.int64) << _SIDE | sym[at, best + 1])
                shift = cols + (cols > best[:, None])
                sym[:, :-1] = np.take_along_axis(sym, shift, 1)
                sym[:, -1] = _GONE
                sym[at, best] = new
                score = np.take_along_axis(score, np.minimum(shift, width - 1), 1)
                score[:, -1] = _NONE
                score[at, best] = self._pair(new, sym[at, best + 1])
                lead = np.flatnonzero(best)
                score[lead, best[lead] - 1] = self._pair(sym[lead, best[lead] - 1], new[lead])
            here = done != _GONE
            rare = (here & ((done < 0) | (done >= self.size))).any(axis=1).tolist()
            raw, ends = done[here].astype("<i4").tobytes(), (4 * np.cumsum(here.sum(axis=1))).tolist()
            for t, a, b, odd in zip(own, [0, *ends], ends, rare, strict=False):
                out[t] = array("i", self.merge(t)).tobytes() if odd else raw[a:b]
        return out

    def stretches(self, chunk: str) -> list[str]:
        """A chunk cut between pairs of characters that no piece has side by side."""
        side, out, held = self.side, [], ""
        for run in _RUN.findall(chunk):
            if held and held[-1] + run[0] not in side:
                out.append(held)
                held = run
            else:
                held += run
        return [*out, held]

    def _learn(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of chunks by the agenda, checked against the library.

        The chunks, joined by spaces, are one text to the library; its ids must be ours in a row.
        """
        parts, cut = self.parts, {k: self.stretches(META + k.replace(" ", META)) for k in ("-", *keys)}
        new = self.merge_all([t for t in {t: None for own in cut.values() for t in own} if t not in parts])
        parts.update(new)
        found = {k: b"".join([parts[t] for t in own]) for k, own in cut.items()}
        for t in [t for t in new if len(t) > CACHE_CHARS]:
            del parts[t]
        dash = found["-"] if "-" in keys else found.pop("-")
        blank = [k for k in keys if not k.strip(" ")]  # these would run into the next
        for group in ([k for k in keys if k.strip(" ")], *[[k] for k in blank]):
            ours = dash + b"".join([found[k] for k in group])
            if array("i", self.sp.encode("-" + "".join([" " + k for k in group]))).tobytes() != ours:
                raise ValueError("encoding differs from the library's")
        return found

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks, without the space before them."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        if len(self.parts) > CACHE_ENTRIES // 2:
            self.parts.clear()
        cache = self.cache
        cache[META] = array("i", [self.end]).tobytes()  # stands for the end of a text
        found = list(map(cache.get, chunks))
        if new := [c for c, ids in zip(chunks, found, strict=True) if ids is None]:
            for i in range(0, len(new), LEARNED):
                cache.update(self._learn(new[i : i + LEARNED]))
            found = [cache[c] for c in chunks]
            for c in [c for c in new if len(c) > CACHE_CHARS]:
                del cache[c]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and the number of ids of each; nulls are empty."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, _ODD)
        lists = pc.split_pattern(pc.binary_join_element_wise(pc.if_else(odd, "", texts), META, " "), " ")
        flat = lists.flatten().dictionary_encode()
        chunks = pa.array(self._known(flat.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary()).take(flat.indices)
        raw, offs = text_view(chunks)
        ids = np.ascontiguousarray(raw).view("<i4")
        starts = offs[lists.offsets.to_numpy()] // 4
        lengths = np.diff(starts)
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        if rows:
            parts = np.split(ids, starts[1:-1])
            for r in rows:
                text = texts[r].as_py().replace(META, " ")
                own = [c[1:] for c in _CHUNK.findall(" " + text)] if text else []
                distinct = list(dict.fromkeys(own))
                table = dict(zip(distinct, self._known(distinct), strict=True))
                parts[r] = np.frombuffer(b"".join([table[c] for c in own]) + array("i", [self.end]).tobytes(), "<i4")
            ids, lengths = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, lengths

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """The texts of runs of ids."""
        ends = np.cumsum(lengths)
        starts = ends - lengths
        at = ids.astype(np.int64)
        at[starts[lengths > 0]] += len(self.raw) // 2
        raw, offs = text_view(self.raw.take(pa.array(at)))
        cuts = offs[np.append(starts, len(ids))] if len(ids) else np.zeros(len(lengths) + 1, np.int64)
        texts = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
        rare = np.flatnonzero(np.add.reduceat(np.append(self.checked[ids], False), starts) > 0) if len(lengths) else []
        own: dict[int, bytes] = {}
        for r in rare:
            part = ids[starts[r] : ends[r]]
            try:
                texts[r].as_py().decode()
                plain = not (part == self.unknown).any()
            except UnicodeDecodeError:
                plain = False
            if not plain:
                own[int(r)] = self.sp.decode(part.tolist()).encode()
        if own:
            texts = pa.array([own.get(i, t) for i, t in enumerate(texts.to_pylist())], pa.binary())
        if len(lengths) and self.sp.decode(ids[: ends[0]].tolist()).encode() != texts[0].as_py():
            raise ValueError("decoding differs from the library's")
        return texts.cast(pa.string())


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int> with the end id, decoded): a narrow map, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(model_path)
        for batch in batches:
            for i, j in runs(text_view(batch.column(1))[1], RUN):
                part = batch.slice(i, j - i)
                ids, n = model.encode(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, model.decode(ids, n)], ["id", "ids", "decoded"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, ids array<int>, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what encode_decode gives."""
    return encoded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast(T.ArrayType(T.StringType())), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def pieces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model")))
