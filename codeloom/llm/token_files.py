"""Token ids as binary files: frequency-ranked ids, byte-aligned variable length, separate control bytes.

File format (a folder):

* ``ids``     one row per document: id, token ids as little-endian integers (the encoder's output);
* ``vocab``   one row per token id that occurs: ``token``, ``rank`` (0 is the most frequent), ``n``;
* ``blocks``  Parquet rows ``part, block, first, doc_ids, lengths, control, data`` in ascending id order.
  ``control`` has two bits per id (bytes of the rank less one, four ids a byte, low bits first), ``data``
  the ranks' bytes, little-endian, ``lengths`` the ids per document, ``first`` the ids of the same part
  before the block.

Blocks hold whole documents and at least BLOCK_IDS ids but for the last of a part, so a task's memory is
one block and one Arrow batch. Parquet is only the container: Spark's commit protocol makes a lost
executor's files vanish and be written again.

Nulls and odd input: a null or empty text has the end id only; rows with a null id sort first; repeated rows
are kept as rows; an empty table gives empty files; columns besides id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import runs, shared_dir, text_view

BLOCK_IDS = 1 << 18
CACHE_ENTRIES = 600_000
#: Longer pieces are worked out each time they occur, so the cache's bytes are bounded.
CACHE_CHARS = 64
#: Bytes of text whose pieces are looked up together.
RUN = 8_000_000

#: White space next to white space or at an end, where pieces could differ from the library's pre-tokens.
_GAPS = r"^[\s\pZ\x{85}\x1c-\x1f]|[\s\pZ\x{85}\x1c-\x1f][\s\pZ\x{85}\x1c-\x1f]|[\s\pZ\x{85}\x1c-\x1f]$"
# The byte-level pre-tokens of pieces of Latin letters, digits, ASCII signs and line feeds; other pieces are cut by the library.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(f"[\\n!-~{_LETTERS}]*")
_KINDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\0 \\n0-9{_LETTERS}]+|\\n|\\0")


class _Encoder:
    """Encode with the tokenizers library, asking it once for each distinct pre-token.

    Texts are cut before each space and line feed; away from other white space the byte-level pre-tokenization
    cuts there too, so the ids of the pieces in order are the ids of the text. Distinct pieces of an Arrow
    batch are looked up, pre-tokens of new ones are merged by the library's model, and Arrow puts the ids
    together. Texts with white space next to white space or with an added token go to the library whole, and
    so does one other text of each run, to check the rest.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        cut = self.tok.pre_tokenizer.pre_tokenize_str
        self.space = cut(" a")[0][0][0]
        letters = ["\n", *(chr(c) for c in range(0xC0, 0x250) if c not in (0xD7, 0xF7))]
        self.letters = {b: w for c in letters for b, w in zip(c.encode(), cut(c)[0][0], strict=True)} | {0x20: self.space}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _merged(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens in the vocabulary's letters for bytes, from the library's own merge model."""
        found = list(map(self.tok.model.tokenize, words))
        raw = np.array([t.id for own in found for t in own], self.dtype).tobytes()
        ends = (np.cumsum(list(map(len, found)), dtype=np.int64) * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _mapped(self, word: str) -> str:
        """A pre-token in the vocabulary's letters for bytes."""
        if word.isascii() and word != "\n":
            return self.space + word[1:] if word[0] == " " else word
        return word.encode().decode("latin-1").translate(self.letters)

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces: what follows a space, or a line feed with what follows it."""
        cache, words = self.pieces, self.words
        for held in (cache, words):
            if len(held) > CACHE_ENTRIES:
                held.clear()
        cache[""] = b""
        new = [p for p in pieces if p not in cache]
        # One pre-token by any byte-level pattern.
        simple = [p for p in new if p.isascii() and p.isalpha()]
        cache.update(zip(simple, self._merged([self.space + p for p in simple]), strict=True))
        rest = [p for p in new if p not in cache]
        if _PLAIN.fullmatch("".join(rest)):
            odd = []
        else:
            odd, rest = [p for p in rest if not _PLAIN.fullmatch(p)], [p for p in rest if _PLAIN.fullmatch(p)]
        cut = _KINDS.findall("\0".join([p if p[0] == "\n" else " " + p for p in rest])) if rest else []
        missing = [w for w in dict.fromkeys(cut) if w not in words and w != "\0"]
        # Words of pieces that are whole pieces too are known by now.
        known = {w: cache[w[1:]] for w in missing if w[0] == " " and w[1:] in cache}
        unknown = [w for w in missing if w not in known]
        words.update(known)
        words.update(zip(unknown, self._merged([self._mapped(w) for w in unknown]), strict=True))
        own, at = [], 0
        for w in [*cut, "\0"] if rest else []:
            if w == "\0":
                cache[rest[at]] = b"".join(own)
                own, at = [], at + 1
            else:
                own.append(words[w])
        for p in odd:
            cache[p] = self.whole("\n") + self.whole(p[1:]) if p[0] == "\n" else self.whole(" " + p)
        found = [cache[p] for p in pieces]
        for p in [p for p in new if len(p) > CACHE_CHARS]:
            del cache[p]
        return found

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and the number of ids of each text; nulls are empty."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, _GAPS)
        for a in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, a))
        # A line feed before each text: its id makes room for the end id of the text before.
        marked = pc.replace_substring(pc.binary_join_element_wise("\n", pc.if_else(odd, "", texts), ""), "\n", " \n")
        lists = pc.split_pattern(marked, " ")
        flat = lists.flatten().dictionary_encode()
        pieces = pa.array(self._known(flat.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary()).take(flat.indices)
        raw, offs = text_view(pieces)
        ids = np.ascontiguousarray(raw).view(self.dtype).copy()
        starts = offs[lists.offsets.to_numpy()] // self.dtype.itemsize
        ids[starts[:-1]] = end
        ids = np.append(ids[1:], ids[:1])
        lengths = np.diff(starts)
        self._check(texts, odd, ids, lengths)
        return self._whole(texts, odd, ids, lengths, end)

    def _check(self, texts: pa.Array, odd: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """The first text that was put together from pieces must have the library's ids."""
        at = pc.index(odd, False).as_py()
        if at >= 0:
            begin = int(lengths[:at].sum())
            if ids[begin : begin + int(lengths[at]) - 1].tobytes() != self.whole(texts[at].as_py()):
                raise ValueError("encoding differs from the library's")

    def _whole(self, texts: pa.Array, odd: pa.Array, ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Put the ids of the texts that go to the library whole in their places."""
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(rows):
            return ids, lengths
        close = np.array([end], self.dtype)
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        for r in rows.tolist():
            parts[r] = np.append(np.frombuffer(self.whole(texts[r].as_py()), self.dtype), close)
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


def _binary(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Runs of the values, `lengths` of them in each, as bytes."""
    offs = np.concatenate([[0], np.cumsum(lengths)]) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): the token ids of each whole text and the end id, as little-endian integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer_path)
        for batch in batches:
            for i, j in runs(text_view(batch.column(1))[1], RUN):
                part = batch.slice(i, j - i)
                ids, n = enc(part.column(1), end_id)
                yield pa.RecordBatch.from_arrays([part.column(0), _binary(ids, n)], ["id", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, ids binary")


def count_ids(ids: DataFrame, dtype: np.dtype) -> DataFrame:
    """(token, n): occurrences of each id over all documents, summed within batches before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, _ = text_view(batch.column(0))
            n = np.bincount(np.frombuffer(raw.tobytes(), dtype)) if len(raw) else np.zeros(0, np.int64)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["token", "n"])

    return ids.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of non-negative integers below 2**32."""
    r = ranks.astype("<u4")
    size = 1 + (r > 0xFF) + (r > 0xFFFF) + (r > 0xFFFFFF)
    code = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    code[: len(r)] = size - 1
    quads = code.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    width = 4 if len(r) and r.max() > 0xFFFF else 2
    own = r if width == 4 else r.astype("<u2")
    data = own.view(np.uint8).reshape(-1, width)[np.arange(width) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


#: Bytes of each of the four ids that a control byte speaks of.
_SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
_KEEP = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n integers that `pack` wrote: sizes, then values, by table lookup."""
    size = _SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    value = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        value |= raw[at + k].astype(np.uint32) << np.uint32(8 * k)
    return value & _KEEP[size - 1]


_BLOCKS = "part int, block int, first long, total long, doc_ids array<long>, lengths binary, control binary, data binary"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode all documents and write them to `path` in ascending id order; returns the path.

    Texts are encoded once, where they are read; only packed ids are shuffled, by ranges of the id.
    The vocabulary's ranks (one row per token id, so bounded by the vocabulary) pass through the driver.
    """
    spark = docs.sparkSession
    enc = _encoder(tokenizer_path)
    dtype, size = enc.dtype, enc.tok.get_vocab_size(with_added_tokens=True) + 1
    encode(docs, tokenizer_path, end_id, id_col, text_col).write.option("compression", "zstd").parquet(f"{path}/ids")
    ids = spark.read.schema("id long, ids binary").parquet(f"{path}/ids")
    counts = sorted(((r["n"], r["token"]) for r in count_ids(ids, dtype).collect()), key=lambda x: (-x[0], x[1]))
    schema = "token long, rank long, n long"
    spark.createDataFrame([(t, i, n) for i, (n, t) in enumerate(counts)], schema).coalesce(1).write.parquet(f"{path}/vocab")
    rank = np.zeros(max(size, end_id + 1), np.uint32)
    rank[[t for _, t in counts]] = np.arange(len(counts), dtype=np.uint32)
    shared_rank = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, first, table = TaskContext.get().partitionId(), 0, 0, shared_rank.value
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # document ids, token ids, lengths

        def flush() -> pa.RecordBatch:
            nonlocal block, first
            docs, tokens, lengths = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            control, data = pack(table[tokens])
            row = [part, block, first, len(tokens), docs, lengths.astype("<u4").tobytes(), control, data]
            block, first = block + 1, first + len(tokens)
            held.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), None, pa.binary(), pa.binary(), pa.binary()]
            arrays = [pa.array([v], k) if k else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v, k in zip(row, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _BLOCKS.split(", ")])

        waiting = 0
        for batch in batches:
            raw, offs = text_view(batch.column(1))
            tokens, at = np.ascontiguousarray(raw).view(dtype), offs // dtype.itemsize
            i = 0
            while i < batch.num_rows:
                j = int(np.searchsorted(at, at[i] + BLOCK_IDS - waiting))  # the documents that fill the block
                full, j = j <= batch.num_rows, min(j, batch.num_rows)
                held.append((batch.column(0)[i:j], tokens[at[i] : at[j]], np.diff(at[i : j + 1])))
                waiting, i = waiting + int(at[j] - at[i]), j
                if full:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    # Equal rows, and rows of one or no id, are dealt to several parts too; their place in the file tells them apart.
    placed = ids.withColumns({"h": F.xxhash64("ids"), "place": F.monotonically_increasing_id()})
    ordered = placed.repartitionByRange("id", "h", "place").sortWithinPartitions("id", "h", "place").select("id", "ids")
    ordered.mapInArrow(run, _BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids binary): ids as little-endian unsigned 32-bit integers, read back from the files.

    `start` counts the ids of all documents before: a part's base comes from the totals of the parts (one
    small row for each), the rest from what the blocks say.
    """
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    vocab = spark.read.parquet(f"{path}/vocab").orderBy("rank").collect()
    token = spark.sparkContext.broadcast(np.array([r["token"] for r in vocab], "<u4"))
    totals = blocks.groupBy("part").agg(F.sum("total").alias("n")).orderBy("part").collect()
    base, bases = 0, []
    for r in totals:
        bases.append((r["part"], base))
        base += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token.value
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ids = table[unpack(row["control"], row["data"], int(lengths.sum()))]
                ends = np.cumsum(lengths)
                held = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32)), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(lengths), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + ends - lengths), pa.array(lengths), held],
                    ["part", "id", "at", "n_tokens", "ids"],
                )

    read = blocks.mapInArrow(run, "part int, id long, at long, n_tokens long, ids binary")
    offsets = spark.createDataFrame(bases, "part int, base long")  # a row for each part, whatever the input
    return read.join(F.broadcast(offsets), "part").select("id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark), public_tokenizers.path("byte_bpe_50k.json"), 0)
    back = read_token_files(spark, path)
    return back.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
