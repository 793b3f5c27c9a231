"""Language identification with string kernels.

Kernel: the blended spectrum of presence. S(x) is the set of 1-, 2- and 3-grams of letter classes that occur
in the whole text; k(x, y) = |S(x) and S(y) both| / sqrt(|S(x)| |S(y)|). Nystroem: LANDMARKS training texts
stand for the kernel, phi(x) = k(x, landmarks) K^(-1/2). Classifier: kernel ridge regression, one language
versus the rest, on phi. Scoring: a batch's presence matrix times the landmarks' gives the kernel block, and
that times the weights gives all scores of the batch.

Characters: each lower-cased letter that the training texts hold is itself, other letters are one class, and
everything else is another. Training rows are a bounded sample of distinct texts: PER_LANG of a language (hash
order, so the same rows however the table is partitioned) as far as SAMPLE_CHARS, dealt evenly to the languages,
reach, and one text of a language at least; documents are always scored whole. The model has a column and the
driver a small row for each language that occurs.

Nulls and odd input: a null text or one without letters is `und` with score 0; a null lang is not learned
from; with no labelled rows every document is `und`; null ids are held in (not held out); equal rows and
further columns don't matter; a tie goes to the language first in the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import row_key, runs, text_view, without_rows

PER_LANG = 160
LANDMARKS = 160
SAMPLE_CHARS = 24_000_000
RIDGE = 1e-2
SHARPNESS = 6.0
UNKNOWN = "und"
BATCH = 256
#: Columns of a presence matrix: a batch takes BATCH + LANDMARKS times so many floats, however large the alphabet.
COLUMNS = 1 << 13


class Grams:
    """Codes of the distinct 1-, 2- and 3-grams of a text, over the letters of some texts."""

    def __init__(self, texts: list[str]):
        letters = sorted({c for t in texts for c in t.lower() if c.isalpha()})
        self.side = len(letters) + 2
        table = np.zeros(0x110000, np.int32)
        table[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
        table[[ord(c) for c in letters]] = np.arange(2, self.side)
        self.table = table

    def __call__(self, text: str) -> np.ndarray | None:
        """Sorted codes; None if the text has no letter. A gram is its characters' numbers in base `side`, the lengths one after another."""
        side = self.side
        own = self.table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not own.any():
            return None
        own = np.concatenate([[0], own, [0]]).astype(np.int64)
        pairs = own[:-1] * side + own[1:]
        if side**3 <= 1 << 24:
            seen = np.zeros(side**3, bool)
            seen[pairs[:-1] * side + own[2:]] = True
            three = np.flatnonzero(seen)
        else:
            three = np.unique(pairs[:-1] * side + own[2:])
        return np.concatenate([np.unique(own), side + np.unique(pairs), side + side * side + three])


class Model:
    """Landmark presence, its vocabulary and the weights from kernel to language scores."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.grams = Grams(texts)
        rows = [(g, y) for g, y in zip(map(self.grams, texts), langs, strict=True) if g is not None]
        self.langs = sorted({y for _, y in rows})
        if not rows:
            return
        by = {y: [g for g, z in rows if z == y] for y in self.langs}
        each = max(1, LANDMARKS // len(self.langs))
        marks = [g for y in self.langs for g in by[y][:each]]
        # The landmarks that hold each gram of theirs, gram by gram.
        every, own = np.concatenate(marks), np.repeat(np.arange(len(marks), dtype=np.int32), [len(g) for g in marks])
        order = np.argsort(every, kind="stable")
        self.vocab, first = np.unique(every[order], return_index=True)
        self.holders, self.edges = own[order], np.append(first, len(every))
        self.norms = np.sqrt([len(g) for g in marks], dtype=np.float32)
        k = self._kernel(marks).astype(float)
        values, vectors = np.linalg.eigh((k + k.T) / 2)
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        phi = self._kernel([g for g, _ in rows]).astype(float) @ root
        y = np.array([[1.0 if z == lang else -1.0 for lang in self.langs] for _, z in rows])
        weight = len(rows) / (len(self.langs) * np.array([sum(z == own for _, z in rows) for _, own in rows]))
        gram = (phi * weight[:, None]).T @ phi + RIDGE * len(rows) * np.eye(phi.shape[1]) * values.max() / len(marks) * 1e-2
        self.weights = (root @ np.linalg.solve(gram, (phi * weight[:, None]).T @ y)).astype(np.float32)

    def _kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel block of texts against landmarks: presence matrices of COLUMNS grams that occur, multiplied and added up."""
        parts = [np.zeros((0, len(self.norms)), np.float32)]
        for i in range(0, len(sets), BATCH):
            own = sets[i : i + BATCH]
            grams, row = np.concatenate(own), np.repeat(np.arange(len(own)), [len(g) for g in own])
            at = np.minimum(np.searchsorted(self.vocab, grams), len(self.vocab) - 1)
            known = self.vocab[at] == grams
            order = np.argsort(at[known], kind="stable")
            at, row = at[known][order], row[known][order]
            used, column = np.unique(at, return_inverse=True)
            shared = np.zeros((len(own), len(self.norms)), np.float32)
            for c in range(0, len(used), COLUMNS):
                block, low, high = used[c : c + COLUMNS], *np.searchsorted(column, [c, c + COLUMNS])
                texts, marks = (np.zeros((n, len(block)), np.float32) for n in shared.shape)
                texts[row[low:high], column[low:high] - c] = 1
                n = self.edges[block + 1] - self.edges[block]
                ends = np.cumsum(n)
                held = np.repeat(self.edges[block] - ends + n, n) + np.arange(ends[-1])
                marks[self.holders[held], np.repeat(np.arange(len(block)), n)] = 1
                shared += texts @ marks.T
            parts.append(shared / np.sqrt([len(g) for g in own], dtype=np.float32)[:, None])
        return np.concatenate(parts) / self.norms

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        sets = [self.grams(t) if t else None for t in texts]
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, g in enumerate(sets) if g is not None]
        if not known or not self.langs:
            return lang, score
        f = self._kernel([sets[i] for i in known]) @ self.weights
        e = np.exp(SHARPNESS * (f - f.max(axis=1, keepdims=True)).astype(float))
        best = f.argmax(axis=1)
        for i, b, s in zip(known, best.tolist(), (e.max(axis=1) / e.sum(axis=1)).tolist(), strict=True):
            lang[i], score[i] = self.langs[b], s
        return lang, score


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3 (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model:
    """Fit on the documents outside the held-out fold with a language.

    Texts come in hash order. Distinct rows of each language are counted first, so that a hash threshold leaves
    a bounded number of each; those are ranked and cut to the sample, which is all that comes to the driver.
    """
    pool = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.coalesce(fold(id_col), F.lit(0)) != 1))
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(text_col)), F.lit(1 << 40))
    slim = pool.select(F.col(lang_col).alias("lang"), draw.alias("draw"), F.col(text_col).cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in slim.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()}
    if not counts:
        return Model([], [])
    edges = [(lang, int(min(1.0, (1.7 * per_lang + 40) / max(1, n)) * (1 << 40))) for lang, n in counts.items()]
    few = slim.join(F.broadcast(docs.sparkSession.createDataFrame(edges, "lang string, edge long")), "lang").where("draw < edge")  # a row a language
    few = few.groupBy("lang", "draw").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("draw")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = few.withColumns({"rank": F.row_number().over(order), "before": before}).where((F.col("rank") <= per_lang) & ((F.col("before") + F.length("text") <= SAMPLE_CHARS // len(counts)) | (F.col("rank") == 1)))
    rows = sorted(few.select("lang", "draw", "text").collect())
    return Model([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keys: tuple = ()) -> DataFrame:
    """(id, lang_pred, score) of every document, then `keys` (columns of longs, see common.row_key)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the landmarks' grams: three at most for each of SAMPLE_CHARS characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            _, offs = text_view(batch.column(1))
            for i, j in runs(offs):
                part = batch.slice(i, j - i)
                lang, score = fitted.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), *part.columns[2:]], ["id", "lang_pred", "score", *part.schema.names[2:]])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *keys)
    return source.mapInArrow(run, ", ".join(["id long, lang_pred string, score double", *(f"{c} long" for c in source.columns[2:])]))


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return predict(docs, train(docs)).select(F.col("id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: Model, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose language is recognised with a score of `least` or more."""
    found = predict(docs, model, id_col, text_col, row_key(id_col, text_col))
    return without_rows(docs, id_col, text_col, found.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)))
