import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import token_counts
from codeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
BYTES, WORDS, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def library(name, texts):
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return [len(x) for x in SentencePieceProcessor(model_file=P.path(name)).encode(texts)]
    from tokenizers import Tokenizer

    return [len(Tokenizer.from_file(P.path(name)).encode(t, add_special_tokens=False).ids) for t in texts] if len(texts) < 50 else [len(e.ids) for e in Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]


def test_query_against_the_library(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_token_counts"](spark, SF).collect()}
    want = dict(zip(docs, library(BYTES, list(docs.values())), strict=True))
    assert got == {i: (i, len(t.encode()), want[i], want[i] > 1024) for i, t in docs.items()}


def test_odd_strings_with_and_without_a_table():
    rng = random.Random(5)
    parts = [*"abst'\n\t.!12é½Ⅷ²日​\x85\xa0\x1c्", "'s", "'re", "'ll", "'d ", "'ve", "  ", "\r\n", "<|endoftext|>", "'s's", " the", " ", "🙂", "　"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(4000)] + ["'", "'s", "''s", " 's", "　　x", "x　"]
    counts = token_counts.Counts(P.path(BYTES))
    want = library(BYTES, texts)
    none = token_counts.Table([], [])
    assert counts(pa.array(texts), none).tolist() == want
    short = [w for w in counts.cache if len(w) <= token_counts.WIDEST]
    table = token_counts.Table(short, [counts.cache[w] for w in short])
    counts.cache.clear()
    assert counts(pa.array(texts), table).tolist() == want and all(len(w) > token_counts.WIDEST for w in counts.cache)


def test_long_texts_are_worked_through_in_parts(monkeypatch):
    text = " ".join(f"word{i % 97} it's  \n{i}" for i in range(9000)) + " é" * 500 + "x" * 5000
    counts, none = token_counts.Counts(P.path(BYTES)), token_counts.Table([], [])
    want = library(BYTES, [text])
    assert counts(pa.array([text, None, "", text]), none).tolist() == [*want, 0, 0, *want]
    monkeypatch.setattr(token_counts, "RUN", 4000)
    assert len(token_counts.with_parts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), 1000)) > 50
    assert counts(pa.array([text, None, "", text]), none).tolist() == [*want, 0, 0, *want]


@pytest.mark.parametrize("name", [BYTES, WORDS, PIECES])
def test_odd_rows_for_every_kind_of_file(spark, name):
    texts = ["Hello there", None, "", "no id", "x" * 30_000, "tied", "tied", "a <|endoftext|> b", "word " * 20_000]
    rows = [(1, texts[0]), (2, None), (3, ""), (None, texts[3]), (4, texts[4]), (5, "tied"), (5, "tied"), (6, texts[7]), (7, texts[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "n_bytes", "n_tokens", "word", "n")})
    want = sorted(zip([r[0] for r in rows], [len((t or "").encode()) for t in texts], library(name, [t or "" for t in texts]), strict=True), key=str)
    assert sorted(map(tuple, token_counts.count_tokens(docs, P.path(name)).collect()), key=str) == want
    assert token_counts.count_tokens(docs.limit(0), P.path(name)).count() == 0
