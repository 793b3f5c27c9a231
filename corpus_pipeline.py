"""Corpus pipeline: language ID, near-dedup, decontamination, secret redaction, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
for the next. All but the last return the columns of documents. Each works on all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontaminate, language, pieces, secrets, simhash
from codeloom.llm.common import materialise

#: Documents with no letters, or whose best language scores less, are rejected.
LEAST_LANGUAGE_SCORE = 0.3
PIECES = "piece_bpe_32k.model"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised; the model is fitted on this stage's own input.

    A null or empty text, or one without letters, has no language and goes; a null lang is not learned from;
    without labelled rows all go; null ids and repeated rows are judged by their texts; no rows give none.
    Languages and their numbers are those of language.predict, whose rows this stage filters.
    """
    return language.keep_known(docs, language.train(docs), LEAST_LANGUAGE_SCORE)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate class, the one with the least id (null ids last).

    Of repeated rows one stays; null and empty texts are one class; equal ids go by hashes of text and columns;
    no rows give none.
    """
    return simhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more is benchmark windows.

    Null and empty texts have no words and stay; rows are told apart by id and text, so repeated rows go or stay
    together and a null id takes no other row along; an empty benchmark or table changes nothing.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents with secrets and linked weak parts redacted; n_chars follows the text.

    Null and empty texts stay as they are; null ids and repeated rows are kept, equal rows alike; no rows give none.
    """
    return secrets.redact(docs, chars_col="n_chars")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text is encoded as the empty one (end id only); null ids and repeated rows are kept; no rows give none.
    """
    encoded = pieces.encode_decode(docs, public_tokenizers.path(PIECES))
    return pieces.digest(encoded)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("sentencepiece", pieces_stage),
]

#: Kernels, SimHash and merges are beyond SQL; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
