"""The registered queries of this subpackage, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontaminate, language, licenses, periodic, pieces, secrets, shards, simhash, substrings, token_counts, token_files, topk, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": shards.shards_query,
    "op2_language": language.language_query,
    "op3_simhash": simhash.simhash_query,
    "op4_substrings": substrings.substrings_query,
    "op5_licenses": licenses.licenses_query,
    "op6_topk": topk.topk_query,
    "op7_pieces": pieces.pieces_query,
    "op8_secrets": secrets.secrets_query,
    "op9_token_files": token_files.token_files_query,
    "op10_decontamination": decontaminate.decontaminate_query,
    "op11_vector_codes": vector_codes.vector_codes_query,
    "op12_token_counts": token_counts.token_counts_query,
    "op13_periodic_runs": periodic.periodic_query,
}

ORACLES: dict[str, str] = {
    "op1_sharding": shards.ORACLE,
    "op4_substrings": substrings.ORACLE,
    "op6_topk": topk.ORACLE,
    "op8_secrets": secrets.ORACLE,
    "op10_decontamination": decontaminate.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op13_periodic_runs": periodic.ORACLE,
}
