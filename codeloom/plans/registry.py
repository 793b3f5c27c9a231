"""All registered queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

from codeloom.plans import corpus, evaluation

QUERIES = {**evaluation.QUERIES, **corpus.QUERIES}
ORACLES = {**evaluation.ORACLES, **corpus.ORACLES}
