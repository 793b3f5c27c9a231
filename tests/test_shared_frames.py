"""Lines and orders are joined once in queries that use the joined records more than once."""

import pytest

from codeloom.plans import corpus
from codeloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["harmonise", "null_slice_metrics"])
def test_results_come_from_settled_records(spark, name):
    assert "Relation [" not in _plan(QUERIES[name](spark, SF))


def test_bundles_are_written_from_settled_records(spark, monkeypatch):
    plans, write = [], corpus.I.write_split_bundle
    monkeypatch.setattr(corpus.I, "write_split_bundle", lambda p, r, c, root: plans.extend(map(_plan, (p, r, c))) or write(p, r, c, root))
    QUERIES["split_bundle"](spark, SF)
    assert len(plans) == 3 and not any("Relation [" in p for p in plans)


def test_codes_are_divided_as_doubles(spark):
    from codeloom.plans.views import view

    assert "decimal" not in _plan(view(spark, SF, "eval_lines").select("gold_code"))
