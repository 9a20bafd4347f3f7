"""Every query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry

QUERIES = {n: q for plan in entry.PLANS for n, q in plan.QUERIES.items()}
ORACLES = {n: q for plan in entry.PLANS for n, q in plan.ORACLES.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, equal_to_oracle):
    equal_to_oracle(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).limit(5).collect()


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "rank", "bm25"]


def test_llm_queries_come_with_their_subpackage():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
