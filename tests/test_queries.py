"""Every core query against its SQL on the smallest tables; those without SQL must run."""

import pytest
from conftest import same

from graphweir.plans import core_queries, eval_queries, graph_queries, library_queries, profile_queries, retrieval_queries, text_queries, vector_queries

MODULES = (core_queries, graph_queries, retrieval_queries, vector_queries, text_queries, eval_queries, profile_queries, library_queries)
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
ORACLES = {n: q for m in MODULES for n, q in m.ORACLES.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, small, name):
    same(QUERIES[name](spark, small), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
