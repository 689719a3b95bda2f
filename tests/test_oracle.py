"""Each query against its SQL on the smallest tables."""

import pytest

from corpusq.plans import registry

from .oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, small, con, name):
    assert_same(registry.QUERIES[name](spark, small), con.sql(registry.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_rows(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() >= 1


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
