"""Registered queries against their SQL counterparts on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle

NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, sf, name):
    problem = oracle.compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), sf)
    assert problem == "" or problem.startswith("EMPTY")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
