"""Every registered query with a SQL twin gives the same rows as DuckDB on the same tables."""

import pytest

import __spark_entry__ as entry
from conftest import SF_DIR
from oracle_check import compare, duck

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    ok, why, _ = compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name])
    assert ok, why


def test_flagship_runs(spark):
    assert entry.entry(spark).count() == 5
