"""Every query that has SQL, against DuckDB, on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 150


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    diff, _ = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert diff is None, diff


def test_entry(spark):
    assert entry.entry(spark).count() == 4
