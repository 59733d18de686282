"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

ORACLE_SF = os.environ.get("FLOWLAB_ORACLE_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return connect(ORACLE_SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    problem, *_ = compare(spark, ORACLE_SF, name, entry.queries()[name], entry.oracle_sql()[name], con)
    assert problem is None, problem


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["section", "item", "n", "percent"]
    assert df.count() > 5


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
