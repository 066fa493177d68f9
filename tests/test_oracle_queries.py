"""Every registered query with an oracle SQL must match DuckDB on the
driver's small tables (sf0.001 here; the driver checks sf0.01)."""

import os

import pytest

import __spark_entry__ as E
from oracle import compare, duck

SF = os.environ.get("TABLAB_TEST_SF", "/root/testdata/sf0.001")
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    ok, msg = compare(df, con, SQL[name])
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "column_name" in df.columns
