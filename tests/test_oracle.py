"""Every registered query against its SQL. ``ORACLE_SF_DIR`` selects the tables."""

import os

import compare
import pytest

import __spark_entry__ as entry
from sparkplume.plans import catalog, oracle

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_names():
    assert set(SQL) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query(spark, con, name):
    assert compare.differences(entry.queries()[name](spark, SF), con, SQL[name]) == []


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["n"] > 0
