"""Every registered query against its SQL in DuckDB."""

import __spark_entry__ as E
import pytest
from oracle import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_query_has_sql():
    assert set(E.QUERIES) == set(E.ORACLE)


@pytest.mark.parametrize("name", sorted(E.QUERIES))
def test_query(spark, sf, con, name):
    assert compare(E.queries()[name](spark, sf), con, E.oracle_sql()[name]) == ""


def test_compare_sees_differences(spark, con):
    one = spark.sql("SELECT 1L AS a, 2.5D AS b")
    assert compare(one, con, "SELECT 1 AS a, CAST(2.5 AS DOUBLE) AS b") == ""
    assert compare(one, con, "SELECT 1 AS a, CAST(2.6 AS DOUBLE) AS b")
    assert compare(one, con, "SELECT 1 AS x, CAST(2.5 AS DOUBLE) AS b")
    assert compare(one, con, "SELECT 1 AS a, CAST(2.5 AS DOUBLE) AS b UNION ALL SELECT 1, 2.5")


def test_entry(spark):
    assert E.entry(spark).count() == 5
