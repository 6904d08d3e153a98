"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import connect, difference, duck_result, spark_result

import __spark_entry__ as entry
from gapweave import catalog

QUERIES = catalog.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, folder, con, name):
    got = spark_result(QUERIES[name](spark, folder))
    assert got[1], "no rows"
    if name in SQL:
        assert difference(got, duck_result(con, SQL[name])) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "host"
    assert df.count() > 0


def test_all_queries_have_sql():
    assert set(QUERIES) <= set(SQL)
