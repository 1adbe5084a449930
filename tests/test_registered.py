"""Every registered query against its SQL, or, where it has none, that it runs and covers its rows."""

import os

import pytest

import __spark_entry__ as entry_point
import oracle

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", list(entry_point.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    found = oracle.spark_rows(entry_point.queries()[name](spark, FOLDER))
    assert oracle.difference(found, oracle.sql_rows(con, entry_point.oracle_sql()[name])) is None


@pytest.mark.parametrize("name", sorted(set(entry_point.queries()) - set(entry_point.oracle_sql())))
def test_runs(spark, name):
    columns, rows = oracle.spark_rows(entry_point.queries()[name](spark, FOLDER))
    assert columns and rows


def test_every_sql_belongs_to_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
