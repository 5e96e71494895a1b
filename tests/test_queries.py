"""Every registered query runs; those with SQL give the same rows in DuckDB."""

import os

import pytest

from tests.compare import DATA, connection, rows
from webloom import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    found = QUERIES[name](spark, DATA)
    frame = found.toPandas()
    assert list(frame.columns) == found.columns
    if name in SQL:
        columns, got = rows(frame)
        expected_columns, expected = rows(con.sql(SQL[name]).df())
        assert columns == expected_columns
        assert got == expected


def test_every_twin_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark).toPandas()
    assert list(frame.columns) == ["place", "doc_id", "title", "score", "passage"]
    assert len(frame)
