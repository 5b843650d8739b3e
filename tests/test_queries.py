"""Every registered query runs on the small tables and equals its check SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, compare


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, sf, name):
    ok, note, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), sf)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
