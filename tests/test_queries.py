"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, rows_of
from shelfmark.workload import REGISTRY

FOLDER = "/root/testdata/sf0.001"
ORACLE = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(REGISTRY) <= set(ORACLE)
    assert set(ORACLE) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_its_sql(spark, engine, name):
    frame = entry_points.queries()[name](spark, FOLDER)
    got = rows_of(frame.columns, frame.collect())
    cursor = engine.execute(ORACLE[name])
    columns = [cell[0] for cell in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert got == rows_of(columns, cursor.fetchall())
