"""Every query with SQL gives the same rows as that SQL; every other query gives rows."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver

ORACLES = driver.oracle_sql()
QUERIES = driver.queries()


@pytest.fixture(scope="module")
def database(folder):
    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool) or isinstance(value, str):
        return str(value)
    return repr(round(float(value), 5) + 0.0)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, database, name):
    found = QUERIES[name](spark, folder)
    expected = database.execute(ORACLES[name])
    columns = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, found.collect()) == rows(columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() == 9
