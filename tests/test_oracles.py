"""Every query with SQL agrees with that SQL run by DuckDB on the same tables."""

import math

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from tests.conftest import SMALL, TABLES


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return connection


def text(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    result = queries()[name](spark, sf_dir)
    cursor = duck.execute(oracle_sql()[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(result.columns) == sorted(columns)
    order = sorted(columns)
    ours = sorted("|".join(text(row[c]) for c in order) for row in result.collect())
    places = [columns.index(c) for c in order]
    theirs = sorted("|".join(text(row[i]) for i in places) for row in cursor.fetchall())
    assert ours == theirs


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
