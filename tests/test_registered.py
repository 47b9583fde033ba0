"""Every registered query against its SQL in DuckDB, at the smallest scale, and without cross joins."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point
from ledgerleaf.registry.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    columns = sorted(frame.columns)
    rows = sorted(tuple(plain(row[c]) for c in columns) for row in frame.collect())
    result = duck.execute(ORACLES[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == columns
    expected = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert rows == expected
    assert rows


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0
