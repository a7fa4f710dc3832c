"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.QUERIES))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

    result = sql.execute(entry.oracle_sql()[name])
    sql_columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(sql_columns)
    expected = result.fetchall()
    order = sorted(df.columns)

    def table(columns, rows):
        at = [columns.index(c) for c in order]
        return sorted(tuple(comparable(r[i]) for i in at) for r in rows)

    assert table(df.columns, df.collect()) == table(sql_columns, expected)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
