"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF_DIR = "/root/testdata/sf0.001"


def plain(v):
    return float(f"{float(v):.10g}") if isinstance(v, float) and not math.isnan(v) or hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if not n.startswith("op")))
def test_against_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    result = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in order]) for r in result.fetchall())


def test_every_query_without_sql_is_known():
    names = {n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"}
    assert names - set(__spark_entry__.oracle_sql()) == set()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
