"""Every registered query of the library against its SQL in DuckDB, at sf0.001."""

import decimal
import math
import os

import duckdb
import pytest

from veilspark import registry

registry.load()
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{os.path.join(sf, t)}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_equals_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    want = duck.sql(registry.SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_marginals_take_one_scan(spark, sf):
    text = registry.QUERIES["all_marginals_grouping_sets"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and text.count("Expand") == 1
