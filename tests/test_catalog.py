"""The catalogue's queries against DuckDB on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from vecloom.plans import catalog

duckdb = pytest.importorskip("duckdb")


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isnan(a) and math.isnan(b) or abs(a - b) < 1e-9
    return a == b


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    if name not in entry.oracle_sql():
        assert got
        return
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=str)
    assert len(got) == len(rows) and all(same(x, y) for a, b in zip(got, rows) for x, y in zip(a, b))


def test_entry(spark, sf):
    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark, sf):
    """Filters, partitions and columns reach the scan; top-k needs no full sort."""
    from vecloom.operators.search import nearest

    v = spark.read.parquet(f"{sf}/vectors.parquet")
    plan = nearest(v, [0.0] * 64, 5, partition_ids=["p-dunormi"])._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "In(partition_id" in plan.replace("EqualTo(partition_id", "In(partition_id") and "metadata" not in plan.split("ReadSchema")[1]
