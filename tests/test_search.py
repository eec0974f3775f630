import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions.filters import JsonFields, compile_filter
from vecloom.operators.search import batch_nearest, distinct_queries, nearest, similar_to

AXES = [(1, [1.0, 0.0, 0.0], "x"), (2, [0.0, 1.0, 0.0], "y"), (3, [0.0, 0.0, 1.0], "z"), (4, [0.7, 0.7, 0.0], "xy")]


@pytest.fixture(scope="module")
def axes(spark):
    return spark.createDataFrame([(i, i, v, f'{{"category": "{c}"}}', "p") for i, v, c in AXES], "id int, seq int, vector array<float>, metadata string, partition_id string").cache()


def ids(df):
    return [r.id for r in df.collect()]


def test_axis_vectors(axes):
    assert ids(nearest(axes, [0.8, 0.8, 0], 2)) == [4, 1]
    assert ids(nearest(axes, [0.5, 0.5, 0], 2, "cosine"))[0] == 4
    assert ids(nearest(axes, [0.8, 0.8, 0], 5, where={"category": "xy"})) == [4]
    assert ids(nearest(axes, [0.8, 0.8, 0], 2, where=compile_filter({"category": "z"}, JsonFields("metadata")))) == [3]
    assert ids(nearest(axes, [1, 0, 0], 2, offset=1)) == [4, 2]
    assert ids(nearest(axes, [1, 0, 0], 0)) == []
    assert ids(nearest(axes, [1, 0, 0], 5, partition_ids=["other"])) == []


def test_sizes_and_bad_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 5.0]), (3, None), (4, [float("nan"), 0.0]), (5, [])], "id int, vector array<float>")
    assert ids(nearest(df, [1.0, 0.0], 9)) == [1, 2, 5]
    assert ids(nearest(df, [1.0, 0.0], 9, "cosine")) == [1]
    assert ids(nearest(df, [1.0, 0.0], 9, exact_size=True)) == [1]


@pytest.mark.parametrize("name", ["euclidean", "cosine", "dot", "manhattan"])
def test_batch_equals_single(spark, name):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6 if i % 7 else 4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, vector array<float>").repartition(3)
    qs = [rows[i][1] for i in (0, 5, 9)]
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(qs)] + [(99, None)], "query_id int, qvector array<double>")
    got = batch_nearest(df, queries, 5, name).orderBy("query_id", "rank").collect()
    for i, q in enumerate(qs):
        assert [r.id for r in got if r.query_id == i] == ids(nearest(df, q, 5, name))
    assert not [r for r in got if r.query_id == 99]


def test_ties_and_copies(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in (5, 3, 9, 1)], "id int, vector array<float>")
    q = spark.createDataFrame([(0, [1.0, 1.0], 2)], "query_id int, qvector array<double>, k int")
    assert [r.id for r in batch_nearest(df, q).orderBy("rank").collect()] == [1, 3]
    assert [r.id for r in similar_to(df, [1], 2).orderBy("rank").collect()] == [3, 5]


def test_blocks_of_queries(spark, monkeypatch):
    import vecloom.operators.search as s

    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(30)], "id int, vector array<float>")
    q = df.select(F.col("id").alias("query_id"), F.col("vector").alias("qvector"))
    whole = {(r.query_id, r.rank): r.id for r in batch_nearest(df, q, 3).collect()}
    monkeypatch.setattr(s, "QUERY_BLOCK", 7)
    assert {(r.query_id, r.rank): r.id for r in batch_nearest(df, q, 3).collect()} == whole and len(whole) == 90


def test_partitions_per_query(spark, axes):
    df = axes.withColumn("partition_id", F.when(F.col("id") < 3, "a").otherwise("b"))
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0], ["b"]), (1, [1.0, 0.0, 0.0], []), (2, [1.0, 0.0, 0.0], None)], "query_id int, qvector array<double>, partition_ids array<string>")
    got = batch_nearest(df, q, 1)
    assert {r.query_id: r.id for r in got.collect()} == {0: 4, 1: 1, 2: 1}


def test_distinct_queries(spark):
    q = spark.createDataFrame([(1, [1.0], 3), (2, [1.0], 3), (3, [2.0], 3)], "query_id int, qvector array<double>, k int")
    once, all_of = distinct_queries(q)
    assert once.count() == 2 and {(r.query_id, r.as_query) for r in all_of.collect()} == {(1, 1), (2, 1), (3, 3)}


def test_empty(spark):
    df = spark.createDataFrame([], "id int, vector array<float>")
    q = spark.createDataFrame([(0, [1.0])], "query_id int, qvector array<double>")
    assert batch_nearest(df, q, 3).isEmpty() and batch_nearest(df, q.where("false"), 3).isEmpty() and nearest(df, [1.0], 3).isEmpty()


@pytest.mark.parametrize("name,scale,kind", [("euclidean", 1.0, "float"), ("squared_euclidean", 24_000.0, "double"), ("euclidean", 24_000.0, "double"), ("dot", 24_000.0, "double"), ("cosine", 1.0, "double")])
def test_near_copies_are_told_apart(spark, name, scale, kind):
    rng = np.random.default_rng(11)
    base = scale * rng.normal(size=24) / np.sqrt(24)
    m = base + scale * 1e-7 * rng.normal(size=(400, 24))
    m = m.astype(np.float32) if kind == "float" else m
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], f"id int, vector array<{kind}>").repartition(2)
    q = df.where("id < 40").select(F.col("id").alias("query_id"), F.col("vector").alias("qvector"))
    got = {}
    for r in batch_nearest(df, q, 5, name).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.dist)
    v = m.astype(np.float64)
    for i in range(40):
        d = {"euclidean": lambda: np.sqrt(((v - v[i]) ** 2).sum(1)), "squared_euclidean": lambda: ((v - v[i]) ** 2).sum(1), "dot": lambda: -(v * v[i]).sum(1), "cosine": lambda: 1 - np.clip((v * v[i]).sum(1) / np.sqrt((v * v).sum(1) * (v[i] @ v[i])), -1, 1)}[name]()
        want = np.sort(d)[:5] * (-1 if name == "dot" else 1)
        assert np.allclose(got[i], want, rtol=1e-12, atol=1e-15), i
