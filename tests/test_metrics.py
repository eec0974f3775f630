import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions.metrics import METRICS, database_distance, metric, norm, normalized, vector_literal

A, B = [1.0, -2.0, 3.5, 0.0], [0.5, 2.0, 3.5, -1.0]


@pytest.mark.parametrize("name", sorted(METRICS))
def test_column_equals_kernel(spark, name):
    m = metric(name)
    got = spark.range(1).select(m.column(vector_literal(A), vector_literal(B)).alias("d")).first().d
    a, b = np.array([A]), np.array([B])
    assert math.isclose(got, m.pairs(a, b)[0], abs_tol=1e-12)
    assert math.isclose(got, m.block(a, b)[0, 0], abs_tol=1e-9)


def test_names():
    assert metric("L2").name == "euclidean" and metric("dotProduct").name == "dot" and metric("INNER").name == "inner"
    assert metric("infinity").name == "chebyshev" and metric("squared").name == "squared_euclidean" and metric("nonsense").name == "euclidean"


def test_guards(spark):
    row = spark.range(1).select(
        database_distance("cosine", vector_literal([0.0, 0.0]), vector_literal([1.0, 2.0])).alias("zero"),
        database_distance("cosine", vector_literal([1.0]), vector_literal([1.0, 2.0])).alias("sizes"),
        database_distance("euclidean", vector_literal([3.0]), vector_literal([0.0, 4.0])).alias("penalised"),
        METRICS["euclidean"].column(vector_literal([3.0]), vector_literal([0.0, 4.0])).alias("plain"),
        METRICS["cosine"].column(vector_literal([1.0]), vector_literal([2.0, 4.0])).alias("truncated"),
        METRICS["chebyshev"].column(vector_literal([]), vector_literal([])).alias("empty"),
        METRICS["euclidean"].column(F.lit(None).cast("array<double>"), vector_literal([1.0])).alias("null"),
    ).first()
    assert row.zero == 1 and row.sizes == 1 and row.plain == 3 and row.truncated == 0 and row.empty == 0 and row.null is None
    assert math.isclose(row.penalised, math.sqrt(9.01))


def test_normalized(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(normalized(F.col("v")).alias("u"), norm(F.col("v")).alias("n"))
    assert [(r.u, r.n) for r in df.collect()] == [([0.6, 0.8], 5.0), ([0.0, 0.0], 0.0)]


def test_axioms():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 6))
    for name in ("euclidean", "manhattan", "chebyshev", "hamming"):
        d = METRICS[name].block(x, x)
        assert np.allclose(d, d.T, atol=1e-6) and np.all(d[:, :, None] <= d[:, None, :] + d.T[None] + 1e-6)


def test_own_metric(spark):
    from vecloom.functions import metrics as m
    from vecloom.operators.index.hnsw import SmallWorldIndex
    from vecloom.operators.search import batch_nearest, nearest

    own = m.register("canberra", lambda a, b: (np.abs(a - b) / np.maximum(np.abs(a) + np.abs(b), 1e-12)).sum(1))
    try:
        rng = np.random.default_rng(0)
        v = rng.random((80, 6))
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, vector array<double>")
        want = np.argsort(own.pairs(np.broadcast_to(v[3], v.shape), v), kind="stable")[:5].tolist()
        assert [r.id for r in nearest(df, v[3].tolist(), 5, "canberra").collect()] == want
        q = df.where("id = 3").selectExpr("id AS query_id", "vector AS qvector")
        assert [r.id for r in batch_nearest(df, q, 5, "canberra").orderBy("rank").collect()] == want
        assert [r.id for r in SmallWorldIndex.build(df, "canberra").search(v[3].tolist(), 5).collect()] == want
        with pytest.raises(ValueError):
            m.register("l2", own.pairs)
    finally:
        del m.METRICS["canberra"]
