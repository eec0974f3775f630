import numpy as np
import pytest

from vecloom.functions.metrics import METRICS
from vecloom.operators.graph import communities, connected_components, relationships
from vecloom.operators.rerank import diversity, rerank, weighted


@pytest.mark.parametrize("name, t", [("euclidean", 1.2), ("cosine", 0.3), ("manhattan", 2.0)])
def test_relationships_equal_brute_force(spark, monkeypatch, name, t):
    import vecloom.operators.graph as g
    from vecloom.functions.metrics import METRICS

    monkeypatch.setattr(g, "BLOCK_ROWS", 15)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(70, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, str(i % 2), [float(v) for v in r]) for i, r in enumerate(x)] + [(90, "0", None), (91, "0", []), (92, "0", [0.0] * 4)], "id int, partition_id string, vector array<float>")
    d = METRICS[name].pairs
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if d(x[i : i + 1].astype(float), x[j : j + 1].astype(float))[0] <= t}
    zero = {(i, 92) for i in range(70) if name != "cosine" and d(x[i : i + 1].astype(float), np.zeros((1, 4)))[0] <= t}
    got = {(r.id_a, r.id_b) for r in relationships(df, t, name, scope="global").collect()}
    assert got == want | zero
    inside = {(r.id_a, r.id_b) for r in relationships(df, t, name).collect()}
    assert inside == {(i, j) for i, j in want | zero if i % 2 == j % 2}


def test_threshold_is_checked(spark):
    df = spark.createDataFrame([], "id int, partition_id string, vector array<float>")
    with pytest.raises(ValueError):
        relationships(df, 0)
    assert relationships(df, 1.0).isEmpty() and communities(df, 1.0).isEmpty()


@pytest.mark.parametrize("name,t", [("euclidean", 0.5), ("cosine", 0.05), ("manhattan", 2.0), ("squared_euclidean", 0.25), ("chebyshev", 0.2), ("hamming", 5)])
def test_cells_and_blocks_lose_nothing(spark, monkeypatch, name, t):
    from vecloom.operators import graph

    rng = np.random.default_rng(2)
    c = 3 * rng.normal(size=(12, 8))
    m = (c[rng.integers(0, 12, 300)] + 0.12 * rng.normal(size=(300, 8))).round(1).astype(np.float32)
    df = spark.createDataFrame([(int(i), f"p{i % 2}", x.tolist()) for i, x in enumerate(m)], "id int, partition_id string, vector array<float>").repartition(4)
    v = m.astype(np.float64)
    d = METRICS[name].block(v, v)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if METRICS[name].pairs(v[i : i + 1], v[j : j + 1])[0] <= t}
    assert len(want) > 200 and len(d) == 300
    for pivot_rows, block_rows in ((2_048, 16_384), (10, 16_384), (10, 9), (2_048, 40)):
        monkeypatch.setattr(graph, "PIVOT_ROWS", pivot_rows)
        monkeypatch.setattr(graph, "BLOCK_ROWS", block_rows)
        got = [(r.id_a, r.id_b) for r in relationships(df, t, name, "global").collect()]
        assert len(got) == len(set(got)) and set(got) == want, (pivot_rows, block_rows)
        got = [(r.id_a, r.id_b) for r in relationships(df, t, name).collect()]
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in want if i % 2 == j % 2}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    got = {r.id: r.community for r in connected_components(spark.createDataFrame(chain, "id_a int, id_b int")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_communities_keep_partitions_apart(spark):
    df = spark.createDataFrame([("a", 1, [0.0]), ("a", 2, [0.1]), ("b", 1, [0.0]), ("b", 2, [0.1]), ("b", 3, [0.2])], "partition_id string, id int, vector array<float>")
    got = {(r.partition_id, r.id, r.community) for r in communities(df, 0.15).collect()}
    assert got == {("a", 1, 1), ("a", 2, 1), ("b", 1, 1), ("b", 2, 1), ("b", 3, 1)}


VECTORS = [[0.1, 0.2, 0.3], [0.4, 0.5, 0.6], [0.7, 0.8, 0.9], [0.2, 0.3, 0.4], [0.5, 0.6, 0.7]]


@pytest.fixture(scope="module")
def results(spark):
    meta = [(5, 2), (10, 1), (2, 8), (6, 4), (4, 5)]
    rows = [(0, i + 1, i + 1, (i + 1) / 10, f'{{"popularity": {p}, "recency": {r}}}') for i, (p, r) in enumerate(meta)]
    records = spark.createDataFrame([(i + 1, v) for i, v in enumerate(VECTORS)], "id int, vector array<float>")
    return spark.createDataFrame(rows, "query_id int, rank int, id int, dist double, metadata string"), records


def test_diversity(results):
    res, records = results
    got = [r.id for r in diversity(res.drop("metadata"), records, balance=0.5).orderBy("rank").collect()]
    assert got[0] == 1 and sorted(got) == [1, 2, 3, 4, 5] and got != [1, 2, 3, 4, 5]
    v, d, chosen = np.array(VECTORS, np.float32).astype(float), np.arange(1, 6) / 10, [0]
    while len(chosen) < 5:
        s = [-9 if i in chosen else 0.5 / (1 + d[i]) + 0.5 * min(np.linalg.norm(v[i] - v[j]) for j in chosen) for i in range(5)]
        chosen.append(int(np.argmax(s)))
    assert got == [c + 1 for c in chosen]
    assert [r.id for r in diversity(res.drop("metadata"), records.where("id = 99"), 2).orderBy("rank").collect()] == [1, 2]


def test_weighted(results):
    res, _ = results
    got = weighted(res, {"popularity": 0.1, "recency": 0.05}, 3).orderBy("rank").collect()
    assert got[0].id == 2 and len(got) == 3 and abs(got[0].weighted_score - (0.2 - 1.0 - 0.05)) < 1e-12
    assert [r.id for r in rerank(res, "weighted", k=2).orderBy("rank").collect()] == [1, 2]
    with pytest.raises(ValueError):
        rerank(res, "nonsense")
