import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import cluster
from vecloom.operators.index.hnsw import SmallWorldIndex
from vecloom.operators.index.ivf import ClusterIndex
from vecloom.operators.index.lsh import SignHash, SignHashIndex
from vecloom.operators.index.pq import ProductQuantizer, suggested_subvectors
from vecloom.operators.search import batch_nearest, nearest

BLOBS = [(f"close-{i}", i, [1 + 0.1 * i, 2 + 0.1 * i, 3 + 0.1 * i, 4 + 0.1 * i]) for i in range(3)] + [(f"far-{i}", 3 + i, [10.0 + i, 20.0 + i, 30.0 + i, 40.0 + i]) for i in range(3)]


@pytest.fixture(scope="module")
def blobs(spark):
    return spark.createDataFrame([("p", *b) for b in BLOBS], "partition_id string, id string, seq bigint, vector array<float>").cache()


@pytest.fixture(scope="module")
def clumps(spark):
    rng = np.random.default_rng(5)
    c = rng.normal(size=(20, 16))
    rows = [("a" if i % 3 else "b", i, [float(x) for x in c[i % 20] + 0.25 * rng.normal(size=16)]) for i in range(600)]
    return spark.createDataFrame(rows, "partition_id string, id int, vector array<float>").repartition(3).cache()


def recall(df, index_search, k=10, n=12):
    hit = 0
    for r in df.where(F.col("id") < n).collect():
        want = {x.id for x in nearest(df, r.vector, k).collect()}
        hit += len(want & {x.id for x in index_search(r.vector, k).collect()})
    return hit / (n * k)


def test_kmeans(spark, blobs):
    c = cluster.kmeans(blobs, 2)
    got = cluster.assign(blobs, c)
    sides = {r.id[0]: r.cluster_id for r in got.collect()}
    assert c.count() == 2 and sides["c"] != sides["f"]
    assert cluster.kmeans(blobs.limit(2), 5).count() == 2
    assert cluster.kmeans(blobs.where("false"), 3).count() == 0
    assert cluster.assign(blobs, c.where("false")).where("cluster_id IS NOT NULL").isEmpty()


def test_centroids_and_stats(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (1, [1.1, 2.1, 3.1, 4.1]), (None, [9.0] * 4), (2, None)], "cluster_id int, vector array<float>")
    row = cluster.centroids_of(df).collect()
    assert len(row) == 1 and row[0]["size"] == 2 and np.allclose(row[0].centroid, [1.05, 2.05, 3.05, 4.05], atol=1e-3)
    s = cluster.cluster_stats(df, cluster.centroids_of(df).select("cluster_id", "centroid")).first()
    assert s["size"] == 2 and abs(s.radius - 0.1) < 1e-3


def test_leaders(blobs):
    one = cluster.leader_clusters(blobs, threshold=100.0, cluster_size=10)
    assert one.select("cluster_id").distinct().count() == 1
    assert cluster.leader_clusters(blobs, threshold=5.0).select("cluster_id").distinct().count() == 2
    assert cluster.leader_clusters(blobs, threshold=0.01, max_clusters=3).select("cluster_id").distinct().count() == 3
    assert cluster.leader_clusters(blobs, threshold=100.0, cluster_size=2, size_factor=1.0).select("cluster_id").distinct().count() == 3


def test_ivf(spark, clumps, tmp_path):
    index = ClusterIndex.build(clumps, 10)
    assert recall(clumps, index.search) == 1
    assert recall(clumps, lambda q, k: index.search(q, k, nprobe=4)) >= 0.9
    index.save(str(tmp_path / "ivf"))
    again = ClusterIndex.load(spark, str(tmp_path / "ivf"))
    plan = again.search([0.0] * 16, 3, nprobe=2)._jdf.queryExecution().toString()
    assert recall(clumps, again.search, n=3) == 1 and "PartitionFilters: [(cluster_id" in plan


def test_lsh(spark, clumps, tmp_path):
    index = SignHashIndex.build(clumps, tables=16, hashes=6, buckets=64)
    assert recall(clumps, lambda q, k: index.search(q, k, probes=1)) >= 0.9
    assert index.buckets.count() == 16 * 600 and index.stats().count() == 16
    index.save(str(tmp_path / "lsh"))
    again = SignHashIndex.load(clumps, str(tmp_path / "lsh"))
    assert again.model.probes([1.0] * 16, 2) == index.model.probes([1.0] * 16, 2)
    assert SignHashIndex.build(clumps.where("false")).search([0.0] * 16, 3).isEmpty()
    assert SignHash(hashes=200).hashes == 31


def test_pq(spark, clumps, tmp_path):
    pq = ProductQuantizer.train(clumps, subvectors=8, clusters=64)
    coded = pq.encode(clumps)
    assert {len(r.code) for r in coded.select("code").collect()} == {8} and pq.compression_ratio() == 8
    assert recall(clumps, lambda q, k: pq.search(coded, q, k, exact_from=60)) >= 0.9
    q = np.arange(16) / 10
    m = np.array([r.vector for r in clumps.limit(5).collect()], float)
    c = pq.codes(m)
    assert np.allclose(pq.tables(q)[np.arange(8), c].sum(1), ((pq.decode(c) - q) ** 2).sum(1))
    pq.save(spark, str(tmp_path / "pq"))
    assert np.array_equal(ProductQuantizer.load(spark, str(tmp_path / "pq")).codes(m), c)
    odd = spark.createDataFrame([(1, [1.0]), (2, None)], "id int, vector array<float>")
    assert pq.encode(odd).where("code IS NOT NULL").isEmpty()
    with pytest.raises(ValueError):
        ProductQuantizer.train(odd.where("false"))
    assert suggested_subvectors(64) == 8


def test_hnsw(spark, clumps, tmp_path, monkeypatch):
    import vecloom.operators.index.hnsw as h

    monkeypatch.setattr(h, "SHARD_ROWS", 150)
    index = SmallWorldIndex.build(clumps, m=12, ef_construction=60)
    assert index.shards.select("partition_id", "shard").distinct().count() > 2
    assert recall(clumps, lambda q, k: index.search(q, k, ef_search=60)) >= 0.9
    q = clumps.where("id = 1").first().vector
    assert index.search(q, 1).first().id == 1
    assert index.remove(spark.createDataFrame([(1,)], "id int")).search(q, 1).first().id != 1
    only = clumps.where("id IN (3, 4)")
    assert {r.id for r in index.search(q, 5, where=only).collect()} == {3, 4}
    assert {r.partition_id for r in index.search(q, 5, partition_ids=["b"]).collect()} == {"b"}
    assert index.search([0.0], 3).isEmpty()
    index.save(str(tmp_path / "graph"))
    again = SmallWorldIndex.load(spark, str(tmp_path / "graph"))
    assert [r.id for r in again.search(q, 5).collect()] == [r.id for r in index.search(q, 5).collect()]
    s = index.stats().where("level = 0").agg(F.sum("nodes").alias("n")).first()
    assert s.n == 600 and index.edge_table().where("src = dst").isEmpty()


def test_hnsw_takes_inserts_and_deletes(spark, clumps):
    half = SmallWorldIndex.build(clumps.where("id < 300"), m=12, ef_construction=60)
    grown = half.insert(clumps.where("id >= 300"))
    assert recall(clumps, lambda q, k: grown.search(q, k, ef_search=60)) >= 0.9
    assert grown.stats().where("level = 0").agg(F.sum("nodes")).first()[0] == 600
    # an id written again is found at its new place only
    far = clumps.where("id = 7").withColumn("vector", F.transform("vector", lambda x: x + 100))
    moved = grown.insert(far)
    q = clumps.where("id = 7").first().vector
    assert 7 not in [r.id for r in moved.search(q, 5).collect()] and moved.search([x + 100 for x in q], 1).first().id == 7
    # many deletions: the next insert builds the shard anew
    fewer = moved.remove(clumps.where("id % 2 = 0")).insert(clumps.where("id = 8"))
    assert {r.id % 2 for r in fewer.search(q, 20, ef_search=80).collect()} <= {1} | {r.id % 2 for r in clumps.where("id = 8").collect()}
    assert fewer.stats().where("level = 0").agg(F.sum("nodes")).first()[0] < 600


def test_batches_through_indexes(spark, clumps):
    q = clumps.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("qvector"))
    want = {(r.query_id, r.id) for r in batch_nearest(clumps, q, 5).collect()}
    ivf = ClusterIndex.build(clumps, 10)
    lsh = SignHashIndex.build(clumps, tables=16, hashes=6, buckets=64)
    pq = ProductQuantizer.train(clumps, subvectors=8, clusters=64)
    graph = SmallWorldIndex.build(clumps, m=12, ef_construction=60)
    for found in (ivf.batch_search(q, 5, nprobe=4), lsh.batch_search(q, 5, probes=1), pq.batch_search(pq.encode(clumps), q, 5, exact_from=60), graph.batch_search(q, 5, ef_search=60)):
        got = {(r.query_id, r.id) for r in found.collect()}
        assert len(got & want) >= 0.9 * len(want) and len(got) <= len(want)
    assert {(r.query_id, r.id) for r in ivf.batch_search(q, 5, nprobe=10).collect()} == want
