"""Cluster-pruned search: records stored by nearest centroid, queries search the clusters nearest to them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.metrics import METRICS, metric
from ..cluster import assign
from ...session import cut_lineage
from ..search import nearest, nearest_in_cells
from .pq import TRAIN_ROWS, lloyd


def _nearest_clusters(ids: list[int], vectors: list[np.ndarray], name: str, query: Sequence[float], nprobe: int) -> list[int]:
    m = METRICS[name]
    q = np.asarray(query, np.float64)
    d = [m.block(q[None, : len(v)], v[None, : len(q)])[0, 0] * (-1 if m.similarity else 1) for v in vectors]
    return [ids[i] for i in np.argsort(d, kind="stable")[:nprobe]]


class ClusterIndex:
    """``records`` have a cluster_id; a scan partitioned by it is pruned to the clusters a query probes."""

    def __init__(self, records: DataFrame, centroids: DataFrame):
        self.records, self.centroids = records, centroids
        local = centroids.orderBy("cluster_id").collect()
        self.ids = [r.cluster_id for r in local]
        self.vectors = [np.asarray(r.centroid, np.float64) for r in local]

    @classmethod
    def build(cls, records: DataFrame, clusters: int, seed: int = 1, vector: str = "vector", id: str = "id") -> ClusterIndex:
        """Centroids of a k-means on at most ``TRAIN_ROWS`` records, the first by a hash of the id; every record is then
        assigned. Fewer distinct vectors than clusters are the centroids themselves; an empty table has none."""
        rows = records.where(F.size(vector) > 0)
        if rows.select(F.size(vector)).distinct().limit(2).count() > 1:
            raise ValueError("a cluster index needs vectors of one size")
        sample = rows.orderBy(F.xxhash64(id, F.lit(seed)), id).limit(TRAIN_ROWS).select(F.col(vector).cast("array<double>").alias("v")).collect()
        m = np.array([r.v for r in sample]) if sample else np.zeros((0, 0))
        distinct = np.unique(m, axis=0) if len(m) else m
        centers = distinct if len(distinct) <= clusters else lloyd(m, clusters, 25, 1e-3, np.random.default_rng(seed))
        c = records.sparkSession.createDataFrame([(i, len(x), [float(y) for y in x]) for i, x in enumerate(centers)], "cluster_id int, dim int, centroid array<float>")
        return cls(cut_lineage(assign(records, c, vector=vector).drop("centroid_dist")), cut_lineage(c))

    def save(self, path: str) -> None:
        self.records.write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/records")
        self.centroids.write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark, path: str) -> ClusterIndex:
        return cls(spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/centroids"))

    @classmethod
    def load_or_build(cls, records: DataFrame, path: str, clusters: int, **options) -> ClusterIndex:
        """The saved index, or one built and saved now if there is none."""
        spark = records.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/centroids/_SUCCESS")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            cls.build(records, clusters, **options).save(path)
        return cls.load(spark, path)

    def probed(self, query: Sequence[float], nprobe: int, metric_name: str = "euclidean") -> list[int]:
        return _nearest_clusters(self.ids, self.vectors, metric(metric_name).name, query, nprobe)

    def probes(self, queries: DataFrame, nprobe: int, metric_name: str = "euclidean") -> DataFrame:
        """``queries`` (query_id, qvector, ...) with a row and cluster_id for each of their ``nprobe`` nearest clusters."""

        ids, vectors, name = self.ids, self.vectors, metric(metric_name).name

        @F.pandas_udf("array<int>")
        def near(v: pd.Series) -> pd.Series:
            return v.map(lambda x: [] if x is None else _nearest_clusters(ids, vectors, name, x, nprobe))

        return queries.withColumn("cluster_id", F.explode(near("qvector")))

    def batch_search(self, queries: DataFrame, k: int = 10, nprobe: int = 4, metric_name: str = "euclidean", **options) -> DataFrame:
        """(query_id, rank, partition_id, id, dist) of many queries: clusters and the queries that probe them meet by key."""
        return nearest_in_cells(self.records.where(F.col("cluster_id").isNotNull()), self.probes(queries, nprobe, metric_name), "cluster_id", k, metric_name, **options)

    def search(self, query: Sequence[float], k: int = 10, nprobe: int | None = None, metric_name: str = "euclidean", **options) -> DataFrame:
        """Exact among the ``nprobe`` nearest clusters; None searches all, and records without a cluster always."""
        rows = self.records
        if nprobe is not None and nprobe < len(self.ids):
            rows = rows.where(F.col("cluster_id").isin(self.probed(query, nprobe, metric_name)) | F.col("cluster_id").isNull())
        return nearest(rows, query, k, metric_name, **options)
