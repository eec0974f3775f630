"""Clustering of records: k-means, leader clustering in arrival order, assignment, centroids and their statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import METRICS, euclidean, metric, norm

#: Most centroids whose vectors are sent to every task; more need the metric's nearest centroid by a blocked search.
MAX_CENTROIDS = 20_000


def kmeans(records: DataFrame, k: int, max_iter: int = 20, tolerance: float = 1e-3, seed: int = 1, vector: str = "vector") -> DataFrame:
    """(cluster_id, dim, centroid) of a k-means over records of one size; at most k clusters.

    With k or fewer distinct vectors these are the centroids. Distances are squared Euclidean. Null and empty vectors are
    ignored; an empty table has no centroids.
    """
    rows = records.where(F.size(vector) > 0).select(F.col(vector).cast("array<double>").alias("v"))
    # the first rows usually show more than k distinct vectors; only otherwise are all compared
    few = rows.limit(4 * (k + 1)).distinct().limit(k + 1).collect() if k else []
    if len(few) <= k:
        few = rows.distinct().limit(k + 1).collect() if k else []
    spark = records.sparkSession
    if len({len(r.v) for r in few}) > 1 or rows.select(F.size("v")).distinct().limit(2).count() > 1:
        raise ValueError("k-means needs vectors of one size")
    if len(few) <= k:
        centers = [list(r.v) for r in sorted(few, key=lambda r: list(r.v))]
    else:
        model = KMeans(k=k, maxIter=max_iter, tol=tolerance, seed=seed, featuresCol="f").fit(rows.select(array_to_vector("v").alias("f")))
        centers = [c.tolist() for c in model.clusterCenters()]
    return spark.createDataFrame([(i, len(c), [float(x) for x in c]) for i, c in enumerate(centers)], "cluster_id int, dim int, centroid array<float>")


def assign(records: DataFrame, centroids: DataFrame, metric_name: str = "euclidean", vector: str = "vector") -> DataFrame:
    """``records`` with cluster_id and centroid_dist of the nearest centroid of the same size (null if there is none).

    Ties go to the lower cluster_id. The number of centroids is checked before their vectors go to the tasks.
    """
    local = centroids.where("centroid IS NOT NULL").select("cluster_id", F.col("centroid").cast("array<double>").alias("c")).orderBy("cluster_id").limit(MAX_CENTROIDS + 1).collect()
    if len(local) > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids: search them with batch_nearest instead")
    groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in {len(r.c) for r in local}:
        same = [r for r in local if len(r.c) == n]
        groups[n] = np.array([r.cluster_id for r in same]), np.array([r.c for r in same], np.float64)
    m = METRICS[metric(metric_name).name]
    sign = -1.0 if m.similarity else 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best, dist = np.full(len(batch), None, object), np.full(len(batch), np.nan)
            sizes = np.array([-1 if v is None else len(v) for v in batch[vector]])
            for n, (ids, c) in groups.items():
                rows = np.flatnonzero(sizes == n)
                if len(rows):
                    v = np.stack([np.asarray(x, np.float64) for x in batch[vector].iloc[rows]])
                    d = m.block(v, c)
                    at = (sign * d).argmin(1)
                    best[rows], dist[rows] = ids[at], m.pairs(v, c[at])
            yield batch.assign(cluster_id=pd.array(best, "Int32"), centroid_dist=dist)

    kept = records.drop("cluster_id", "centroid_dist")
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + ", cluster_id int, centroid_dist double"
    return kept.mapInPandas(run, schema).withColumn("centroid_dist", F.when(F.col("cluster_id").isNotNull(), F.col("centroid_dist")))


def centroids_of(records: DataFrame, key: str = "cluster_id", vector: str = "vector", dim: bool = True) -> DataFrame:
    """(key, dim, size, centroid): mean vector of each cluster and size, component by component with partial sums."""
    rows = records.where(F.col(key).isNotNull() & (F.size(vector) > 0)).withColumn("dim", F.size(vector))
    parts = rows.select(key, "dim", F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    means = parts.groupBy(key, "dim", "i").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("size"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return means.groupBy(key, "dim").agg(F.max("size").alias("size"), ordered.alias("centroid"))


def cluster_stats(records: DataFrame, centroids: DataFrame, vector: str = "vector") -> DataFrame:
    """(cluster_id, dim, size, centroid_norm, radius): members counted now, the farthest member's distance as radius."""
    near = records.join(centroids.select("cluster_id", "centroid"), "cluster_id")
    sized = near.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.max(euclidean(F.col(vector), F.col("centroid"))).alias("radius"))
    return centroids.select("cluster_id", F.size("centroid").alias("dim"), norm(F.col("centroid")).alias("centroid_norm")).join(sized, "cluster_id", "left").select("cluster_id", "dim", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"), "centroid_norm", "radius")


def _leaders(size: int, factor: float, threshold: float, most: int, metric_name: str, vector: str):
    m = METRICS[metric(metric_name).name]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq", kind="stable")
        centers = np.zeros((0, 0))
        counts: list[int] = []
        out = np.zeros(len(group), np.int32)
        for i, v in enumerate(group[vector]):
            v = np.asarray(v, np.float64)
            if not counts:
                centers, counts = v[None].copy(), [1]
                continue
            d = m.block(v[None], centers)[0]
            best = int(d.argmin())
            if len(counts) < most and (counts[best] >= size * factor or d[best] > threshold):
                centers, best = np.vstack([centers, v]), len(counts)
                counts.append(1)
            else:
                counts[best] += 1
                centers[best] += (v - centers[best]) / counts[best]
            out[i] = best
        return group.drop(columns=[vector]).assign(cluster_id=out)

    return run


def leader_clusters(records: DataFrame, cluster_size: int = 100, size_factor: float = 1.5, threshold: float = 0.5, max_clusters: int = 1000, metric_name: str = "euclidean", vector: str = "vector") -> DataFrame:
    """(partition_id, id, seq, dim, cluster_id): clusters grown in arrival order within each partition and vector size.

    A record joins the nearest centroid, which then moves to the mean of its members, unless that cluster is full
    (``cluster_size * size_factor``) or farther than ``threshold``; then it starts a cluster, up to ``max_clusters``.
    Arrival order makes this sequential: one group per partition and size, bounded by the partition's capacity.
    """
    rows = records.where(F.size(vector) > 0).select("partition_id", "id", "seq", F.size(vector).alias("dim"), F.col(vector).alias("vector"))
    return rows.groupBy("partition_id", "dim").applyInPandas(_leaders(cluster_size, size_factor, threshold, max_clusters, metric_name, "vector"), f"partition_id string, id {dict(rows.dtypes)['id']}, seq bigint, dim int, cluster_id int")
