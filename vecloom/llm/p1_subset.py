"""A varied subset of each query's results: mini-batch k-means and quotas.

Records are clustered once by their vector and metadata features; the mini-batch k-means starts from rows far apart, is
fitted on a bounded sample (``SAMPLE_ROWS`` to ``SAMPLE_MOST``, with the data), keeps one centroid for each dense group,
and every record is assigned. A query's k places are shared among the clusters of its candidates in proportion to the
square root of the clusters' sizes (or equally) by highest averages: the j-th nearest candidate of a cluster of n
candidates has the claim sqrt(n) / j, and the k greatest claims win. A cluster that runs out of candidates has no
further claims, so its unused places go to the others. Within a cluster the nearest candidates win, as results are to
stay near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage as cut
from .common import stored_metadata, stored_vectors
from .p4_top_n import candidates
from .p6_rank_fusion import number
from .vectors import by_size, minibatch_kmeans, unit

#: Rows of the sample: one in ``SHARE``, at least and at most these.
SAMPLE_ROWS, SAMPLE_MOST, SHARE = 20_000, 160_000, 25
#: Clusters: one for so many records, at least ``CLUSTERS`` in all and ``OF_A_SIZE`` for each vector size if its sample
#: allows.
CLUSTERS, CLUSTER_ROWS, OF_A_SIZE = 128, 4_000, 4
#: Centroids of at least this cosine stand for one group, however many records it has.
SAME_GROUP = 0.9
#: Hashed category features (count, weight) beside the vector's; numeric fields get this weight each.
BUCKETS, CATEGORY_WEIGHT, NUMBER_WEIGHT = 16, 0.4, 0.2
NUMBERS = ("popularity", "recency", "rating")


def features(vectors: DataFrame) -> DataFrame:
    """(id, vector, category, n0, n1, n2, flag) of every stored record, metadata null where it is absent or of no use."""
    meta = F.from_json("metadata", "map<string,string>")
    fields = [number(F.try_element_at(meta, F.lit(f))).alias(f"n{i}") for i, f in enumerate(NUMBERS)]
    category = F.lower(F.trim(F.try_element_at(meta, F.lit("category"))))
    published = F.lower(F.get_json_object("metadata", "$.flags.published"))
    flag = F.when(published == "true", 1.0).when(published == "false", -1.0)
    return stored_vectors(vectors).join(stored_metadata(vectors), "id", "left").select("id", "vector", category.alias("category"), *fields, flag.alias("flag"))


def matrix(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(vector size, row numbers, features): the unit vector, one hashed category place, squashed numbers (0 if missing)."""
    import zlib

    category = batch.column("category").to_pylist()
    place = np.array([-1 if c is None else zlib.crc32(c.encode()) % BUCKETS for c in category], np.int64)
    column = lambda c: batch.column(c).to_numpy() if isinstance(batch, pa.Table) else batch.column(c).to_numpy(zero_copy_only=False)
    numbers = np.stack([column(c) for c in (*[f"n{i}" for i in range(len(NUMBERS))], "flag")], axis=1).astype(np.float64)
    numbers = np.where(np.isfinite(numbers), np.sign(numbers) * np.log1p(np.abs(numbers)), 0.0)
    numbers = (numbers / (1 + np.abs(numbers)) * NUMBER_WEIGHT).astype(np.float32)
    for d, rows, m in by_size(batch.column("vector")):
        one = np.zeros((len(rows), BUCKETS), np.float32)
        known = place[rows] >= 0
        one[np.flatnonzero(known), place[rows][known]] = CATEGORY_WEIGHT
        yield d, rows, np.concatenate([unit(m), one, numbers[rows]], axis=1)


def spread_start(m: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Rows far apart: each next one drawn with a chance proportional to its squared distance from the nearest so far."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(m)))]
    far = np.maximum(2 - 2 * (m @ m[chosen[0]]), 0).astype(np.float64)
    while len(chosen) < k and far.sum() > 1e-6:
        chosen.append(int(rng.choice(len(m), p=far / far.sum())))
        far = np.minimum(far, np.maximum(2 - 2 * (m @ m[chosen[-1]]), 0))
    return m[chosen]


def distinct_centroids(c: np.ndarray) -> np.ndarray:
    """Centroids without those of cosine ``SAME_GROUP`` to an earlier one: a dense group must not count as many."""
    kept: list[int] = []
    score = c @ c.T
    for i in range(len(c)):
        if not kept or score[i, kept].max() < SAME_GROUP:
            kept.append(i)
    return c[kept]


def fit_clusters(records: DataFrame, rows: int, k: int | None = None, sample_rows: int | None = None) -> dict[int, np.ndarray]:
    """Centroids by vector size from at most about ``sample_rows`` records chosen by a hash of the id."""
    sample_rows = sample_rows or min(SAMPLE_MOST, max(SAMPLE_ROWS, rows // SHARE))
    k = k or max(CLUSTERS, rows // CLUSTER_ROWS)
    share = min(1.0, sample_rows / max(rows, 1))
    sample = records.where(F.pmod(F.xxhash64(F.col("id"), F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000)).toArrow()
    parts = list(matrix(sample)) if sample.num_rows else []
    total = sum(len(m) for _, _, m in parts)
    out = {}
    for d, _, m in parts:
        n = max(1, min(k, max(OF_A_SIZE, round(k * len(m) / total)), len(m) // 8))
        m = m / np.linalg.norm(m, axis=1)[:, None]
        out[d] = distinct_centroids(minibatch_kmeans(m, n, start=spread_start(m, n)))
    return out


def assigned(centroids: dict[int, np.ndarray]):
    """A mapInArrow function from the features to (id, cluster)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, m in matrix(batch):
                c = centroids.get(d)
                best = np.zeros(len(m), np.int64) if c is None else (m @ c.T).argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array((np.int64(d) << 32) | best)], names=["id", "cluster"])

    return run


def record_clusters(vectors: DataFrame) -> DataFrame:
    """(id, cluster) of every stored record with a usable vector."""
    wide = cut(features(vectors))
    return wide.mapInArrow(assigned(fit_clusters(wide, wide.count())), "id string, cluster long")


def varied(queries: DataFrame, results: DataFrame, vectors: DataFrame, quota: str = "sqrt") -> DataFrame:
    """(query_id, place, id, cluster, dist): k varied candidates of each query, or all if there are fewer.

    ``quota`` is 'sqrt' or 'equal'. Candidates without a usable vector form one cluster of their own. Equal claims go to
    the nearer candidate, then the earlier arrival. Queries without candidates or with k = 0 have no rows. Groups of any
    size are counted and cut per cluster before they meet; no query's candidates are gathered.
    """
    if quota not in ("sqrt", "equal"):
        raise ValueError("quota must be 'sqrt' or 'equal'")
    found = candidates(queries, results).where("k > 0").join(record_clusters(vectors), "id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long")))
    found = cut(found.select("query_id", "k", "id", "cluster", "dist", "seq"))
    size = found.groupBy("query_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    most = found.agg(F.max("k")).first()[0] or 1
    inside = F.row_number().over(Window.partitionBy("query_id", "cluster").orderBy("dist", "seq"))
    # no query takes more than k of one cluster; the constant bound lets each task cut its rows before the exchange
    first = found.withColumn("j", inside).where(F.col("j") <= int(most)).where("j <= k")
    weight = F.sqrt("n") if quota == "sqrt" else F.lit(1.0)
    claims = first.join(size, ["query_id", "cluster"]).withColumn("claim", weight / F.col("j"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("claim").desc(), "dist", "seq"))
    return claims.withColumn("place", place).where(F.col("place") <= int(most)).where("place <= k").select("query_id", F.col("place").cast("int").alias("place"), "id", "cluster", "dist")


def p1_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r, v = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("queries", "search_results", "vectors"))
    return varied(q.where("rerank_method = 'diversity'"), r, v)
