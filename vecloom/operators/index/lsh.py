"""Sign-hash index: tables of random hyperplanes, buckets as rows, candidates by an equality join."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.metrics import MISMATCH_PENALTY, database_distance, metric
from ..search import nearest

#: Bits of a bucket number; further hyperplanes are not used.
MAX_BITS = 31


class SignHash:
    """Seeded hyperplanes for every vector size; a bucket number is the sign bits modulo ``buckets``."""

    def __init__(self, tables: int = 8, hashes: int = 10, buckets: int = 1024, seed: int = 5):
        self.tables, self.hashes, self.buckets, self.seed = tables, min(hashes, MAX_BITS), buckets, seed

    def planes(self, dim: int) -> np.ndarray:
        return np.random.default_rng([self.seed, dim]).normal(size=(self.tables, self.hashes, dim))

    def bucket_numbers(self, m: np.ndarray) -> np.ndarray:
        """Rows x tables."""
        bits = np.einsum("thd,nd->nth", self.planes(m.shape[1]), m) >= 0
        return (bits @ (1 << np.arange(self.hashes, dtype=np.int64))) % self.buckets

    def index(self, records: DataFrame, id: str = "id", vector: str = "vector") -> DataFrame:
        """(dim, table_no, bucket, id): a row for each record and table; null and empty vectors have none."""
        rows = records.where(F.size(vector) > 0).select(F.col(id).alias("id"), F.col(vector).alias("vector"))
        kind = dict(rows.dtypes)["id"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                sizes = batch["vector"].map(len).to_numpy()
                for n in np.unique(sizes):
                    at = np.flatnonzero(sizes == n)
                    b = self.bucket_numbers(np.stack([np.asarray(x, np.float64) for x in batch["vector"].iloc[at]]))
                    yield pd.DataFrame({"dim": np.int32(n), "table_no": np.tile(np.arange(self.tables, dtype=np.int32), len(at)), "bucket": b.ravel(), "id": np.repeat(batch["id"].to_numpy()[at], self.tables)})

        return rows.mapInPandas(run, f"dim int, table_no int, bucket bigint, id {kind}")

    def probes(self, query: Sequence[float], probes: int) -> list[tuple[int, int]]:
        """(table, bucket): the query's bucket of each table and the ``probes`` buckets on either side, cyclically."""
        own = self.bucket_numbers(np.asarray([query], np.float64))[0]
        return sorted({(t, int((b + j) % self.buckets)) for t, b in enumerate(own) for j in range(-probes, probes + 1)})


class SignHashIndex:
    def __init__(self, model: SignHash, records: DataFrame, buckets: DataFrame):
        self.model, self.records, self.buckets = model, records, buckets

    @classmethod
    def build(cls, records: DataFrame, id: str = "id", vector: str = "vector", **parameters) -> SignHashIndex:
        model = SignHash(**parameters)
        rows = records if id == "id" and vector == "vector" else records.withColumnsRenamed({id: "id", vector: "vector"})
        return cls(model, rows, model.index(rows))

    def save(self, path: str) -> None:
        m = self.model
        spark = self.buckets.sparkSession
        self.buckets.write.mode("overwrite").partitionBy("table_no").parquet(f"{path}/buckets")
        spark.createDataFrame([(m.tables, m.hashes, m.buckets, m.seed)], "tables int, hashes int, buckets int, seed int").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, records: DataFrame, path: str) -> SignHashIndex:
        spark = records.sparkSession
        return cls(SignHash(**spark.read.parquet(f"{path}/model").first().asDict()), records, spark.read.parquet(f"{path}/buckets"))

    def candidates(self, query: Sequence[float], probes: int = 2) -> DataFrame:
        """(id): records of the query's size that share a probed bucket of some table."""
        wanted = self.buckets.sparkSession.createDataFrame([(len(query), t, b) for t, b in self.model.probes(query, probes)], "dim int, table_no int, bucket bigint")
        # as many rows as tables times probed buckets
        return self.buckets.join(F.broadcast(wanted), ["dim", "table_no", "bucket"], "left_semi").select("id").distinct()

    def search(self, query: Sequence[float], k: int = 10, probes: int = 2, metric_name: str = "euclidean", **options) -> DataFrame:
        """The k nearest candidates by exact distance; nothing if no bucket holds any."""
        near = self.records.join(self.candidates(query, probes), "id", "left_semi")
        return nearest(near, query, k, metric_name, penalty=MISMATCH_PENALTY, **options)

    def batch_search(self, queries: DataFrame, k: int = 10, probes: int = 2, metric_name: str = "euclidean") -> DataFrame:
        """(query_id, rank, id, dist) of many queries (query_id, qvector): buckets and probes meet by key, candidates that
        several tables give count once."""
        model = self.model

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = [(i, len(q), t, b) for i, q in zip(batch["query_id"], batch["qvector"]) for t, b in model.probes(q, probes)]
                yield pd.DataFrame(out, columns=["query_id", "dim", "table_no", "bucket"])

        m = metric(metric_name)
        q = queries.where(F.size("qvector") > 0).select("query_id", F.col("qvector").cast("array<double>").alias("qvector"))
        wanted = q.mapInPandas(look, f"query_id {dict(q.dtypes)['query_id']}, dim int, table_no int, bucket bigint")
        pairs = wanted.join(self.buckets, ["dim", "table_no", "bucket"]).select("query_id", "id").distinct()
        wide = pairs.join(self.records.select("id", "vector"), "id").join(q, "query_id")
        found = wide.select("query_id", "id", database_distance(m.name, F.col("vector"), F.col("qvector")).alias("dist")).where(~F.isnan("dist"))
        by = Window.partitionBy("query_id").orderBy(F.col("dist").desc() if m.similarity else F.col("dist").asc(), "id")
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "dist")

    def stats(self) -> DataFrame:
        """(dim, table_no, buckets_used, mean_size, max_size)."""
        sized = self.buckets.groupBy("dim", "table_no", "bucket").agg(F.count(F.lit(1)).alias("n"))
        return sized.groupBy("dim", "table_no").agg(F.count(F.lit(1)).alias("buckets_used"), F.avg("n").alias("mean_size"), F.max("n").alias("max_size"))
