"""Product quantisation: codebooks per subvector, byte codes, asymmetric distances."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..search import QUERY_BLOCK

#: Codebooks are fitted on at most this many records.
TRAIN_ROWS = 20_000


def suggested_subvectors(dim: int) -> int:
    """Subvectors for a vector size: about 8 components each, more in large vectors, and a divisor of the size if any."""
    target = max(1, dim // (8 if dim <= 512 else 12 if dim <= 1024 else 16))
    divisors = [n for n in range(1, dim + 1) if dim % n == 0]
    return min(divisors, key=lambda n: (abs(n - target), n))


def lloyd(m: np.ndarray, k: int, rounds: int, tolerance: float, rng: np.random.Generator) -> np.ndarray:
    distinct = np.unique(m, axis=0)
    if len(distinct) <= k:
        return distinct
    c = [m[rng.integers(len(m))]]
    far = ((m - c[0]) ** 2).sum(1)
    for _ in range(k - 1):  # spread first centres, by squared distance
        c.append(m[rng.choice(len(m), p=far / far.sum())] if far.sum() else m[rng.integers(len(m))])
        far = np.minimum(far, ((m - c[-1]) ** 2).sum(1))
    c = np.array(c)
    for _ in range(rounds):
        d = (m * m).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * m @ c.T
        at = d.argmin(1)
        n = np.bincount(at, minlength=k)
        new = c.copy()
        sums = np.zeros_like(c)
        np.add.at(sums, at, m)
        new[n > 0] = sums[n > 0] / n[n > 0][:, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):  # an empty cluster restarts at the rows that fit worst
            new[empty] = m[np.argsort(-d.min(1), kind="stable")[: len(empty)]]
        moved = np.abs(new - c).max()
        c = new
        if moved <= tolerance:
            break
    return c


class ProductQuantizer:
    def __init__(self, codebooks: list[np.ndarray]):
        self.codebooks = [np.asarray(c, np.float64) for c in codebooks]
        self.edges = np.cumsum([0, *(c.shape[1] for c in self.codebooks)])

    @property
    def dim(self) -> int:
        return int(self.edges[-1])

    @classmethod
    def train(cls, records: DataFrame, subvectors: int | None = None, clusters: int = 256, rounds: int = 25, tolerance: float = 1e-3, seed: int = 3, vector: str = "vector", id: str = "id") -> ProductQuantizer:
        """Fit on at most ``TRAIN_ROWS`` records of one size, the first by a hash of the id; every record is then coded."""
        if not 1 <= clusters <= 256:
            raise ValueError("a code byte allows 1 to 256 clusters")
        rows = records.where(F.size(vector) > 0).orderBy(F.xxhash64(id, F.lit(seed)), id).limit(TRAIN_ROWS).select(F.col(vector).cast("array<double>").alias("v")).collect()
        if not rows:
            raise ValueError("nothing to train on")
        m = np.array([r.v for r in rows])
        parts = np.array_split(np.arange(m.shape[1]), subvectors or suggested_subvectors(m.shape[1]))
        rng = np.random.default_rng(seed)
        return cls([lloyd(m[:, p], clusters, rounds, tolerance, rng) for p in parts])

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, j, [float(x) for x in c]) for i, book in enumerate(self.codebooks) for j, c in enumerate(book)]
        spark.createDataFrame(rows, "subvector int, code int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ProductQuantizer:
        rows = spark.read.parquet(path).orderBy("subvector", "code").collect()
        return cls([np.array([r.centroid for r in rows if r.subvector == i]) for i in range(max(r.subvector for r in rows) + 1)])

    def codes(self, m: np.ndarray) -> np.ndarray:
        out = np.empty((len(m), len(self.codebooks)), np.uint8)
        for i, c in enumerate(self.codebooks):
            x = m[:, self.edges[i] : self.edges[i + 1]]
            out[:, i] = ((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, i]] for i, c in enumerate(self.codebooks)], axis=1)

    def encode(self, records: DataFrame, vector: str = "vector") -> DataFrame:
        """``records`` with a binary ``code``; null where the vector is null or of another size."""

        @F.pandas_udf("binary")
        def code(v: pd.Series) -> pd.Series:
            fits = v.map(lambda x: x is not None and len(x) == self.dim).to_numpy(bool)
            out = pd.Series([None] * len(v), dtype=object)
            if fits.any():
                coded = self.codes(np.stack([np.asarray(x, np.float64) for x in v[fits]]))
                out[np.flatnonzero(fits)] = [c.tobytes() for c in coded]
            return out

        return records.withColumn("code", code(vector))

    def tables(self, query: Sequence[float]) -> np.ndarray:
        """Squared distances of the query's subvectors to their centroids, 256 wide (unused places infinite)."""
        q = np.asarray(query, np.float64)
        if len(q) != self.dim:
            raise ValueError(f"the query has {len(q)} components, not {self.dim}")
        out = np.full((len(self.codebooks), 256), np.inf)
        for i, c in enumerate(self.codebooks):
            out[i, : len(c)] = ((c - q[self.edges[i] : self.edges[i + 1]]) ** 2).sum(1)
        return out

    def search(self, coded: DataFrame, query: Sequence[float], k: int = 10, exact_from: int | None = None, id: str = "id", vector: str = "vector") -> DataFrame:
        """(id, dist): the k least asymmetric squared distances. With ``exact_from`` that many are re-ranked by their
        true squared distance."""
        table, width = self.tables(query), len(self.codebooks)
        q = np.asarray(query, np.float64)
        keep = max(k, exact_from or 0)
        kept = coded.where("code IS NOT NULL").select(F.col(id).alias("id"), "code", *([F.col(vector).alias("vector")] if exact_from else []))
        kind = dict(kept.dtypes)["id"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                codes = np.frombuffer(b"".join(batch["code"]), np.uint8).reshape(-1, width)
                d = table[np.arange(width), codes].sum(1)
                pick = np.flatnonzero(d <= np.partition(d, min(keep, len(d)) - 1)[min(keep, len(d)) - 1])
                exact = ((np.stack([np.asarray(v, np.float64) for v in batch["vector"].iloc[pick]]) - q) ** 2).sum(1) if exact_from else d[pick]
                yield pd.DataFrame({"id": batch["id"].to_numpy()[pick], "approx": d[pick], "dist": exact})

        found = kept.mapInPandas(run, f"id {kind}, approx double, dist double")
        if exact_from:
            found = found.orderBy("approx", "id").limit(exact_from)
        return found.orderBy("dist", "id").limit(k).select("id", "dist")

    def batch_search(self, coded: DataFrame, queries: DataFrame, k: int = 10, exact_from: int = 100, id: str = "id", vector: str = "vector") -> DataFrame:
        """(query_id, rank, id, dist) of up to ``QUERY_BLOCK`` counted queries (query_id, qvector): of each the
        ``exact_from`` least asymmetric distances are re-ranked by the true squared distance."""
        q = queries.where(F.size("qvector") == self.dim).select("query_id", F.col("qvector").cast("array<double>").alias("qvector"))
        n = q.count()
        if n > QUERY_BLOCK:
            raise ValueError(f"{n} queries at once; search them in blocks of {QUERY_BLOCK}")
        local = q.toPandas()
        names, vectors = local["query_id"].to_numpy(), [np.asarray(v, np.float64) for v in local["qvector"]]
        tables, width = [self.tables(v) for v in vectors], len(self.codebooks)
        kept = coded.where("code IS NOT NULL").select(F.col(id).alias("id"), "code", F.col(vector).alias("vector"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                codes = np.frombuffer(b"".join(batch["code"]), np.uint8).reshape(-1, width)
                m = np.stack([np.asarray(v, np.float64) for v in batch["vector"]])
                keep = min(exact_from, len(batch))
                for name, v, table in zip(names, vectors, tables):
                    d = table[np.arange(width), codes].sum(1)
                    pick = np.flatnonzero(d <= np.partition(d, keep - 1)[keep - 1])
                    yield pd.DataFrame({"query_id": name, "id": batch["id"].to_numpy()[pick], "approx": d[pick], "dist": ((m[pick] - v) ** 2).sum(1)})

        found = kept.mapInPandas(run, f"query_id {dict(q.dtypes)['query_id']}, id {dict(kept.dtypes)['id']}, approx double, dist double")
        near = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("approx", "id"))).where(F.col("n") <= exact_from)
        out = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))).where(F.col("rank") <= k)
        return out.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "dist")

    def compression_ratio(self) -> float:
        return 4.0 * self.dim / len(self.codebooks)
