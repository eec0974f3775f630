"""Reranking of search results: as they are, for diversity, or by weighted metadata."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import JsonFields
from ..functions.metrics import METRICS, metric

METHODS = ("standard", "diversity", "weighted")


def standard(results: DataFrame, k: int | None = None) -> DataFrame:
    """The first k results of each query (columns query_id, rank)."""
    return results if k is None else results.where(F.col("rank") <= k)


def _mmr(name: str, balance: float, k: int | None):
    m = METRICS[name]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank", kind="stable")
        want = len(group) if k is None else min(k, len(group))
        usable = group[group["vector"].notna()]
        if len(group) <= 1 or not len(usable):
            return group.head(want).drop(columns="vector")
        want = min(want, len(usable))
        vectors = [np.asarray(v, np.float64) for v in usable["vector"]]
        relevance = balance / (1 + usable["dist"].to_numpy())
        chosen = [int(usable["dist"].to_numpy().argmin())]
        apart = np.full(len(usable), np.inf)
        while len(chosen) < want:
            last = vectors[chosen[-1]]
            for i, v in enumerate(vectors):
                n = min(len(v), len(last))
                apart[i] = min(apart[i], m.pairs(v[None, :n], last[None, :n])[0])
            score = relevance + (1 - balance) * apart
            score[chosen] = -np.inf
            chosen.append(int(score.argmax()))  # the first of equal scores
        out = usable.iloc[chosen].drop(columns="vector")
        return out.assign(rank=np.arange(1, len(out) + 1))

    return run


def diversity(results: DataFrame, records: DataFrame, k: int | None = None, balance: float = 0.7, metric_name: str = "euclidean") -> DataFrame:
    """Maximal marginal relevance: the nearest first, then whichever maximises
    ``balance / (1 + dist) + (1 - balance) * (least distance to what is chosen)``; equal scores keep their order.

    Results without a vector are left out; a query with one result, or none with a vector, keeps its first k. Greedy
    choice is sequential, so a query's delivered results (a top-k list) are one group; they are never the collection.
    """
    wide = results.join(records.select("id", "vector"), "id", "left").select(*results.columns, F.col("vector").cast("array<double>").alias("vector"))
    schema = ", ".join(f"`{c}` {t}" for c, t in results.dtypes)
    return wide.groupBy("query_id").applyInPandas(_mmr(metric(metric_name).name, balance, k), schema)


def weighted(results: DataFrame, weights: dict[str, float], k: int | None = None, metadata: str = "metadata") -> DataFrame:
    """Ascending ``dist - sum(weight * metadata field)``, as weighted_score, with ranks renewed.

    Only JSON numbers count. Without weights the results stay as they are; equal scores keep their order.
    """
    if not weights:
        return standard(results, k)
    fields = JsonFields(metadata)
    gain = F.lit(0.0)
    for name, w in weights.items():
        gain = gain + F.coalesce(fields(name).number, F.lit(0.0)) * F.lit(float(w))
    scored = results.withColumn("weighted_score", F.col("dist") - gain)
    by = Window.partitionBy("query_id").orderBy("weighted_score", "rank")
    out = scored.withColumn("rank", F.row_number().over(by).cast("int"))
    return standard(out, k)


def rerank(results: DataFrame, method: str | None = None, records: DataFrame | None = None, weights: dict[str, float] | None = None, k: int | None = None, **options) -> DataFrame:
    """Dispatch on ``method``; None means standard, and a method without what it needs falls back to standard."""
    method = method or "standard"
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    if method == "diversity" and records is not None:
        return diversity(results, records, k, **options)
    if method == "weighted" and weights and "metadata" in results.columns:
        return weighted(results, weights, k)
    return standard(results, k)
