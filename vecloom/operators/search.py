"""Exact nearest-neighbour search: one query as an expression plan, many queries as blocks of matrix products."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import JsonFields, compile_filter
from ..functions.metrics import MISMATCH_PENALTY, Metric, database_distance, metric, vector_literal
from ..session import cut_lineage

#: Queries whose vectors go to every task at once; more are cut into blocks of this size that meet blocks of records.
QUERY_BLOCK = 2_048
#: Records of a block when queries are cut into blocks.
RECORD_BLOCK = 32_768
#: Rows of records multiplied at a time, which bounds a task's distance matrix.
ROW_BLOCK = 4_096


def restricted(records: DataFrame, where: Any = None, partition_ids: Sequence[str] | None = None, metadata: str = "metadata") -> DataFrame:
    """Records of some partitions (pruned by the scan) that pass a filter: a Column, a dict or list for metadata, or a
    Python function of (id, metadata as a dict or None), which runs in Arrow batches and is the slow way."""
    if partition_ids:
        records = records.where(F.col("partition_id").isin(list(partition_ids)))
    if where is None:
        return records
    if callable(where) and not isinstance(where, Column):
        return records.where(_called(where)("id", metadata))
    return records.where(where if isinstance(where, Column) else compile_filter(where, JsonFields(metadata)))


def _called(f: Callable[[Any, dict | None], bool]):
    @F.pandas_udf("boolean")
    def apply(ids: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([bool(f(i, None if t is None else json.loads(t))) for i, t in zip(ids, text)], dtype=bool)

    return apply


def _comparable(records: DataFrame, size: int, m: Metric, vector: str, exact_size: bool) -> DataFrame:
    """Records a query of ``size`` components may return: cosine compares equal sizes only."""
    keep = F.col(vector).isNotNull()
    return records.where(keep & (F.size(vector) == size) if exact_size or m.name == "cosine" else keep)


def nearest(
    records: DataFrame,
    query: Sequence[float],
    k: int = 10,
    metric_name: str = "euclidean",
    where: Any = None,
    partition_ids: Sequence[str] | None = None,
    offset: int = 0,
    id: str = "id",
    vector: str = "vector",
    order: str | None = None,
    include: Sequence[str] = (),
    exact_size: bool = False,
    penalty: float = MISMATCH_PENALTY,
) -> DataFrame:
    """(id, dist, *include): the k nearest records, nearest first.

    Filters and partitions apply before distances. Euclidean distance pays ``penalty`` per missing component, cosine
    skips other sizes. Equal distances go by ``order`` (the id by default). NaN distances and null vectors are left out.
    One top-k per task, one merge: the plan is ``TakeOrderedAndProject``.
    """
    m = metric(metric_name)
    rows = _comparable(restricted(records, where, partition_ids), len(query), m, vector, exact_size)
    dist = database_distance(m.name, F.col(vector), vector_literal(query), penalty)
    found = rows.select(F.col(id), *[F.col(c) for c in include if c != id], F.col(order or id).alias("order__"), dist.alias("dist")).where(~F.isnan("dist"))
    best = found.orderBy(F.col("dist").desc() if m.similarity else F.col("dist").asc(), "order__")
    return (best.offset(offset) if offset else best).limit(k).drop("order__")


def _by_size(vectors: Sequence[np.ndarray | None]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([-1 if v is None else len(v) for v in vectors])
    return {int(n): (np.flatnonzero(sizes == n), np.stack([np.asarray(vectors[i], np.float64) for i in np.flatnonzero(sizes == n)])) for n in np.unique(sizes[sizes >= 0])}


def _distances(m: Metric, q: np.ndarray, v: np.ndarray, penalty: float) -> np.ndarray:
    n = min(q.shape[1], v.shape[1])
    gap = abs(q.shape[1] - v.shape[1]) * penalty
    d = m.block(q[:, :n], v[:, :n])
    return np.sqrt(d * d + gap) if m.name == "euclidean" and gap else d


def _exact(m: Metric, q: np.ndarray, v: np.ndarray, penalty: float) -> np.ndarray:
    n = min(q.shape[1], v.shape[1])
    gap = abs(q.shape[1] - v.shape[1]) * penalty
    d = m.pairs(q[:, :n], v[:, :n])
    return np.sqrt(d * d + gap) if m.name == "euclidean" and gap else d


def within(m: Metric, q: np.ndarray, v: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """What a block distance may be of a row whose exact distance is within ``cut`` (queries x 1, in block distances).

    Blocks of Euclidean distances are sums that cancel: their squares are off by some rounding units of the squared
    norms, which for near copies is more than the distance itself.
    """
    n = min(q.shape[1], v.shape[1])
    unit = 8 * (n + 8) * np.finfo(np.float64).eps
    a, b = np.square(q[:, :n]).sum(1)[:, None], np.square(v[:, :n]).sum(1).max(initial=0.0)
    if m.name == "euclidean":
        return np.sqrt(cut * cut + unit * (a + b))
    if m.name == "squared_euclidean":
        return cut + unit * (a + b)
    if m.name in ("dot", "inner"):
        return cut + unit * np.sqrt(a * b)
    return cut + unit * (1 + np.abs(cut))


def _block_search(m: Metric, queries: pd.DataFrame, penalty: float, exact_size: bool, not_self: bool, per_partition: bool):
    """Top k of each query within each Arrow batch (and partition, if asked for); a later window merges them."""
    q_ids, q_k = queries["query_id"].to_numpy(), queries["k"].to_numpy(np.int64)
    asked = [None if p is None or not len(p) else set(p) for p in queries["partition_ids"]]
    restricted_queries = np.array([p is not None for p in asked])
    groups = _by_size(queries["qvector"].tolist())
    sign = -1.0 if m.similarity else 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, order, parts = (batch[c].to_numpy() for c in ("id", "order__", "partition_id"))
            part_no, part_names = pd.factorize(parts, use_na_sentinel=False)
            out = []
            for n_v, (rows, v) in _by_size(batch["vector"].tolist()).items():
                for n_q, (qs, q) in groups.items():
                    if n_q != n_v and (exact_size or m.name == "cosine"):
                        continue
                    most = int(q_k[qs].max())
                    for s in range(0, len(rows), ROW_BLOCK):
                        r, w = rows[s : s + ROW_BLOCK], v[s : s + ROW_BLOCK]
                        d = sign * _distances(m, q, w, penalty)
                        d[np.isnan(d)] = np.inf
                        if not_self:
                            d[queries["self_id"].to_numpy()[qs][:, None] == ids[r][None]] = np.inf
                        if restricted_queries[qs].any():
                            allowed = np.array([[asked[i] is None or p in asked[i] for p in part_names] for i in qs])
                            d[~allowed[:, part_no[r]]] = np.inf
                        for cols in [np.flatnonzero(part_no[r] == p) for p in np.unique(part_no[r])] if per_partition else [np.arange(len(r))]:
                            near = d[:, cols]
                            cut = np.partition(near, most - 1, axis=1)[:, most - 1 : most] if near.shape[1] > most else np.full((len(q), 1), np.inf)
                            # all that may be within the cut stay; exact distances settle them
                            i, j = np.nonzero((near <= within(m, q, w[cols], cut)) & np.isfinite(near))
                            exact = _exact(m, q[i], w[cols[j]], penalty)
                            if len(i) > most * len(q):
                                best = np.lexsort((order[r[cols[j]]], sign * exact, i))
                                i, j, exact = i[best], j[best], exact[best]
                                keep = np.arange(len(i)) - np.searchsorted(i, np.arange(len(q)))[i] < most
                                i, j, exact = i[keep], j[keep], exact[keep]
                            j = r[cols[j]]
                            out.append(pd.DataFrame({"query_id": q_ids[qs[i]], "k": q_k[qs[i]].astype(np.int32), "partition_id": parts[j], "id": ids[j], "order__": order[j], "dist": exact}))
            if out:
                yield pd.concat(out)

    return run


def _asked(queries: DataFrame, k: int, id_type: str, also: Sequence[str] = ()) -> DataFrame:
    """(query_id, qvector, k, partition_ids, self_id, *also) of the queries that can find something."""
    q = queries.where("qvector IS NOT NULL")
    return q.select(
        "query_id",
        F.col("qvector").cast("array<double>").alias("qvector"),
        (F.coalesce("k", F.lit(k)) if "k" in q.columns else F.lit(k)).cast("int").alias("k"),
        (F.col("partition_ids") if "partition_ids" in q.columns else F.lit(None).cast("array<string>")).alias("partition_ids"),
        (F.col("self_id") if "self_id" in q.columns else F.lit(None).cast(id_type)).alias("self_id"),
        *also,
    ).where("k > 0")


def _searchable(records: DataFrame, id: str, vector: str, order: str | None, also: Sequence[str] = ()) -> DataFrame:
    """(id, vector, order__, partition_id, *also) of the records with a vector."""
    partition = F.col("partition_id").cast("string") if "partition_id" in records.columns else F.lit(None).cast("string")
    return records.where(F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.col(vector).alias("vector"), F.col(order or id).alias("order__"), partition.alias("partition_id"), *also)


def _ranked(found: DataFrame, m: Metric, keys: Sequence[str]) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.col("dist").desc() if m.similarity else F.col("dist").asc(), "order__")
    return found.withColumn("rank", F.row_number().over(by)).where("rank <= k").select("query_id", F.col("rank").cast("int").alias("rank"), "partition_id", "id", "dist")


def _met(m: Metric, schema: str, penalty: float, exact_size: bool, not_self: bool, per_partition: bool):
    """Search of one block of queries in one block of records."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = list(_block_search(m, a, penalty, exact_size, not_self, per_partition)(iter([b]))) if len(a) and len(b) else []
        return parts[0] if parts else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")}, dtype=object)

    return run


def _found_schema(q: DataFrame, rows: DataFrame) -> str:
    return f"query_id {dict(q.dtypes)['query_id']}, k int, partition_id string, id {dict(rows.dtypes)['id']}, order__ {dict(rows.dtypes)['order__']}, dist double"


def batch_nearest(
    records: DataFrame,
    queries: DataFrame,
    k: int = 10,
    metric_name: str = "euclidean",
    where: Any = None,
    id: str = "id",
    vector: str = "vector",
    order: str | None = None,
    not_self: bool = False,
    per_partition: bool = False,
    exact_size: bool = False,
    penalty: float = MISMATCH_PENALTY,
) -> DataFrame:
    """(query_id, rank, partition_id, id, dist) of every query.

    ``queries`` has query_id and qvector, and optionally k, partition_ids (null or empty: all) and self_id (left out with
    ``not_self``). With ``per_partition`` the k nearest of each partition are returned, ranked within it. Queries with a
    null vector find nothing. Up to ``QUERY_BLOCK`` counted queries go to every task, which keeps k rows a query. More
    queries are rows of the plan: hashed into blocks that each meet every block of records in a task of its own. Either
    way one exchange merges the k nearest of each block.
    """
    m = metric(metric_name)
    rows = _searchable(restricted(records, where), id, vector, order)
    q = _asked(queries, k, dict(rows.dtypes)["id"])
    schema = _found_schema(q, rows)
    n_queries = q.count()
    if n_queries <= QUERY_BLOCK:
        found = rows.mapInPandas(_block_search(m, q.toPandas(), penalty, exact_size, not_self, per_partition), schema)
    else:
        n_q, n_r = -(-n_queries // QUERY_BLOCK), -(-max(1, rows.count()) // RECORD_BLOCK)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = q.withColumn("q__", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int")).withColumn("r__", every(n_r)).groupBy("q__", "r__")
        right = rows.withColumn("r__", F.pmod(F.xxhash64("id"), F.lit(n_r)).cast("int")).withColumn("q__", every(n_q)).groupBy("q__", "r__")
        found = left.cogroup(right).applyInPandas(_met(m, schema, penalty, exact_size, not_self, per_partition), schema)
    return _ranked(found, m, ["query_id", "partition_id"] if per_partition else ["query_id"])


def nearest_in_cells(
    records: DataFrame,
    queries: DataFrame,
    cell: str,
    k: int = 10,
    metric_name: str = "euclidean",
    id: str = "id",
    vector: str = "vector",
    order: str | None = None,
    penalty: float = MISMATCH_PENALTY,
    exact_size: bool = False,
) -> DataFrame:
    """(query_id, rank, partition_id, id, dist): the k nearest records in the cells each query looks into.

    ``records`` and ``queries`` both have the column ``cell``; a query has a row for each of its cells. Large cells are
    split into blocks of ``RECORD_BLOCK`` records, which each meet the cell's queries in a task of their own.
    """
    m = metric(metric_name)
    rows = _searchable(records, id, vector, order, [F.col(cell).alias("cell__")])
    q = _asked(queries, k, dict(rows.dtypes)["id"], [F.col(cell).alias("cell__")])
    # blocks of records and of queries of each cell; there are as many rows as cells
    n_r = rows.groupBy("cell__").agg(F.ceil(F.count(F.lit(1)) / RECORD_BLOCK).cast("int").alias("records__"))
    n_q = q.groupBy("cell__").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("queries__"))
    sizes = cut_lineage(n_r.join(n_q, "cell__"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = q.join(sizes, "cell__").withColumn("q__", F.pmod(F.xxhash64("query_id"), F.col("queries__")).cast("int")).withColumn("b__", every("records__"))
    right = rows.join(sizes, "cell__").withColumn("b__", F.pmod(F.xxhash64("id"), F.col("records__")).cast("int")).withColumn("q__", every("queries__"))
    schema = _found_schema(q, rows)
    found = left.drop("records__", "queries__").groupBy("cell__", "b__", "q__").cogroup(right.drop("records__", "queries__").groupBy("cell__", "b__", "q__")).applyInPandas(_met(m, schema, penalty, exact_size, False, False), schema)
    return _ranked(found, m, ["query_id"])


def similar_to(records: DataFrame, ids: Sequence[Any] | DataFrame, k: int = 10, metric_name: str = "euclidean", id: str = "id", vector: str = "vector", **options: Any) -> DataFrame:
    """The k nearest other records of each of some stored records, a sequence of ids or a DataFrame (query_id); unknown
    ids find nothing."""
    if isinstance(ids, DataFrame):
        chosen = records.join(ids.select(F.col("query_id").alias(id)).distinct(), id, "left_semi")
    else:
        chosen = records.where(F.col(id).isin(list(ids)))
    asked = chosen.select(F.col(id).alias("query_id"), F.col(vector).alias("qvector"), F.col(id).alias("self_id"))
    return batch_nearest(records, asked, k, metric_name, id=id, vector=vector, not_self=True, **options)


def distinct_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries with one row for each distinct vector and k, (query_id, as_query) of all): equal requests searched once."""
    first = F.min("query_id").over(Window.partitionBy("qvector", "k"))
    marked = queries.withColumn("as_query", first)
    return marked.where("query_id = as_query").drop("as_query"), marked.select("query_id", "as_query")
