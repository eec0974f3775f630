"""Similarity graph: threshold self-join in blocks, and its connected components."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import METRICS, doubles, metric
from ..schema import check_threshold
from ..session import cut_lineage
from .search import within

#: Rows of a block; a task multiplies two blocks.
BLOCK_ROWS = 16_384
#: Rows aimed at in the cell of a pivot, and the most pivots of a vector size (their vectors go to every task).
PIVOT_ROWS, PIVOTS = 2_048, 1_024
#: Share of the cells that a row may visit before cells are given up for plain blocks.
VISITED = 0.25
#: Edges whose components one task finds.
SMALL_EDGES = 500_000


def _joined(name: str, threshold: float):
    """Pairs of a group (columns id, part, home, vector): home rows with each other, and with its visitors."""
    m = METRICS[name]

    def run(group: pd.DataFrame, across: bool = False) -> pd.DataFrame:
        first = group["home"].to_numpy(bool)
        out = []
        if first.any():
            v, ids = np.stack(group["vector"].to_numpy()), group["id"].to_numpy()
            a, x = v[first], ids[first]
            # home rows come first, so that a pair of two of them is met once; across blocks they do not meet here
            b, y = (v[~first], ids[~first]) if across else (np.concatenate([a, v[~first]]), np.concatenate([x, ids[~first]]))
            for s in range(0, len(a), 512):
                q = a[s : s + 512]
                r, c = np.nonzero(m.block(q, b) <= within(m, q, b, np.full((len(q), 1), threshold)))
                keep = (across | (r + s < c)) & (x[r + s] != y[c])
                r, c = r[keep] + s, c[keep]
                d = m.pairs(a[r], b[c])
                ok = d <= threshold
                low = x[r[ok]] < y[c[ok]]
                out.append(pd.DataFrame({"id_a": np.where(low, x[r[ok]], y[c[ok]]), "id_b": np.where(low, y[c[ok]], x[r[ok]]), "dist": d[ok]}))
        part = group["scope__"].iloc[0]
        return pd.concat(out).assign(scope=part) if out else pd.DataFrame({"id_a": [], "id_b": [], "dist": [], "scope": []}, dtype=object)

    return run


def _blocks(name: str, threshold: float):
    """Pairs of a pair of blocks: each of the two with itself where they are one, else one with the other."""
    run = _joined(name, threshold)

    def both(group: pd.DataFrame) -> pd.DataFrame:
        if group["lo__"].iloc[0] == group["hi__"].iloc[0]:
            return run(group.assign(home=group["own__"]))
        # rows at home of one block meet all of the other; two home rows must meet once
        low = group["block__"] == group["lo__"]
        out = [run(group[(low & group["own__"]) | ~low].assign(home=lambda g: g["block__"] == g["lo__"]), across=True), run(group[(~low & group["own__"]) | (low & ~group["own__"])].assign(home=lambda g: g["block__"] == g["hi__"]), across=True)]
        return pd.concat(out).assign(scope=group["scope__"].iloc[0])

    return both


def _flat(name: str, m: np.ndarray) -> np.ndarray:
    """Vectors among which the distance of ``_TRIANGLE`` is a Euclidean, Manhattan, Chebyshev or Hamming distance."""
    if name != "cosine":
        return m
    n = np.sqrt((m * m).sum(1))[:, None]
    return m / np.where(n == 0, 1, n)


#: The distance that obeys the triangle inequality, and the reach in it of a threshold, of each metric that has one.
_TRIANGLE = {
    "euclidean": ("euclidean", lambda t: t), "squared_euclidean": ("euclidean", lambda t: t**0.5), "cosine": ("euclidean", lambda t: (2 * min(t, 2.0)) ** 0.5), "manhattan": ("manhattan", lambda t: t), "chebyshev": ("chebyshev", lambda t: t), "hamming": ("hamming", lambda t: t),
}


def _visits(name: str, reach: float, vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each row, rows x cells: the cells before it that may hold a row within ``reach``).

    Two rows within t of each other, one at home with pivot p and one with q, have d(x, q) - d(x, p) <= 2 t.
    """
    d = METRICS[_TRIANGLE[name][0]].block(_flat(name, vectors), pivots)
    home = d.argmin(1)
    near = d - d[np.arange(len(d)), home][:, None] <= 2 * reach * (1 + 1e-9) + 1e-6 * (1 + d.max(initial=0.0))
    return home, near & (np.arange(len(pivots)) < home[:, None])


def _pivots(rows: DataFrame, name: str, reach: float, count: int, seed: int = 4) -> dict[int, np.ndarray]:
    """Pivots of every vector size for which cells spare work, from a bounded sample of the rows."""
    share = min(1.0, 8 * PIVOTS / max(count, 1))
    sample = [np.asarray(r.vector, np.float64) for r in rows.where(F.rand(seed) < share).select("vector").limit(16 * PIVOTS).collect()]
    out = {}
    for n in {len(v) for v in sample}:
        m = np.stack([v for v in sample if len(v) == n])
        k = min(PIVOTS, int(count * len(m) / len(sample)) // PIVOT_ROWS, len(m) // 2)
        if k < 4:
            continue
        pivots, rest = _flat(name, m[:k]), m[k:]
        if _visits(name, reach, rest, pivots)[1].mean() * 2 <= VISITED:
            out[n] = pivots
    return out


def _to_cells(name: str, reach: float, pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch["vector"]])
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                if n in pivots:
                    home, near = _visits(name, reach, np.stack([np.asarray(v, np.float64) for v in batch["vector"].iloc[rows]]), pivots[n])
                    r, c = np.nonzero(near)
                    at, cell, own = np.concatenate([rows, rows[r]]), np.concatenate([home, c]), np.arange(len(rows) + len(r)) < len(rows)
                else:
                    at, cell, own = rows, np.full(len(rows), -1), np.ones(len(rows), bool)
                yield pd.DataFrame({c: batch[c].to_numpy(object)[at] for c in batch.columns}).assign(cell__=cell.astype(np.int32), own__=own)

    return run


def relationships(
    records: DataFrame, threshold: float, metric_name: str = "euclidean", scope: str = "partition", partition_ids: list[str] | None = None, include_metadata: bool = False, id: str = "id", vector: str = "vector"
) -> DataFrame:
    """(id_a, id_b, partition_id, dist[, metadata_a, metadata_b]): pairs of records of one size within ``threshold``.

    ``scope`` 'partition' compares within partitions only, 'global' all records (partition_id is then null). Where the
    threshold is small beside the spread of the records, they are cut into the cells of pivots, and a record meets the
    cells that the triangle inequality cannot rule out; nothing is lost. Otherwise, and within large cells, blocks of
    ``BLOCK_ROWS`` meet pair by pair. Null, empty and (for cosine) all-zero vectors have no relationships.
    """
    t = check_threshold(threshold)
    m = metric(metric_name)
    if m.similarity or m.name == "inner":
        raise ValueError("relationships need a distance")
    if partition_ids:
        records = records.where(F.col("partition_id").isin(partition_ids))
    part = F.col("partition_id").cast("string") if scope == "partition" and "partition_id" in records.columns else F.lit(None).cast("string")
    rows = records.where(F.size(vector) > 0).select(F.col(id).alias("id"), part.alias("scope__"), doubles(F.col(vector)).alias("vector"))
    if m.name == "cosine":
        rows = rows.where(F.exists("vector", lambda x: x != 0))
    count = rows.count()
    reach = _TRIANGLE[m.name][1](t)
    pivots = _pivots(rows, m.name, reach, count) if count > 4 * PIVOT_ROWS else {}
    id_type = dict(rows.dtypes)["id"]
    if pivots:
        placed = rows.mapInPandas(_to_cells(m.name, reach, pivots), f"id {id_type}, scope__ string, vector array<double>, cell__ int, own__ boolean")
    else:
        placed = rows.withColumn("cell__", F.lit(-1)).withColumn("own__", F.lit(True))
    placed = placed.withColumn("size__", F.size("vector"))
    keys = ["scope__", "size__", "cell__"]
    if count > BLOCK_ROWS:
        # as many rows as scopes, sizes and cells
        blocks = cut_lineage(placed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks__")).withColumn("scope__", F.coalesce("scope__", F.lit(""))))
        placed = placed.withColumn("scope2__", F.coalesce("scope__", F.lit(""))).join(blocks.withColumnRenamed("scope__", "scope2__"), ["scope2__", *keys[1:]]).drop("scope2__")
    else:
        placed = placed.withColumn("blocks__", F.lit(1))
    block = F.pmod(F.xxhash64("id", "vector"), F.col("blocks__")).cast("int")
    met = placed.withColumn("block__", block).withColumn("other__", F.explode(F.sequence(F.lit(0), F.col("blocks__") - 1))).withColumn("lo__", F.least("block__", "other__")).withColumn("hi__", F.greatest("block__", "other__"))
    pairs = met.select("id", "scope__", "vector", "size__", "cell__", "lo__", "hi__", "block__", "own__").groupBy(*keys, "lo__", "hi__")
    found = pairs.applyInPandas(_blocks(m.name, t), f"id_a {id_type}, id_b {id_type}, dist double, scope string").select("id_a", "id_b", F.col("scope").alias("partition_id"), "dist")
    if not include_metadata:
        return found
    # the same id may live in two partitions
    within = ["partition_id"] if scope == "partition" and "partition_id" in records.columns else []
    for side in ("a", "b"):
        meta = records.select(F.col(id).alias(f"id_{side}"), *[F.col(c).cast("string").alias(c) for c in within], F.col("metadata").alias(f"metadata_{side}"))
        found = found.join(meta, [f"id_{side}", *within], "left")
    return found.select("id_a", "id_b", "partition_id", "dist", "metadata_a", "metadata_b")


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) to (id, root): a number for each component."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    ends = [table.column(c).to_pylist() for c in ("u", "v")]
    key = (lambda x: tuple(x.values())) if pa.types.is_struct(table.schema.field("u").type) else (lambda x: x)
    place: dict[Any, int] = {}
    u, v = (np.array([place.setdefault(key(x), len(place)) for x in c], np.int64) for c in ends)
    root = np.arange(len(place))
    while True:
        new = root.copy()
        low = np.minimum(root[u], root[v])
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    first = np.unique(np.concatenate([u, v]), return_index=True)[1]
    nodes = pa.concat_arrays([table.column(c).combine_chunks() for c in ("u", "v")]).take(pa.array(first))
    yield pa.RecordBatch.from_arrays([nodes, pa.array(root)], names=["id", "root"])


def connected_components(edges: DataFrame, a: str = "id_a", b: str = "id_b", rounds: int = 60) -> DataFrame:
    """(id, community): the least id of the component of every end of an edge. Loops and null ends are ignored.

    Up to ``SMALL_EDGES`` counted edges are solved in one task. More take large-star and small-star rounds: each replaces
    edges by edges to smaller neighbours until only stars are left, in a number of rounds logarithmic in the longest
    path; each round is checkpointed. If ``rounds`` do not suffice it raises: no partial labels are returned.
    """
    e = edges.where(f"`{a}` <> `{b}`").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = cut_lineage(e)
    if e.count() <= SMALL_EDGES:
        kind = e.schema["u"].dataType.simpleString()
        found = cut_lineage(e.coalesce(1).mapInArrow(_in_one_task, f"id {kind}, root long"))
        return found.join(found.groupBy("root").agg(F.min("id").alias("community")), "root").select("id", "community")
    seen: Any = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut_lineage(small.where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"the components were not settled in {rounds} rounds")
    tops = e.select(F.col("v").alias("id")).distinct().withColumn("community", F.col("id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("community")).unionByName(tops)


def communities(records: DataFrame, threshold: float, metric_name: str = "euclidean", scope: str = "partition", include_metadata: bool = False, **options: Any) -> DataFrame:
    """(partition_id, community, id[, metadata]): components of at least two records of the relationship graph."""
    pairs = cut_lineage(relationships(records, threshold, metric_name, scope, **options).select("partition_id", "id_a", "id_b"))
    if scope == "partition":
        # the same id may live in two partitions: components are of (partition, id)
        key = lambda c: F.struct("partition_id", F.col(c).alias("id"))
        found = connected_components(pairs.select(key("id_a").alias("id_a"), key("id_b").alias("id_b")))
        out = found.select("id.partition_id", "community.id", F.col("id.id").alias("member")).toDF("partition_id", "community", "id")
    else:
        found = connected_components(pairs)
        out = found.select(F.lit(None).cast("string").alias("partition_id"), "community", "id")
    if not include_metadata:
        return out
    keys = ["id", "partition_id"] if scope == "partition" else ["id"]
    return out.join(records.select(*keys, "metadata"), keys, "left")
