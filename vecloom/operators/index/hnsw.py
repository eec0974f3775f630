"""Navigable small-world graphs: one graph per shard of records, built and searched inside tasks, stored as tables."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.metrics import Metric, metric
from ...session import cut_lineage
from ..search import QUERY_BLOCK, restricted

#: Records of a graph; a partition with more has several graphs, all of which are searched.
SHARD_ROWS = 20_000
#: Share of dead nodes beyond which a shard is built anew when records are inserted.
REBUILD = 0.3
MAX_LEVEL = 16


class Graph:
    """One small-world graph in memory. Nodes are row numbers; every level has at most ``m`` links (twice on level 0)."""

    def __init__(self, vectors: np.ndarray, kernel: Metric | str = "euclidean", m: int = 16, ef_construction: int = 200, seed: int = 9):
        self.v, self.kernel, self.m, self.ef = vectors, metric(kernel) if isinstance(kernel, str) else kernel, m, ef_construction
        self.sign = -1.0 if self.kernel.similarity else 1.0
        self.links: list[list[list[int]]] = []
        self.entry = -1
        self.levels = np.minimum(np.random.default_rng(seed).geometric(0.5, len(vectors)) - 1, MAX_LEVEL)

    def distances(self, q: np.ndarray, nodes: Sequence[int]) -> np.ndarray:
        v = self.v[list(nodes)]
        return self.sign * self.kernel.pairs(np.broadcast_to(q, v.shape), v)

    def beam(self, q: np.ndarray, starts: Sequence[int], ef: int, level: int) -> list[tuple[float, int]]:
        seen = set(starts)
        near = list(zip(self.distances(q, starts).tolist(), starts))
        best = [(-d, -n) for d, n in near]
        heapq.heapify(near)
        heapq.heapify(best)
        while near:
            d, node = heapq.heappop(near)
            if len(best) >= ef and d > -best[0][0]:
                break
            fresh = [n for n in self.links[node][level] if n not in seen] if level < len(self.links[node]) else []
            if not fresh:
                continue
            seen.update(fresh)
            for x, n in zip(self.distances(q, fresh).tolist(), fresh):
                if len(best) < ef or x < -best[0][0]:
                    heapq.heappush(near, (x, n))
                    heapq.heappush(best, (-x, -n))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, -n) for d, n in best)

    def _link(self, a: int, b: int, level: int) -> None:
        row = self.links[a][level]
        row.append(b)
        most = 2 * self.m if level == 0 else self.m
        if len(row) > most:
            d = self.distances(self.v[a], row)
            self.links[a][level] = [row[i] for i in np.argsort(d, kind="stable")[:most]]

    def build(self) -> Graph:
        """Link every row that is not yet a node."""
        for node in range(len(self.links), len(self.v)):
            top = int(self.levels[node])
            self.links.append([[] for _ in range(top + 1)])
            if self.entry < 0:
                self.entry = node
                continue
            q, start = self.v[node], [self.entry]
            for level in range(len(self.links[self.entry]) - 1, top, -1):
                start = [self.beam(q, start, 1, level)[0][1]]
            for level in range(min(top, len(self.links[self.entry]) - 1), -1, -1):
                found = self.beam(q, start, self.ef, level)
                for _, other in found[: self.m]:
                    self._link(node, other, level)
                    self._link(other, node, level)
                start = [n for _, n in found]
            if top > len(self.links[self.entry]) - 1:
                self.entry = node
        return self

    def packed(self) -> dict[str, bytes]:
        """Vectors, the number of levels of each node, the links of each node and level, and the links themselves."""
        degree = [len(row) for node in self.links for row in node]
        flat = [x for node in self.links for row in node for x in row]
        arrays = {"vectors": np.ascontiguousarray(self.v, np.float64), "levels": [len(n) for n in self.links], "degrees": degree, "links": flat}
        return {k: (x if k == "vectors" else np.array(x, np.int32)).tobytes() for k, x in arrays.items()}

    @classmethod
    def unpacked(cls, row: Any, dim: int, kernel: Metric | str, m: int = 16, ef_construction: int = 200) -> Graph:
        g = cls(np.frombuffer(row["vectors"], np.float64).reshape(-1, dim), kernel, m, ef_construction)
        flat = np.frombuffer(row["links"], np.int32).tolist()
        ends = np.cumsum(np.frombuffer(row["degrees"], np.int32)).tolist()
        rows = iter([flat[a:b] for a, b in zip([0, *ends[:-1]], ends)])
        g.links = [[next(rows) for _ in range(n)] for n in np.frombuffer(row["levels"], np.int32).tolist()]
        g.levels = np.frombuffer(row["levels"], np.int32) - 1
        g.entry = int(row["entry"])
        return g

    def search(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        start = [self.entry]
        for level in range(len(self.links[self.entry]) - 1, 0, -1):
            start = [self.beam(q, start, 1, level)[0][1]]
        return [(self.sign * d, n) for d, n in self.beam(q, start, ef, 0)]


_SHARD = "partition_id string, dim int, shard int, ids array<{kind}>, dead binary, entry int, vectors binary, levels binary, degrees binary, links binary"


class SmallWorldIndex:
    """``shards``: one row for each graph of a partition and vector size, with its vectors and links packed; ``dead`` marks
    the nodes that are deleted: they lead searches on but are not returned."""

    def __init__(self, shards: DataFrame, metric_name: str, shards_per_partition: int, m: int, ef_construction: int, seed: int = 9):
        self.shards, self.metric_name = shards, metric_name
        self.count, self.m, self.ef_construction, self.seed = shards_per_partition, m, ef_construction, seed

    @property
    def _kind(self) -> str:
        return self.shards.schema["ids"].dataType.elementType.simpleString()

    def _with(self, shards: DataFrame) -> SmallWorldIndex:
        return SmallWorldIndex(cut_lineage(shards), self.metric_name, self.count, self.m, self.ef_construction, self.seed)

    def _placed(self, records: DataFrame, vector: str = "vector") -> DataFrame:
        """(partition_id, dim, shard, id, vector) of the records an index holds; a record's shard follows its id."""
        part = F.col("partition_id").cast("string") if "partition_id" in records.columns else F.lit("")
        rows = records.where(F.size(vector) > 0).select(part.alias("partition_id"), "id", F.col(vector).cast("array<double>").alias("vector"))
        return rows.withColumn("dim", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(self.count)).cast("int"))

    @classmethod
    def build(cls, records: DataFrame, metric_name: str = "euclidean", m: int = 16, ef_construction: int = 200, seed: int = 9, vector: str = "vector") -> SmallWorldIndex:
        """Every partition and vector size has its own graphs."""
        by = ["partition_id"] if "partition_id" in records.columns else []
        largest = records.where(F.size(vector) > 0).groupBy(*by).count().agg(F.max("count")).first()[0] or 1
        kind = dict(records.dtypes)["id"]
        empty = records.sparkSession.createDataFrame([], _SHARD.format(kind=kind))
        return cls(empty, metric_name, -(-largest // SHARD_ROWS), m, ef_construction, seed).insert(records, vector)

    def insert(self, records: DataFrame, vector: str = "vector") -> SmallWorldIndex:
        """The index with the records linked into its graphs; an id that is there already is replaced.

        Only the shards of the new records are opened. A shard with more than ``REBUILD`` dead nodes is built anew.
        """
        name, m, ef, seed, kind = metric(self.metric_name), self.m, self.ef_construction, self.seed, self._kind
        columns = [c.split()[0] for c in _SHARD.split(", ")]

        def grow(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            if not len(new):
                return old[columns]
            new = new.drop_duplicates("id", keep="last").sort_values("id", kind="stable")
            v = np.stack([np.asarray(x, np.float64) for x in new["vector"]])
            ids, dead = list(new["id"]), np.zeros(len(new), bool)
            if len(old):
                row = old.iloc[0]
                was, gone = list(row["ids"]), np.frombuffer(row["dead"], bool).copy()
                fresh = set(ids)
                gone |= np.array([i in fresh for i in was], bool)
                before = np.frombuffer(row["vectors"], np.float64).reshape(-1, v.shape[1])
                if gone.mean() > REBUILD:
                    v, ids, dead = np.concatenate([before[~gone], v]), [i for i, g in zip(was, gone) if not g] + ids, np.zeros((~gone).sum() + len(dead), bool)
                    g = Graph(v, name, m, ef, seed).build()
                else:
                    g = Graph.unpacked(row, v.shape[1], name, m, ef)
                    levels = Graph(np.concatenate([before, v]), name, m, ef, seed).levels
                    g.v, g.levels = np.concatenate([before, v]), np.concatenate([g.levels, levels[len(before) :]])
                    g.build()
                    ids, dead = was + ids, np.concatenate([gone, dead])
            else:
                g = Graph(v, name, m, ef, seed).build()
            keys = new.iloc[0]
            return pd.DataFrame([{"partition_id": keys["partition_id"], "dim": keys["dim"], "shard": keys["shard"], "ids": ids, "dead": dead.tobytes(), "entry": g.entry, **g.packed()}])[columns]

        keys = ["partition_id", "dim", "shard"]
        grown = self.shards.groupBy(*keys).cogroup(self._placed(records, vector).groupBy(*keys)).applyInPandas(grow, _SHARD.format(kind=kind))
        return self._with(grown)

    def remove(self, ids: DataFrame) -> SmallWorldIndex:
        """The index without these ids: their nodes still lead searches on but are not returned."""
        marks = ids.select("id").distinct().withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(self.count)).cast("int"))
        gone = marks.groupBy("shard").agg(F.collect_list("id").alias("gone__"))

        @F.pandas_udf("binary")
        def marked(names: pd.Series, dead: pd.Series, gone: pd.Series) -> pd.Series:
            out = []
            for n, d, g in zip(names, dead, gone):
                out.append((np.frombuffer(d, bool) | np.isin(np.asarray(n, object), list(g))).tobytes() if g is not None else d)
            return pd.Series(out, dtype=object)

        wide = self.shards.join(gone, "shard", "left").withColumn("dead", marked("ids", "dead", "gone__"))
        return self._with(wide.select(*self.shards.columns))

    def save(self, path: str) -> None:
        about = [F.lit(x).alias(c) for c, x in (("metric", self.metric_name), ("shards", self.count), ("m", self.m), ("ef", self.ef_construction), ("seed", self.seed))]
        self.shards.write.mode("overwrite").partitionBy("partition_id").parquet(f"{path}/shards")
        self.shards.sparkSession.range(1).select(*about).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark, path: str) -> SmallWorldIndex:
        about = spark.read.parquet(f"{path}/about").first()
        shards = spark.read.parquet(f"{path}/shards").withColumn("partition_id", F.col("partition_id").cast("string"))
        kind = shards.schema["ids"].dataType.elementType.simpleString()
        return cls(shards.select(*[c.split()[0] for c in _SHARD.format(kind=kind).split(", ")]), about.metric, about.shards, about.m, about.ef, about.seed)

    def batch_search(self, queries: DataFrame, k: int = 10, ef_search: int = 50, where: DataFrame | None = None, partition_ids: Sequence[str] | None = None) -> DataFrame:
        """(query_id, rank, partition_id, id, dist) of up to ``QUERY_BLOCK`` counted queries (query_id, qvector).

        Each shard is opened once and walked by all queries of its size. ``where`` holds the ids that may be returned (a
        filtered selection); it is gathered shard by shard. Graphs are walked over all nodes; results come from the
        ``max(k, ef_search)`` nearest seen.
        """
        q = queries.where(F.size("qvector") > 0).select("query_id", F.col("qvector").cast("array<double>").alias("qvector"))
        n = q.count()
        if n > QUERY_BLOCK:
            raise ValueError(f"{n} queries at once; search them in blocks of {QUERY_BLOCK}")
        local = q.toPandas()
        name, kind = metric(self.metric_name), self._kind
        rows = restricted(self.shards, None, partition_ids).withColumn("ok__", F.lit(None).cast(f"array<{kind}>"))
        if where is not None:
            # a shard without allowed ids is not opened
            ok = where.select("id").distinct().groupBy(F.pmod(F.xxhash64("id"), F.lit(self.count)).cast("int").alias("shard")).agg(F.collect_list("id").alias("ok__"))
            rows = rows.drop("ok__").join(ok, "shard")

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, row in batch.iterrows():
                    names = np.asarray(row["ids"], object)
                    live = ~np.frombuffer(row["dead"], bool)
                    if row["ok__"] is not None:
                        live &= np.isin(names, list(row["ok__"]))
                    if not live.any():
                        continue
                    g = Graph.unpacked(row, int(row["dim"]), name)
                    # a selective filter widens the beam by what it rejects
                    ef = int(min(len(names), max(k, ef_search) / live.mean())) or 1
                    for query, v in zip(local["query_id"], local["qvector"]):
                        if len(v) != row["dim"]:
                            continue
                        found = [(d, n) for d, n in g.search(np.asarray(v, np.float64), ef) if live[n]][:k]
                        yield pd.DataFrame({"query_id": query, "k": k, "partition_id": row["partition_id"], "id": [names[n] for _, n in found], "dist": [d for d, _ in found]})

        found = rows.mapInPandas(walk, f"query_id {dict(q.dtypes)['query_id']}, k int, partition_id string, id {kind}, dist double")
        best = F.col("dist").desc() if name.similarity else F.col("dist").asc()
        out = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(best, "id"))).where(F.col("rank") <= k)
        return out.select("query_id", F.col("rank").cast("int").alias("rank"), "partition_id", "id", "dist")

    def search(self, query: Sequence[float], k: int = 10, ef_search: int = 50, where: DataFrame | None = None, partition_ids: Sequence[str] | None = None) -> DataFrame:
        """(partition_id, id, dist): the k nearest of all graphs of the query's size, as :meth:`batch_search` finds them."""
        q = self.shards.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id int, qvector array<double>")
        return self.batch_search(q, k, ef_search, where, partition_ids).orderBy("rank").select("partition_id", "id", "dist")

    def edge_table(self) -> DataFrame:
        """(partition_id, dim, shard, level, src, dst)."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, row in batch.iterrows():
                    levels = np.frombuffer(row["levels"], np.int32)
                    node = np.repeat(np.arange(len(levels)), levels)
                    level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
                    degree = np.frombuffer(row["degrees"], np.int32)
                    yield pd.DataFrame({"partition_id": row["partition_id"], "dim": row["dim"], "shard": row["shard"], "level": np.repeat(level, degree).astype(np.int32), "src": np.repeat(node, degree).astype(np.int32), "dst": np.frombuffer(row["links"], np.int32)})

        return self.shards.mapInPandas(run, "partition_id string, dim int, shard int, level int, src int, dst int")

    def stats(self) -> DataFrame:
        """(partition_id, dim, level, nodes, mean_degree)."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, row in batch.iterrows():
                    levels = np.frombuffer(row["levels"], np.int32)
                    level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
                    nodes = np.bincount(level)
                    yield pd.DataFrame({"partition_id": row["partition_id"], "dim": row["dim"], "level": np.arange(len(nodes)), "nodes": nodes, "links": np.bincount(level, weights=np.frombuffer(row["degrees"], np.int32))})

        per = self.shards.mapInPandas(run, "partition_id string, dim int, level int, nodes long, links double")
        return per.groupBy("partition_id", "dim", "level").agg(F.sum("nodes").alias("nodes"), (F.sum("links") / F.sum("nodes")).alias("mean_degree"))
