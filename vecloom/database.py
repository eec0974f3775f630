"""A vector database over DataFrames: records, partitions, indexes, search, statistics and events in one object."""

from __future__ import annotations

import datetime
import json
import threading
import time
from collections import OrderedDict, defaultdict, deque
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import config as make_config
from .functions.filters import lookup
from .functions.metrics import metric
from .operators import cluster, graph, monitor, mutations, stats
from .operators.index.hnsw import SmallWorldIndex
from .operators.index.ivf import ClusterIndex
from .operators.index.lsh import SignHashIndex
from .operators.index.pq import ProductQuantizer
from .operators.rerank import rerank
from .operators.search import batch_nearest, nearest, restricted
from .schema import PARTITIONS, RECORDS, check_k, check_vector, encode_id, id_matches, keyed, partition_name_ok, plain, prefer_text_id
from .session import cut_lineage, ship_package
from .sources.store import MOST_VERSIONS, VersionedTable

INDEX_KINDS = ("ivf", "lsh", "pq", "hnsw")
_COLUMNS = [f.split()[0] for f in RECORDS.split(", ")]


class Database:
    """Every change makes a new version of the records: of the Parquet table at ``path``, or checkpointed without one.

    All partitions are searched; ids are unique in the database, 1 and "1" are different ids, and a later write wins. The
    partition catalogue (one small row each) and the id counter are held here and saved with every change of either.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, strict: bool = False, **settings: Any):
        ship_package(spark)
        self.spark, self.strict = spark, strict
        self.config = make_config(path=path, **settings)
        self.path = self.config["path"]
        self.catalog: OrderedDict[str, dict[str, Any]] = OrderedDict()
        self.indexes: dict[str, Any] = {}
        self.listeners: dict[str, list[Callable[[dict], None]]] = defaultdict(list)
        self.log: deque = deque(maxlen=self.config["monitoring"]["window"])
        self.cache: OrderedDict = OrderedDict()
        self.timer = monitor.Timer()
        self.version = 0
        self.counter = 1
        self.closed = False
        self.records = spark.createDataFrame([], RECORDS)
        self.history: deque = deque(maxlen=self.config["monitoring"]["history"])
        self._snapped = time.time()
        self._writing = threading.RLock()
        self._table = VersionedTable(spark, f"{self.path}/records", "partition_id") if self.path else None
        if self._table and (self._table.current() or self._table.state()):
            self.load()

    # --- events -------------------------------------------------------------------------------------------------

    def on(self, event: str, f: Callable[[dict], None]) -> None:
        """Call ``f`` with the details of each event of a name; '*' means every event."""
        self.listeners[event].append(f)

    def _emit(self, event: str, **details: Any) -> None:
        for f in [*self.listeners[event], *self.listeners["*"]]:
            f({"event": event, "at": time.time(), **details})

    # --- versions ------------------------------------------------------------------------------------------------

    def _state(self) -> dict[str, Any]:
        return {"partitions": list(self.catalog.values()), "counter": self.counter}

    def _commit(self, touched: Iterable[str], change: Callable[[DataFrame], DataFrame], added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Make a new version in which ``change`` was applied to the records of the ``touched`` partitions, together with
        the catalogue and the counter. Only these partitions are written.

        Graphs take the rows that were ``added`` and drop those that were ``removed``; the other indexes are dropped.
        """
        touched = list(touched)
        inside = F.col("partition_id").isin(touched)
        changed = change(self.records.where(inside)).select(*_COLUMNS)
        if self._table:
            self._table.save_partitions(changed, touched, self._state())
            self.records = self._table.load(RECORDS)
        else:
            # untouched records stay in the checkpoints they are in; now and then all are brought into one
            self.records = self.records.where(~inside).select(*_COLUMNS).unionByName(cut_lineage(changed))
            if self.version % MOST_VERSIONS == MOST_VERSIONS - 1:
                self.records = cut_lineage(self.records)
        self.version += 1
        self.cache.clear()
        graph_index = self.indexes.get("hnsw") if added is not None or removed is not None else None
        self.indexes.clear()
        if graph_index is not None:
            if removed is not None:
                graph_index = graph_index.remove(keyed(removed))
            if added is not None:
                graph_index = graph_index.insert(keyed(added))
            self.indexes["hnsw"] = graph_index

    def _partitions_of(self, ids: DataFrame) -> set[str]:
        """The partitions that hold records of these (id, id_is_num)."""
        held = self.records.select("partition_id", "id", "id_is_num").join(ids.select("id", "id_is_num").distinct(), ["id", "id_is_num"], "left_semi")
        return {r[0] for r in held.select("partition_id").distinct().collect()}

    def _changed(self) -> None:
        """Keep the catalogue as soon as it changes."""
        if self._table and self.config["auto_save"]:
            self._table.save_state(self._state())

    def save(self) -> None:
        """Save the catalogue and the counter; records are saved by every change."""
        if self._table and self._table.state() != self._state():
            self._table.save_state(self._state())
        self._emit("db:save", path=self.path)

    def load(self) -> None:
        saved_records = self._table.load(RECORDS) if self._table else None
        self.records = self.records if saved_records is None else saved_records
        saved = self._table.state() if self._table else None
        if saved is not None:
            self.catalog = OrderedDict((p["partition_id"], p) for p in saved["partitions"])
        self.counter = mutations.next_counter(self.records, 1 if saved is None else saved["counter"])
        self._emit("db:load", path=self.path)

    def close(self) -> None:
        """Save and refuse further use; closing twice is harmless."""
        if not self.closed:
            self.save()
            self.closed = True
            self._emit("db:close")

    def _check_open(self) -> None:
        if self.closed:
            raise RuntimeError("the database is closed")

    # --- partitions ----------------------------------------------------------------------------------------------

    def create_partition(self, partition_id: str, name: str | None = None, active: bool = False, capacity: int | None = None, description: str | None = None) -> str:
        """A new partition; the first becomes active. Ids are letters, digits, dots, underscores and hyphens."""
        if not partition_name_ok(partition_id):
            raise ValueError("a partition id has letters, digits, '.', '_' and '-' only")
        if partition_id in self.catalog:
            raise ValueError(f"partition {partition_id!r} exists")
        first = not self.catalog
        self.catalog[partition_id] = {"partition_id": partition_id, "partition_name": name or partition_id, "active": False, "capacity": capacity or self.config["partitioning"]["capacity"], "description": description}
        if active or first:
            self.set_active_partition(partition_id)
        self._changed()
        self._emit("partition:create", id=partition_id)
        return partition_id

    def set_active_partition(self, partition_id: str) -> None:
        if partition_id not in self.catalog:
            raise KeyError(partition_id)
        for p in self.catalog.values():
            p["active"] = p["partition_id"] == partition_id
        self._changed()
        self._emit("partition:activate", id=partition_id)

    def active_partition(self) -> str | None:
        return next((k for k, p in self.catalog.items() if p["active"]), None)

    def partition(self, partition_id: str) -> DataFrame:
        return self.records.where(F.col("partition_id") == partition_id)

    def partitions(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.catalog.values()), PARTITIONS) if self.catalog else self.spark.createDataFrame([], PARTITIONS)

    def _next_partition(self) -> str:
        n = len(self.catalog) + 1
        while f"p{n}" in self.catalog:
            n += 1
        return self.create_partition(f"p{n}", active=True)

    # --- writes --------------------------------------------------------------------------------------------------

    def add_vector(self, vector: Sequence[float], id: int | str | None = None, metadata: dict | None = None) -> str:
        """Write one record and return its id as text; a null id is numbered from the counter."""
        values = check_vector(vector, self.config["vector"]["size"] if self.strict else None, self.strict)
        self.bulk_add([{"id": id, "vector": values, "metadata": metadata}])
        return str(self.counter - 1) if id is None else str(id)

    def bulk_add(self, items: DataFrame | Iterable[dict], skip_bad: bool = False, stamp: bool = False, progress: Callable[[float, str], None] | None = None) -> dict[str, Any]:
        """Write records in order: a DataFrame (id, id_is_num, vector, metadata, and seq for the order) or dicts.

        The active partition is filled to its capacity, then new ones are made. An id written before keeps its
        partition's place only if it is written again there: the new row wins and is counted once. ``skip_bad`` leaves out
        dicts without a usable vector and reports their places; ``stamp`` adds dimension and createdAt to the metadata.
        ``progress`` is called with a share and a word. Returns the count and the partitions written to. Writers of one
        database take turns.
        """
        with self._writing:
            return self._bulk_add(items, skip_bad, stamp, progress or (lambda share, step: None))

    def _bulk_add(self, items: DataFrame | Iterable[dict], skip_bad: bool, stamp: bool, progress: Callable[[float, str], None]) -> dict[str, Any]:
        self._check_open()
        skipped: list[int] = []
        if not isinstance(items, DataFrame):
            rows, now = [], datetime.datetime.now(datetime.timezone.utc).isoformat()
            for i, x in enumerate(items):
                try:
                    text, number = (None, None) if x.get("id") is None else encode_id(x["id"])
                    vector = check_vector(x["vector"], strict=skip_bad)
                except (KeyError, TypeError, ValueError):
                    if not skip_bad:
                        raise
                    skipped.append(i)
                    continue
                meta = x.get("metadata")
                meta = {**(meta or {}), "dimension": len(vector), "createdAt": now} if stamp else meta
                rows.append((text, number, vector, None if meta is None else json.dumps(meta), i))
            items = self.spark.createDataFrame(rows, "id string, id_is_num boolean, vector array<float>, metadata string, seq bigint")
        batch = items.select("id", "id_is_num", F.col("vector").cast("array<float>").alias("vector"), "metadata", "seq").where("vector IS NOT NULL")
        batch = cut_lineage(mutations.numbered(batch, ["seq"]))
        count = batch.count()
        if not count:
            return {"count": 0, "partition_ids": [], "skipped": skipped}
        progress(0.2, "numbered")
        last = self.records.agg(F.max("seq")).first()[0]
        base = 0 if last is None else last + 1
        batch = cut_lineage(mutations.assign_ids(batch, self.counter))
        # numbers are never given out again, not even those of deleted records
        self.counter = mutations.next_counter(batch, self.counter)
        if self.active_partition() is None:
            self._next_partition()
        first = self.active_partition()
        capacity = self.catalog[first]["capacity"]
        held = self.partition(first).count()
        names, room = [first], capacity - held
        while count > max(room, 0) and len(names) * capacity - held < count:
            if not self.config["partitioning"]["auto_create"]:
                raise RuntimeError(f"partition {first!r} is full")
            names.append(self._next_partition())
            self.catalog[names[-1]]["capacity"] = capacity
        placed = mutations.spilled(batch, min(held, capacity), capacity)
        where = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("partition_no") + 1)
        new = cut_lineage(placed.select(where.alias("partition_id"), "id", "id_is_num", (F.col("pos") + base).alias("seq"), "vector", "metadata"))
        used = sorted(r[0] for r in new.select("partition_id").distinct().collect())
        progress(0.6, "placed")
        self._commit({*used, *self._partitions_of(new)}, lambda old: mutations.upsert(old, new), added=new)
        progress(1.0, "written")
        self._emit("vector:bulk" if count > 1 else "vector:add", count=count, partitions=used)
        return {"count": count, "partition_ids": used, "skipped": skipped}

    def delete_vector(self, id: int | str) -> bool:
        return self.delete_vectors([id]) == 1

    def delete_vectors(self, ids: Sequence[int | str]) -> int:
        """Delete records; unknown ids are ignored. Returns how many were there."""
        self._check_open()
        gone = self.spark.createDataFrame([encode_id(i) for i in ids], "id string, id_is_num boolean")
        n = self.records.join(gone.distinct(), ["id", "id_is_num"], "left_semi").count()
        if n:
            self._commit(self._partitions_of(gone), lambda old: mutations.delete(old, gone), removed=gone)
            self._emit("vector:delete", count=n)
        return n

    def update_vector(self, id: int | str, vector: Sequence[float]) -> bool:
        """Replace a vector, keeping its metadata; False for an unknown id."""
        if not self.has_vector(id):
            return False
        change = self.spark.createDataFrame([(*encode_id(id), check_vector(vector))], "id string, id_is_num boolean, vector array<float>")
        placed = cut_lineage(change.join(self.records.select("id", "id_is_num", "partition_id"), ["id", "id_is_num"]))
        self._commit(self._partitions_of(change), lambda old: mutations.update_vectors(old, change), added=placed)
        return True

    def set_metadata(self, id: int | str, metadata: dict | None) -> bool:
        """Replace the whole metadata; False for an unknown id."""
        return self._patch(id, mutations.replace_metadata, None if metadata is None else json.dumps(metadata))

    def update_metadata(self, id: int | str, change: dict | Callable[[dict | None], dict | None]) -> bool:
        """Shallow merge of a dict, or a function of the current metadata; False for an unknown id."""
        if callable(change):
            if not self.has_vector(id):
                return False
            self._commit(self._partitions_of(self._ids(id)), lambda old: mutations.map_metadata(old, change, id_matches(id)))
            return True
        return self._patch(id, mutations.merge_metadata, json.dumps(change))

    def _patch(self, id: int | str, how: Callable, patch: str | None) -> bool:
        self._check_open()
        if not self.has_vector(id):
            return False
        rows = self.spark.createDataFrame([(*encode_id(id), patch)], "id string, id_is_num boolean, patch string")
        self._commit(self._partitions_of(rows), lambda old: how(old, rows))
        return True

    def _ids(self, *ids: int | str) -> DataFrame:
        return self.spark.createDataFrame([encode_id(i) for i in ids], "id string, id_is_num boolean")

    # --- reads ---------------------------------------------------------------------------------------------------

    def _row(self, id: int | str):
        return self.records.where(id_matches(id)).first()

    def find(self, spelled: str) -> DataFrame:
        """The record of an id given as text: the text id, else the number it spells."""
        return prefer_text_id(self.records, spelled)

    def get_vector(self, id: int | str) -> list[float] | None:
        row = self._row(id)
        return None if row is None else row.vector

    def has_vector(self, id: int | str) -> bool:
        return not self.records.where(id_matches(id)).limit(1).isEmpty()

    def get_metadata(self, id: int | str) -> dict | None:
        row = self._row(id)
        return None if row is None or row.metadata is None else json.loads(row.metadata)

    def vector_dimension(self, id: int | str) -> int | None:
        v = self.get_vector(id)
        return None if v is None else len(v)

    def metadata_search(self, criteria, values=None, limit: int | None = None, include_vectors: bool = False, partition_ids: Sequence[str] | None = None) -> DataFrame:
        rows = lookup(restricted(self.records, None, partition_ids), criteria, values, limit, order="seq")
        return rows if include_vectors else rows.drop("vector")

    # --- indexes -------------------------------------------------------------------------------------------------

    def build_index(self, kind: str, partition_ids: Sequence[str] | None = None, progress: Callable[[float, str], None] | None = None, **parameters: Any) -> Any:
        """Build an index over all records, or those of some partitions. Indexes hold keys that tell 1 from "1".

        A change of records drops it, but a graph follows insertions and deletions. ``progress`` is called with a share
        and a word.
        """
        progress = progress or (lambda share, step: None)
        progress(0.0, kind)
        if kind not in INDEX_KINDS:
            raise ValueError(f"unknown index {kind!r}; known: {', '.join(INDEX_KINDS)}")
        records = keyed(restricted(self.records, None, partition_ids))
        with self.timer.measure(f"index:{kind}"):
            if kind == "ivf":
                n = parameters.pop("clusters", None) or max(1, records.count() // self.config["clustering"]["cluster_size"])
                index = ClusterIndex.build(records, n, **parameters)
            elif kind == "lsh":
                c = self.config["lsh"]
                index = SignHashIndex.build(records, **{"tables": c["tables"], "hashes": c["hashes"], "buckets": c["buckets"], **parameters})
            elif kind == "pq":
                pq = ProductQuantizer.train(records, **{"clusters": self.config["pq"]["clusters"], **parameters})
                index = (pq, cut_lineage(pq.encode(records)))
            else:
                c = self.config["hnsw"]
                index = SmallWorldIndex.build(records, **{"m": c["m"], "ef_construction": c["ef_construction"], **parameters})
        self.indexes[kind] = index
        progress(1.0, kind)
        self._emit("index:build", kind=kind)
        return index

    # --- search --------------------------------------------------------------------------------------------------

    def search(
        self,
        query: Sequence[float],
        k: int | None = None,
        method: str = "exact",
        metric_name: str | None = None,
        filter: Any = None,
        partition_ids: Sequence[str] | None = None,
        rerank_method: str | None = None,
        weights: dict[str, float] | None = None,
        balance: float = 0.7,
        fetch_k: int | None = None,
        offset: int = 0,
        include_metadata: bool = False,
        include_vectors: bool = False,
        nprobe: int | None = None,
        probes: int | None = None,
        ef_search: int | None = None,
        use_cache: bool = False,
    ) -> DataFrame:
        """(query_id, rank, id, id_is_num, dist[, metadata, vector][, weighted_score]) of one query, nearest first.

        Every method honours filter, partitions and metric (pq and hnsw: the metric they were built for). ``fetch_k``
        gives the reranker more than k results to choose from. Methods without a built index are refused.
        """
        self._check_open()
        c = self.config
        k = check_k(c["vector"]["k"] if k is None else k, self.strict)
        name = metric(metric_name or c["vector"]["metric"]).name
        key = (self.version, tuple(query), k, method, name, repr(filter), tuple(partition_ids or ()), rerank_method, repr(weights), balance, fetch_k, offset, include_metadata, include_vectors, nprobe, probes, ef_search)
        cacheable = use_cache and not callable(filter) and filter.__class__.__name__ != "Column"
        if cacheable and key in self.cache:
            self.cache.move_to_end(key)
            self._logged(method, 0.0, k, True)
            return self.cache[key]
        began = time.perf_counter()
        n = max(fetch_k or k, k) + offset
        try:
            found = self._nearest(query, n, method, name, filter, partition_ids, nprobe, probes, ef_search)
        except Exception as e:
            self._logged(method, (time.perf_counter() - began) * 1000, k, None, f"{type(e).__name__}: {e}"[:500])
            raise
        best = F.col("dist").desc() if metric(name).similarity else F.col("dist").asc()
        rows = cut_lineage(found)
        records = keyed(self.records)
        # at most fetch_k + offset rows
        ranked = rows.select(F.lit(0).cast("bigint").alias("query_id"), F.row_number().over(Window.orderBy(best, "id")).cast("int").alias("rank"), "id", "dist")
        wide = ranked.where(F.col("rank") > offset).withColumn("rank", F.col("rank") - offset)
        if include_metadata or rerank_method == "weighted":
            wide = wide.join(records.select("id", "metadata"), "id", "left")
        out = rerank(wide, rerank_method, records, weights, k, **({"balance": balance, "metric_name": name} if rerank_method == "diversity" else {})).where(F.col("rank") <= k)
        if not include_metadata and "metadata" in out.columns:
            out = out.drop("metadata")
        if include_vectors:
            out = out.join(records.select("id", "vector"), "id", "left")
        rest = [c for c in out.columns if c not in ("query_id", "rank", "id")]
        out = cut_lineage(out.orderBy("rank").select("query_id", "rank", *plain("id"), *rest))
        if cacheable:
            self.cache[key] = out
            while len(self.cache) > c["vector"]["cache_size"]:
                self.cache.popitem(last=False)
        self._logged(method, (time.perf_counter() - began) * 1000, k, False if use_cache else None)
        return out

    def _nearest(self, query, n, method, name, filter, partition_ids, nprobe, probes, ef_search) -> DataFrame:
        c = self.config
        penalty = c["vector"]["mismatch_penalty"]
        if method == "exact":
            # equal distances go by arrival: the filter sees the ids themselves, the rest their keys
            return nearest(keyed(restricted(self.records, filter, partition_ids)), query, n, name, order="seq", penalty=penalty).select("id", "dist")
        if method not in self.indexes:
            raise ValueError(f"no {method!r} index was built" if method in INDEX_KINDS else f"unknown method {method!r}")
        index = self.indexes[method]
        if callable(filter) and not isinstance(filter, Column):
            on_id = filter
            filter = lambda key, meta: on_id(key[1:], meta)
        if method == "ivf":
            return index.search(query, n, nprobe, name, where=filter, partition_ids=partition_ids, penalty=penalty)
        if method == "lsh":
            return index.search(query, n, c["lsh"]["probes"] if probes is None else probes, name, where=filter, partition_ids=partition_ids)
        if method == "pq":
            pq, coded = index
            return pq.search(restricted(coded, filter, partition_ids), query, n, exact_from=4 * n)
        allowed = None if filter is None else restricted(keyed(self.records), filter, partition_ids)
        return index.search(query, n, ef_search or c["hnsw"]["ef_search"], allowed, partition_ids).select("id", "dist")

    def batch_search(self, queries: DataFrame | Sequence[Sequence[float]], k: int | None = None, metric_name: str | None = None, filter: Any = None, method: str = "exact", **options: Any) -> DataFrame:
        """(query_id, rank, partition_id, id, id_is_num, dist) of many queries, a DataFrame (query_id, qvector[, k,
        partition_ids]) or vectors numbered from 0. ``method`` 'exact' searches all records (that pass ``filter``); an
        index's name searches through that index with its ``options`` (and then takes no filter)."""
        self._check_open()
        if not isinstance(queries, DataFrame):
            queries = self.spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(queries)], "query_id bigint, qvector array<double>")
        v = self.config["vector"]
        k, name = v["k"] if k is None else k, metric_name or v["metric"]
        if method == "exact":
            found = batch_nearest(keyed(restricted(self.records, filter)), queries, k, name, order="seq", penalty=v["mismatch_penalty"])
            return found.select("query_id", "rank", "partition_id", *plain("id"), "dist")
        if method not in self.indexes:
            raise ValueError(f"no {method!r} index was built" if method in INDEX_KINDS else f"unknown method {method!r}")
        if filter is not None:
            raise ValueError("a batch through an index takes no filter")
        index = self.indexes[method]
        if method == "pq":
            found = index[0].batch_search(index[1], queries, k, **options)
        elif method == "hnsw":
            found = index.batch_search(queries, k, **{"ef_search": self.config["hnsw"]["ef_search"], **options})
        else:
            found = index.batch_search(queries, k, metric_name=name, **options)
        where = keyed(self.records).select("id", "partition_id")
        return found.select("query_id", "rank", "id", "dist").join(where, "id", "left").select("query_id", "rank", "partition_id", *plain("id"), "dist")

    def similar(self, id: int | str, k: int | None = None, metric_name: str | None = None) -> DataFrame:
        """The k nearest other records of a stored one; none for an unknown id."""
        v = self.get_vector(id)
        n = self.config["vector"]["k"] if k is None else k
        if v is None:
            return self.spark.createDataFrame([], "id string, dist double")
        others = self.records.where(~id_matches(id))
        return nearest(others, v, n, metric_name or self.config["vector"]["metric"], order="seq", include=("id_is_num",))

    def relationships(self, threshold: float, **options: Any) -> DataFrame:
        """Pairs as :func:`graph.relationships` gives them, with id_a_is_num and id_b_is_num beside the ids."""
        found = graph.relationships(keyed(self.records), threshold, **options)
        return found.select(*plain("id_a"), *plain("id_b"), *[c for c in found.columns if c not in ("id_a", "id_b")])

    def communities(self, threshold: float, **options: Any) -> DataFrame:
        """Members as :func:`graph.communities` gives them, with community_is_num and id_is_num beside the ids."""
        found = graph.communities(keyed(self.records), threshold, **options)
        return found.select("partition_id", *plain("community"), *plain("id"), *[c for c in found.columns if c not in ("partition_id", "community", "id")])

    # --- statistics ----------------------------------------------------------------------------------------------

    def _logged(self, method: str, ms: float, k: int, hit: bool | None, error: str | None = None) -> None:
        self.log.append((datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None), method, float(ms), k, None, hit, error))
        self._emit("search:error" if error else "search", method=method, duration_ms=ms, cache_hit=hit)
        if time.time() - self._snapped >= self.config["monitoring"]["interval_s"]:
            self.snapshot()

    def snapshot(self) -> dict[str, Any]:
        """A line of the monitor's history: the searches since the last one. The last ``history`` lines are kept; one is
        taken with the first search after every interval."""
        since = datetime.datetime.fromtimestamp(self._snapped, datetime.timezone.utc).replace(tzinfo=None)
        mine = [x for x in self.log if x[0] >= since]
        ms = sorted(x[2] for x in mine if x[6] is None)
        span = max(time.time() - self._snapped, 1e-9)
        line = {"at": time.time(), "searches": len(mine), "errors": sum(x[6] is not None for x in mine), "avg_ms": sum(ms) / len(ms) if ms else None, "p95_ms": ms[-(-95 * len(ms) // 100) - 1] if ms else None, "queries_per_minute": len(mine) * 60 / span}
        self.history.append(line)
        self._snapped = time.time()
        return line

    def query_log(self) -> DataFrame:
        """The last searches (a bounded number)."""
        return self.spark.createDataFrame(list(self.log), monitor.LOG)

    def cluster_stats(self) -> DataFrame:
        """(cluster_id, dim, size, centroid_norm, radius) of the cluster index, counted now; no rows without one."""
        if "ivf" not in self.indexes:
            return self.spark.createDataFrame([], "cluster_id int, dim int, size bigint, centroid_norm double, radius double")
        index = self.indexes["ivf"]
        return cluster.cluster_stats(index.records.where(F.col("cluster_id").isNotNull()), index.centroids)

    def stats(self) -> dict[str, Any]:
        s = stats.collection_stats(self.records).first().asDict()
        s["dimensions"] = {r.dim: r.n for r in stats.dim_histogram(self.records).collect()}
        s |= {"partitions": len(self.catalog), "active_partition": self.active_partition(), "indexes": sorted(self.indexes), "searches": len(self.log), "errors": sum(x[6] is not None for x in self.log)}
        # as many rows as clusters were asked for
        sizes = [r["size"] for r in self.cluster_stats().select("size").collect()]
        s["clusters"] = {"count": len(sizes), "smallest": min(sizes, default=0), "largest": max(sizes, default=0), "mean": sum(sizes) / len(sizes) if sizes else 0.0}
        return s

    def partition_stats(self) -> DataFrame:
        return stats.partition_stats(self.records, self.partitions())

    def search_stats(self) -> DataFrame:
        return monitor.summary(self.query_log())

    def health(self) -> dict[str, Any]:
        return {"status": "closed" if self.closed else "ok", "version": self.version, "partitions": len(self.catalog)}
