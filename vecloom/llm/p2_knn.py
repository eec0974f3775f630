"""Most similar vectors for every vector: collision-counting hashing.

Hash functions are single projections. A vector is kept in the sorted array of each direction of
:mod:`vecloom.llm.vectors` on which it lies furthest out; vectors that hit a common direction meet in its cell. Inside
a cell the search is query-aware: ``PROBES`` further projections (:mod:`vecloom.llm.collisions`) have sorted arrays, each
vector opens a window around its own projection in every one of them, and the collisions of every other row with it are
counted. Rows at or above the threshold are verified by the exact cosine; the others are never compared. Windows grow
by virtual rehashing (``RADII``) until as many neighbours as asked for lie within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.search import batch_nearest
from ..session import cut_lineage as cut
from ..session import written
from .common import checked_broadcast, partitions, repeated_keys, stored_vectors, with_copies
from .collisions import SortedArrays, Windows, dense, members, projections, radius
from .vectors import Directions, by_size, cell_size, fit_directions, grouped, to_cells, unpack

#: Window radii as cosines, from the narrowest, and queries counted together.
RADII, TILE = (0.92, 0.85), 256
#: Below this cosine a window holds most rows whatever the query, and counting cannot tell them apart.
LEAST_RADIUS = 0.7
#: A tile in which more than one pair in so many is a candidate is verified by one matrix product.
DENSE = 12
ROWS_PER_TASK = 60_000
#: Vectors that are compared with all others at once (their block goes to every task).
OPEN_ROWS = 32_768


def best_of_rows(score: np.ndarray, least: float, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the ``take`` greatest scores of each row that are at least ``least``, by row."""
    hit = score >= least
    if hit.sum() > 6 * take * len(score):
        col = np.argpartition(score, score.shape[1] - take, axis=1)[:, -take:]
        val = np.take_along_axis(score, col, 1)
        row, col, val = np.repeat(np.arange(len(score)), take), col.ravel(), val.ravel()
        ok = val >= least
        return row[ok], col[ok], val[ok]
    at = np.flatnonzero(hit)
    return first_of_rows(at // score.shape[1], at % score.shape[1], score.ravel()[at], len(score), take)


def beyond(u: np.ndarray, v: np.ndarray, least: np.ndarray, take: int, tile: int = 1_024) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``take`` greatest products of each row of ``u`` with the columns of ``v`` that reach ``least`` of
    the row. Tiles stay in the cache, and most rows are done with their greatest product."""
    rows, cols = [], []
    least = least.astype(np.float32)
    for s in range(0, len(u), tile):
        score = u[s : s + tile] @ v
        hit = np.flatnonzero(score.max(1) >= least[s : s + tile])
        if not len(hit):
            continue
        score = score[hit]
        at = np.flatnonzero(score >= least[s + hit][:, None])
        r, c, _ = first_of_rows(at // score.shape[1], at % score.shape[1], score.ravel()[at], len(score), take)
        rows.append(s + hit[r])
        cols.append(c)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def first_of_rows(row: np.ndarray, col: np.ndarray, val: np.ndarray, rows: int, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the ``take`` greatest scores of each row, by row; the input is by row, too."""
    order = np.argsort(row - val * 0.25, kind="stable")
    row, col, val = row[order], col[order], val[order]
    ok = np.arange(len(row)) - np.searchsorted(row, np.arange(rows))[row] < take
    return row[ok], col[ok], val[ok]


def sparse_scores(u: np.ndarray, v: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products of the rows u[q] and v[c]."""
    out = np.empty(len(q), np.float32)
    for s in range(0, len(q), 1 << 15):
        out[s : s + (1 << 15)] = np.einsum("ij,ij->i", u[q[s : s + (1 << 15)]], v[c[s : s + (1 << 15)]])
    return out


def top_of_array(u: np.ndarray, v: np.ndarray, k: int, min_cosine: float, same: bool, work: np.ndarray | None = None, radii: tuple[float, ...] = RADII) -> tuple[np.ndarray, np.ndarray]:
    """(query row, neighbour row) of at least the k best rows of ``v`` for each row of ``u`` with cosine >= min_cosine.

    Both hold unit rows. With ``same`` the rows of ``u`` are the first of ``v``, and a row is not its own neighbour. Two spare places are
    returned, so that the caller can settle single-precision near-ties with exact cosines. ``work`` is added the pairs
    there are, and the pairs that were verified.
    """
    none = np.zeros(0, np.int64)
    if not len(u) or not len(v):
        return none, none
    take = min(k + 2, len(v))
    axes = projections(v)
    pu = u @ axes
    arrays = SortedArrays(v @ axes)
    waiting, out_q, out_n = np.arange(len(u)), [], []
    # without a useful least radius what is still open in the end is compared with every row
    ladder = [c for c in radii if c > min_cosine] + [min_cosine if min_cosine >= LEAST_RADIUS else None]
    if work is not None:
        work[0] += len(u) * len(v)
    for cos in ladder:
        windows = None if cos is None or not len(waiting) else Windows(arrays, u.shape[1], radius(cos))
        last, unfinished = cos == ladder[-1], []
        for s in range(0, len(waiting), TILE):
            rows = waiting[s : s + TILE]
            words = None if windows is None else windows.candidates(pu[rows])
            hit = len(rows) * len(v) if words is None else int(np.bitwise_count(words).sum())
            if work is not None:
                work[1] += hit
            if words is None or hit * DENSE > len(rows) * len(v):
                score = u[rows] @ v.T
                if words is not None:
                    score[~dense(words, len(v))] = -2
                if same:
                    score[np.arange(len(rows)), rows] = -2
                r, c, value = best_of_rows(score, min_cosine - 1e-5, take)
            else:
                r, c = members(words)
                value = sparse_scores(u[rows], v, r, c)
                near = value >= min_cosine - 1e-5
                if same:
                    near &= rows[r] != c
                r, c, value = first_of_rows(r[near], c[near], value[near], len(rows), take)
            if not last:
                # a query is done when as many neighbours as asked for lie within the radius
                done = np.bincount(r[value >= cos], minlength=len(rows)) >= take
                unfinished.append(rows[~done])
                r, c = r[done[r]], c[done[r]]
            out_q.append(rows[r])
            out_n.append(c)
        waiting = np.concatenate(unfinished) if unfinished else waiting[:0]
    return np.concatenate(out_q), np.concatenate(out_n)


def nearness(cos: np.ndarray, ids: pa.Array) -> pa.Array:
    """Strings whose order is by cosine descending, then id: seven digits of 1 - cosine in millionths, and the id."""
    digits = pc.utf8_lpad(pa.array(np.rint((1 - cos) * 1e6).astype(np.int64)).cast(pa.string()), 7, "0")
    return pc.binary_join_element_wise(digits, ids, "")


def _id(near: Column) -> Column:
    return F.substring(near, 8, 2_147_483_647)


def _cosine(near: Column) -> Column:
    return F.round(1 - F.substring(near, 1, 7).cast("int") / 1e6, 6)


def neighbours_in_cells(k: int, min_cosine: float):
    """A mapInArrow function from the rows of cells to (rep, near: the k + 1 nearest ids of the cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, cell in grouped(batches):
            w = unpack(cell.column("packed"), cell_size(code)).astype(np.float64)
            w /= np.sqrt((w * w).sum(1))[:, None]
            u = w.astype(np.float32)
            lists = cell.column("ids").combine_chunks()
            n_ids = lists.value_lengths().to_numpy()
            ids, start = lists.flatten(), np.cumsum(n_ids) - n_ids
            side, own = cell.column("side").to_numpy(), cell.column("own").to_numpy()
            # visitors are compared with the rows at home here, for close neighbours; two visitors meet in a cell of theirs
            (a, at_a), (b, at_b) = [(np.flatnonzero(own & (side == s)), np.flatnonzero(~own & (side == s))) for s in (False, True)]
            close = max(min_cosine, RADII[-1])
            if not len(b) + len(at_b):
                met = [(a, np.concatenate([a, at_a]), True, min_cosine), (at_a, a, False, close)]
            else:
                met = [(a, np.concatenate([b, at_b]), False, min_cosine), (at_a, b, False, close), (b, np.concatenate([a, at_a]), False, min_cosine), (at_b, a, False, close)]
            found = [(x, y, top_of_array(u[x], u[y], k + 1, least, same)) for x, y, same, least in met]
            q, n = np.concatenate([x[r] for x, _, (r, _) in found]), np.concatenate([y[c] for _, y, (_, c) in found])
            cos = np.round(np.einsum("ij,ij->i", w[q], w[n]), 6)
            copies = np.flatnonzero(n_ids > 1)
            q, n, cos = np.concatenate([q, copies]), np.concatenate([n, copies]), np.concatenate([cos, np.ones(len(copies))])
            keep = cos >= min_cosine
            q, n, cos = q[keep], n[keep], cos[keep]
            if not len(q):
                continue
            times = n_ids[n]
            member = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[n], times)
            q, cos = np.repeat(q, times), np.repeat(cos, times)
            rank = np.empty(len(ids), np.int64)
            rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            order = np.lexsort((rank[member], -cos, q))
            q, cos, member = q[order], cos[order], member[order]
            groups, first = np.unique(q, return_index=True)
            ok = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) <= k
            q, cos, member = q[ok], cos[ok], member[ok]
            offsets = np.append(np.searchsorted(q, groups), len(q))
            items = nearness(cos, ids.take(pa.array(member)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(start[groups])), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)], names=["rep", "near"])

    return run


def class_rows(records: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """(ids, vector) with one row for each distinct vector, ids its k + 1 least ids; and (id, rep) of the copies.

    Only copies are shuffled; of a vector with any number of copies each task sends k + 1 ids at most.
    """
    hashed = records.select("id", F.xxhash64("vector").alias("h"))
    keys, n = repeated_keys(hashed, "h")
    if n == 0:
        return records.select(F.array("id").alias("ids"), "id", "vector"), None
    side = checked_broadcast(keys, n)
    with_h = records.withColumn("h", F.xxhash64("vector"))
    single = with_h.join(side, "h", "left_anti").select(F.array("id").alias("ids"), "id", "vector")
    again = written(with_h.join(side, "h", "left_semi"))
    least = again.withColumn("rn", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("rn") <= k + 1)
    one = least.groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min_by("vector", "id").alias("vector"))
    members = cut(again.select("id", "h").join(checked_broadcast(one.select("h", F.col("ids")[0].alias("rep")), n), "h").select("id", "rep"))
    return single.unionByName(one.select("ids", F.col("ids")[0].alias("id"), "vector")), members


def nearest_classes(records: DataFrame, k: int, min_cosine: float, rows: int, fit: Directions | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rep, near array<string>) of every distinct vector with a neighbour: its k + 1 nearest ids as :func:`nearness`, copies
    of its own included; (ids, id, vector) of the distinct vectors; (id, rep) of copies."""
    fit = fit or fit_directions(records, rows)
    distinct, members = class_rows(records, k)
    cells = distinct.mapInArrow(to_cells(fit, "ids"), "cell long, home boolean, own boolean, side boolean, ids array<string>, packed binary")
    spread = cells.select("cell", "own", "side", "ids", "packed").repartition(partitions(records.sparkSession, fit.copies * rows, ROWS_PER_TASK), "cell")
    near = spread.mapInArrow(neighbours_in_cells(k, min_cosine), "rep string, near array<string>")
    return _merged(near, k), distinct, members


def _merged(near: DataFrame, k: int) -> DataFrame:
    return near.groupBy("rep").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k + 1).alias("near"))


def _of_records(merged: DataFrame, members: DataFrame | None, k: int) -> DataFrame:
    """(id, near) of every record: the k nearest other ids."""
    merged = with_copies(merged, members, "rep", "id")
    own = F.filter("near", lambda x: _id(x) != F.col("id"))
    return merged.select("id", F.slice(own, 1, k).alias("near")).where(F.size("near") > 0)


def knn_lists(records: DataFrame, k: int, min_cosine: float, rows: int, fit: Directions | None = None) -> DataFrame:
    """(id, near array<string>): the k nearest of each record by cosine descending, then id, as :func:`nearness`.

    Records with no neighbour of at least ``min_cosine`` have no row. Vectors of different sizes never meet. Copies of
    one vector are compared once and their ids put back. Empty input gives no rows; null, empty, all-zero and
    non-finite vectors take no part.
    """
    merged, _, members = nearest_classes(records, k, min_cosine, rows, fit)
    return _of_records(merged, members, k)


def against_all(queries, k: int):
    """A mapInArrow function from (ids, id, vector) of all distinct vectors to (rep, near) of the queries: what is at least
    as near as the query's bound. ``queries`` is a broadcast of Arrow data (rep, bound, vector) of a bounded block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.ipc.open_stream(queries.value).read_all().combine_chunks()
        asked = {}
        for d, rows, m in by_size(block.column("vector")):
            w = m.astype(np.float64)
            w /= np.sqrt((w * w).sum(1))[:, None]
            asked[d] = (w, w.astype(np.float32), block.column("rep").take(pa.array(rows)).combine_chunks(), block.column("bound").to_numpy()[rows].copy())
        for batch in batches:
            for d, rows, m in by_size(batch.column("vector")):
                if d not in asked:
                    continue
                w, u, reps, bound = asked[d]
                names, ids = batch.column("id"), batch.column("ids")
                for s in range(0, len(rows), 512):
                    x = m[s : s + 512].astype(np.float64)
                    x /= np.sqrt((x * x).sum(1))[:, None]
                    q, c = beyond(u, np.ascontiguousarray(x.astype(np.float32).T), bound - 1e-5, k + 3)
                    cos = np.round(np.einsum("ij,ij->i", w[q], x[c]), 6)
                    other = pc.not_equal(reps.take(pa.array(q)), names.take(pa.array(rows[s + c]))).to_numpy(zero_copy_only=False)
                    keep = (cos >= bound[q]) & other
                    q, c, cos = q[keep], c[keep], cos[keep]
                    if not len(q):
                        continue
                    # k + 1 that are found here bound what may follow
                    lists = ids.take(pa.array(rows[s + c]))
                    times = lists.value_lengths().to_numpy()
                    group, first, n = np.unique(q, return_index=True, return_counts=True)
                    full = n > k
                    bound[group[full]] = np.maximum(bound[group[full]], np.minimum.reduceat(cos, first)[full])
                    near = nearness(np.repeat(cos, times), lists.flatten())
                    offsets = np.concatenate([[0], np.cumsum(times)])[np.append(first, len(q))]
                    yield pa.RecordBatch.from_arrays([reps.take(pa.array(group)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), near)], names=["rep", "near"])

    return run


def completed(merged: DataFrame, distinct: DataFrame, k: int, least: float = RADII[-1], block: int = OPEN_ROWS) -> DataFrame:
    """``merged`` with the lists of all vectors that lack k neighbours of cosine ``least`` made exact.

    Such vectors have no tight group around them, which is what cells and windows find. They are compared with every
    vector of their size, a bounded block at a time going to all tasks; what their cells gave bounds what is reported.
    """
    spark = distinct.sparkSession
    # the list of a vector with copies holds its own ids
    wanted = F.lit(k) + F.exists("near", lambda x: _id(x) == F.col("rep")).cast("int")
    bound = F.when(F.size("near") >= wanted, _cosine(F.element_at("near", wanted))).otherwise(-1.0)
    lists = merged.withColumn("bound", bound)
    open_ = written(lists.where(F.col("bound") < least))
    n_open = open_.count()
    vectors = distinct.select(F.col("id").alias("rep"), "vector")
    without = vectors.join(merged.select("rep"), "rep", "left_anti").select("rep", F.lit(-1.0).alias("bound"), "vector")
    queries = vectors.join(checked_broadcast(open_.select("rep", "bound"), n_open), "rep").select("rep", "bound", "vector").unionByName(without)
    queries = written(queries)
    queries = queries.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(max(1, -(-queries.count() // block)))).cast("int"))
    near = open_.select("rep", "near")
    for (b,) in queries.select("block").distinct().orderBy("block").collect():
        table = queries.where(F.col("block") == b).select("rep", "bound", "vector").toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
        near = near.unionByName(written(distinct.mapInArrow(against_all(sent, k), "rep string, near array<string>")))
        sent.unpersist()
    return lists.where(F.col("bound") >= least).select("rep", "near").unionByName(_merged(near, k))


def all_neighbours(vectors: DataFrame, k: int = 5) -> DataFrame:
    """(id, rank, neighbour_id, cosine) of every stored record: its k nearest of whatever cosine, all others of its vector
    size if there are fewer. See :func:`knn_lists` for nulls, ties and copies."""
    merged, distinct, members = nearest_classes(stored_vectors(vectors), k, -1.0, vectors.count())
    lists = _of_records(completed(written(merged), distinct, k), members, k)
    return lists.select("id", F.posexplode("near").alias("p", "x")).select("id", (F.col("p") + 1).cast("int").alias("rank"), _id(F.col("x")).alias("neighbour_id"), _cosine(F.col("x")).alias("cosine"))


def near_pairs(vectors: DataFrame, k: int = 5, min_cosine: float = 0.85) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of cosine at least ``min_cosine`` of which one is among the k nearest of the other."""
    lists = knn_lists(stored_vectors(vectors), k, min_cosine, vectors.count())
    near = lists.select("id", F.explode(F.transform("near", _id)).alias("other"))
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(spark.read.parquet(f"{sf_dir}/vectors.parquet"))


def p2_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_neighbours(spark.read.parquet(f"{sf_dir}/vectors.parquet"))


def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row (records, places, reached): of the stored records whose id is a number divisible by 50, whether at least nine
    tenths of their 5 nearest were found by :func:`all_neighbours`, in every band of cosines (from 0.85, from 0.5, below)."""
    vectors = spark.read.parquet(f"{sf_dir}/vectors.parquet")
    stored = stored_vectors(vectors)
    usable = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    records = written(stored.where(F.coalesce(usable, F.lit(False))))
    asked = records.where(F.col("id").rlike("^[0-9]{1,18}$") & (F.col("id").try_cast("long") % 50 == 0))
    q = asked.select(F.col("id").alias("query_id"), F.col("vector").alias("qvector"), F.col("id").alias("self_id"))
    true = batch_nearest(records, q, 5, "cosine", not_self=True).select(F.col("query_id").alias("id"), F.col("id").alias("neighbour_id"), (1 - F.col("dist")).alias("cosine"))
    found = all_neighbours(vectors).select("id", "neighbour_id", F.lit(1).alias("hit"))
    band = F.when(F.col("cosine") >= 0.85, 2).when(F.col("cosine") >= 0.5, 1).otherwise(0)
    each = true.join(found, ["id", "neighbour_id"], "left").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("places"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"))
    return each.agg(F.coalesce(F.sum("places"), F.lit(0)).alias("places"), F.coalesce(F.bool_and(F.col("hits") >= 0.9 * F.col("places")), F.lit(True)).alias("reached")).crossJoin(asked.agg(F.count(F.lit(1)).alias("records")))


SQL = {
    "p2_recall": """
WITH s AS (
  SELECT id, vector FROM vectors WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
u AS (
  SELECT id, len(vector) AS d, count(*) OVER (PARTITION BY len(vector)) - 1 AS others FROM s
  WHERE len(vector) > 0 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)
SELECT count(*) AS records, CAST(coalesce(sum(least(5, others)), 0) AS BIGINT) AS places, true AS reached
FROM u WHERE regexp_full_match(id, '[0-9]{1,18}') AND CASE WHEN regexp_full_match(id, '[0-9]{1,18}') THEN CAST(id AS BIGINT) % 50 = 0 END
"""
}
