"""Similarity clusters: reciprocal-nearest-neighbour average linkage on a sparse graph of links.

A link joins a record to one of its ``LINKS`` most similar records of at least the threshold. Each round every cluster
looks up its best linked cluster by the average cosine of all their pairs - for unit vectors the dot product of the two
means, so copies and pairs without a link count as well - and all mutual best pairs of at least the threshold merge in
parallel; then their links are united and their averages renewed. It stops when no linked pair reaches the threshold.

An average of at least the threshold needs a pair of at least the threshold, so clusters never cross the components of
those pairs. Components are found first: in each cell of :mod:`vecloom.llm.vectors` by linkage and a search for pairs of
at least the threshold between different clusters - tiles that hold one cluster are skipped, which is most of the work
in a dense group - and over the records that lie in several cells. Linkage then runs whole component by whole component:
in one task up to ``LARGE`` distinct vectors, in Spark rounds beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage as cut
from ..session import written
from .common import checked_broadcast, partitions, stored_vectors, with_copies
from .p2_knn import ROWS_PER_TASK, best_of_rows, class_rows, knn_lists, top_of_array
from .vectors import by_size, binary, cell_size, fit_directions, grouped, pack, to_cells, unpack

TILE = 512
#: How far below its best projection a record's window opens: components need one link of many to be met.
MARGIN = 0.045
#: Links of a record, and distinct vectors of a component that one task holds.
LINKS, LARGE = 12, 40_000
#: Rows whose links come from one matrix product.
SMALL = 512


def links(u: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), a < b: each unit row and its ``LINKS`` best rows of cosine at least ``least``, once."""
    if len(u) <= SMALL:
        score = u @ u.T
        np.fill_diagonal(score, -2)
        a, b, _ = best_of_rows(score, least - 1e-6, min(LINKS, len(u)))
    else:
        a, b = top_of_array(u, u, LINKS, least, True, radii=())
    code = np.unique(np.minimum(a, b) * len(u) + np.maximum(a, b))
    return code // max(len(u), 1), code % max(len(u), 1)


def average_linkage(w: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Cluster number (its least row) of each unit row of ``w``, which stands for ``n`` copies, by the links (a, b)."""
    total, count, label = w * n[:, None], n.astype(np.float64), np.arange(len(w))
    value, fresh = np.empty(len(a)), np.ones(len(a), bool)
    while len(a):
        for at in np.array_split(np.flatnonzero(fresh), max(1, fresh.sum() >> 15)):
            x, y = a[at], b[at]
            value[at] = np.round(np.einsum("ij,ij->i", total[x], total[y]) / (count[x] * count[y]), 6)
        near = np.flatnonzero(value >= least)
        if not len(near):
            break
        x, y, v = np.concatenate([a[near], b[near]]), np.concatenate([b[near], a[near]]), np.tile(value[near], 2)
        order = np.lexsort((y, -v, x))
        x, first = np.unique(x[order], return_index=True)
        best = np.full(len(w), -1)
        best[x] = y[order][first]
        # of equal averages the least numbers are taken, so the best pair of all is mutual and every round merges
        low = x[(best[best[x]] == x) & (x < best[x])]
        high = best[low]
        total[low] += total[high]
        count[low] += count[high]
        into = np.arange(len(w))
        into[high] = low
        label = into[label]
        changed = np.zeros(len(w), bool)
        changed[low] = True
        a, b = into[a], into[b]
        code = np.minimum(a, b) * len(w) + np.maximum(a, b)
        code, first = np.unique(code[a != b], return_index=True)
        value = value[a != b][first]
        a, b = code // len(w), code % len(w)
        fresh = changed[a] | changed[b]
    return label


def close(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the clusters a[i] and b[i]."""
    root = np.arange(len(label))
    while True:
        new = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root[label]
        root = new


def crossing(w: np.ndarray, label: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different clusters that hold rows of cosine (to six decimals) at least ``least``."""
    order = np.argsort(label, kind="stable")
    u, l, w = w[order].astype(np.float32), label[order], w[order]
    starts = np.arange(0, len(u), TILE)
    ends = np.minimum(starts + TILE, len(u))
    out = []
    for i, (s, e) in enumerate(zip(starts, ends)):
        for t, f in zip(starts[i:], ends[i:]):
            if l[s] == l[f - 1]:
                continue
            r, c = np.nonzero(u[s:e] @ u[t:f].T >= least - 1e-5)
            differ = l[s + r] != l[t + c]
            r, c = s + r[differ], t + c[differ]
            if len(r):
                strong = np.round(np.einsum("ij,ij->i", w[r], w[c]), 6) >= least
                code = np.unique(l[r[strong]] * len(l) + l[c[strong]])
                out.append(code)
    code = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    return code // max(len(l), 1), code % max(len(l), 1)


def clusters_in_cells(least: float, linkage: bool):
    """A mapInArrow function from the rows of cells to (rep, home, root): root is the least rep of the cell's part of the
    component. Components grow from the clusters of average linkage, or from the links where linkage is still to come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, cell in grouped(batches):
            names = np.array(cell.column("rep").to_pylist(), object)
            order = np.argsort(names, kind="stable")
            cell, names = cell.take(pa.array(order)), names[order]
            w = unpack(cell.column("packed"), cell_size(code)).astype(np.float64)
            w /= np.sqrt((w * w).sum(1))[:, None]
            a, b = links(w.astype(np.float32), least)
            label = average_linkage(w, np.ones(len(w)), a, b, least) if linkage else close(np.arange(len(w)), a, b)
            label = close(label, *crossing(w, label, least))
            # rows are in the order of their names and a cluster's label is its first row
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), cell.column("home").combine_chunks(), pa.array(names[label], pa.string())], names=["rep", "home", "root"])

    return run


def component_rows(vectors: DataFrame, least: float, linkage: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rep, label) of every distinct usable vector, label the least rep of its component of pairs of at least ``least``;
    (ids, id, vector) of the distinct vectors; (id, rep) of copies."""
    rows = vectors.count()
    records = stored_vectors(vectors)
    distinct, members = class_rows(records, 0)
    fit = fit_directions(records, rows, margin=MARGIN)
    cells = distinct.select(F.col("id").alias("rep"), "vector").mapInArrow(to_cells(fit, "rep"), "cell long, home boolean, own boolean, side boolean, rep string, packed binary")
    spread = cells.select("cell", "home", "rep", "packed").repartition(partitions(vectors.sparkSession, fit.copies * rows, ROWS_PER_TASK), "cell")
    local = written(spread.mapInArrow(clusters_in_cells(least, linkage), "rep string, home boolean, root string"))
    # roots meet in records that lie in several cells, or under another root's name
    roots = local.groupBy("rep").agg(F.min("root").alias("b"), F.collect_set("root").alias("all")).where(F.size("all") > 1)
    joined = connected_components(roots.select(F.explode("all").alias("a"), "b"), "a", "b").select(F.col("id").alias("root"), F.col("community").alias("label"))
    return local.where("home").join(joined, "root", "left").select("rep", F.coalesce("label", "root").alias("label")), distinct, members


def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, vector) to (rep, dim, packed) of the usable vectors."""
    for batch in batches:
        for d, rows, m in by_size(batch.column("vector")):
            order, parts = pack(m)
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(rows[order])), pa.array(np.full(len(rows), d, np.int32)), binary(parts)], names=["rep", "dim", "packed"])


def _typical(w: np.ndarray, n: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Cosine of each unit row to the mean of its cluster."""
    total = np.zeros_like(w)
    np.add.at(total, label, w * n[:, None])
    norm = np.sqrt((total * total).sum(1))
    return np.round(np.einsum("ij,ij->i", w, total[label]) / np.maximum(norm[label], 1e-300), 6)


def component_links(u: np.ndarray, component: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """:func:`links` of the rows of each component, which are consecutive; small ones share a matrix product."""
    start = np.flatnonzero(np.concatenate([[True], component[1:] != component[:-1]]))
    ends = np.append(start[1:], len(u))
    out_a, out_b, s = [], [], 0
    while s < len(start):
        e = max(s + 1, np.searchsorted(ends, start[s] + SMALL, "right"))
        x = slice(start[s], ends[e - 1])
        if e == s + 1:
            a, b = links(u[x], least)
        else:
            score = u[x] @ u[x].T
            score[component[x][:, None] != component[x][None]] = -2
            np.fill_diagonal(score, -2)
            a, b, _ = best_of_rows(score, least - 1e-6, min(LINKS, len(score)))
            code = np.unique(np.minimum(a, b) * len(score) + np.maximum(a, b))
            a, b = code // len(score), code % len(score)
        out_a.append(start[s] + a)
        out_b.append(start[s] + b)
        s = e
    return np.concatenate(out_a), np.concatenate(out_b)


def linked_components(least: float):
    """A mapInArrow function from (component, rep, n, dim, packed) to (rep, first, typical): average linkage of the
    components; first is the least rep of the cluster, typical the cosine to the mean of the cluster. All components of
    one vector size in the task take their rounds together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, rows in grouped(batches, "dim"):
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("component", "ascending"), ("rep", "ascending")]))
            n = rows.column("n").to_numpy().astype(np.float64)
            w = unpack(rows.column("packed"), dim).astype(np.float64)
            w /= np.sqrt((w * w).sum(1))[:, None]
            label = average_linkage(w, n, *component_links(w.astype(np.float32), rows.column("component").to_numpy(), least), least)
            # rows are in the order of their names and a cluster's label is its first row
            names = rows.column("rep").combine_chunks()
            yield pa.RecordBatch.from_arrays([names, names.take(pa.array(label)), pa.array(_typical(w, n, label))], names=["rep", "first", "typical"])

    return run


def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, n, dim, packed) to (rep, n, total): the unit vector, n times."""
    for batch in batches:
        dim = batch.column("dim").to_numpy()
        for d in np.unique(dim):
            at = np.flatnonzero(dim == d)
            part = batch.take(pa.array(at))
            w = unpack(part.column("packed"), int(d)).astype(np.float64)
            w *= (part.column("n").to_numpy() / np.sqrt((w * w).sum(1)))[:, None]
            total = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * d, pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("n"), total], names=["rep", "n", "total"])


def averages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, total_a, n_b, total_b) to (a, b, value): the average cosine of two clusters."""
    for batch in batches:
        flat = [batch.column(c).flatten().to_numpy() for c in ("total_a", "total_b")]
        size = batch.column("total_a").value_lengths().to_numpy()
        dot = np.add.reduceat(flat[0] * flat[1], np.cumsum(size) - size) if len(size) else np.zeros(0)
        value = np.round(dot / (batch.column("n_a").to_numpy().astype(np.float64) * batch.column("n_b").to_numpy()), 6)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(value)], names=["a", "b", "value"])


def linkage_rounds(rows: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(rep, first) by the same linkage as :func:`average_linkage`, a round of joins at a time.

    ``rows`` are (rep, n, total), ``pairs`` links (a, b) of reps. Clusters are named by their least rep; each round is
    checkpointed and only clusters whose best partner reaches the threshold go on.
    """
    clusters = cut(rows.select(F.col("rep").alias("c"), "n", "total"))
    e = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    member = cut(rows.select("rep", F.col("rep").alias("first")))
    while True:
        side = lambda x: clusters.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("total").alias(f"total_{x}"))
        value = cut(e.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "total_a", "n_b", "total_b").mapInArrow(averages, "a string, b string, value double"))
        near = value.where(F.col("value") >= least)
        both = near.select("a", "b", "value").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
        best = both.groupBy("a").agg(F.min(F.struct((-F.col("value")).alias("v"), "b"))["b"].alias("b"))
        merges = cut(best.join(best.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).where("a < b").select(F.col("b").alias("gone"), F.col("a").alias("into")))
        if merges.isEmpty():
            return member
        gone = merges.withColumnRenamed("gone", "c")
        moved = clusters.join(gone, "c").select(F.col("into").alias("c"), F.col("n").alias("n2"), F.col("total").alias("total2"))
        left = clusters.join(gone, "c", "left_anti").join(moved, "c", "left")
        clusters = cut(left.select("c", (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.when(F.col("n2").isNull(), F.col("total")).otherwise(F.zip_with("total", "total2", lambda x, y: x + y)).alias("total")))
        for x in ("a", "b"):
            e = e.join(merges.withColumnRenamed("gone", x), x, "left").withColumn(x, F.coalesce("into", x)).drop("into")
        e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
        member = cut(member.join(merges.withColumnRenamed("gone", "first"), "first", "left").select("rep", F.coalesce("into", "first").alias("first")))


def _cosine_to_mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, first, n, total, mean) to (rep, first, typical)."""
    for batch in batches:
        size = batch.column("total").value_lengths().to_numpy()
        if not len(size):
            continue
        x, m = (batch.column(c).flatten().to_numpy() for c in ("total", "mean"))
        start = np.cumsum(size) - size
        dot, xx, mm = (np.add.reduceat(p, start) for p in (x * m, x * x, m * m))
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("first"), pa.array(np.round(dot / np.maximum(np.sqrt(xx * mm), 1e-300), 6))], names=["rep", "first", "typical"])


def large_components(wide: DataFrame, least: float) -> DataFrame:
    """(rep, first, typical) of components beyond one task: links by the neighbour search, linkage in Spark rounds."""
    rows = cut(wide.select("rep", "n", "dim", "packed").mapInArrow(unit_rows, "rep string, n long, total array<double>"))
    records = rows.select(F.col("rep").alias("id"), F.transform("total", lambda x: (x / F.col("n")).cast("float")).alias("vector"))
    lists = knn_lists(records, LINKS, least, rows.count())
    near = lists.select(F.col("id").alias("a"), F.explode(F.transform("near", lambda x: F.substring(x, 8, 2_147_483_647))).alias("b"))
    member = linkage_rounds(rows, near, least)
    placed = cut(member.join(rows, "rep"))
    # sums of a cluster are made component by component of the vector, with partial sums before the exchange
    each = placed.select("first", F.posexplode("total").alias("i", "x")).groupBy("first", "i").agg(F.sum("x").alias("x"))
    mean = each.groupBy("first").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    return placed.join(mean, "first").select("rep", "first", "total", "mean").mapInArrow(_cosine_to_mean, "rep string, first string, typical double")


def linked_rows(vectors: DataFrame, least: float, smallest: int = 1, large: int = LARGE) -> tuple[DataFrame, DataFrame | None]:
    """(rep, first, typical) of every distinct vector of a component of at least ``smallest`` records, first the least rep
    of its cluster; (id, rep) of copies."""
    home, distinct, members = component_rows(vectors, least, linkage=False)
    if members is None:
        home = home.withColumn("n", F.lit(1).cast("long"))
    else:
        copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
        home = home.join(copies, "rep", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    home = cut(home)
    size = home.groupBy("label").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("reps")).where(F.col("size") >= smallest)
    rows = cut(home.join(size, "label").select("rep", "n", "reps", F.xxhash64("label").alias("component")))
    count, most = rows.agg(F.count(F.lit(1)), F.max("reps")).first()
    packed = distinct.select(F.col("id").alias("rep"), "vector").mapInArrow(packed_rows, "rep string, dim int, packed binary")
    spark = vectors.sparkSession
    here = rows if (most or 0) <= large else rows.where(F.col("reps") <= large)
    wide = packed.join(checked_broadcast(here, count), "rep").select("component", "rep", "n", "dim", "packed")
    out = wide.repartition(partitions(spark, count, ROWS_PER_TASK), "component").mapInArrow(linked_components(least), "rep string, first string, typical double")
    if (most or 0) > large:
        out = out.unionByName(large_components(packed.join(rows.where(F.col("reps") > large), "rep"), least))
    return out, members


def cluster_members(vectors: DataFrame, least: float) -> DataFrame:
    """(id, first_id) of every stored record; first_id is the least id of its component, itself if alone."""
    rows, _, members = component_rows(vectors, least)
    return with_copies(rows, members, "rep", "id").select("id", F.col("label").alias("first_id"))


def clusters(vectors: DataFrame, least: float = 0.88, smallest: int = 5, typical: int = 3, large: int = LARGE) -> DataFrame:
    """(first_id, size, typical_ids): clusters of average linkage of at least ``smallest`` records with their most typical
    members.

    Null, empty, all-zero and non-finite vectors are in no cluster; vectors of different sizes never meet; copies count
    as members. Ties in typicality are settled by id. An empty table gives no rows.
    """
    rows, members = linked_rows(vectors, least, smallest, large)
    rows = cut(with_copies(rows, members, "rep", "id").withColumnRenamed("first", "first_id"))
    order = Window.partitionBy("first_id").orderBy(F.col("typical").desc(), "id")
    best = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= typical)
    best = best.groupBy("first_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]).alias("typical_ids"))
    size = rows.groupBy("first_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= smallest)
    return size.join(best, "first_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(cluster_members(spark.read.parquet(f"{sf_dir}/vectors.parquet"), 0.88))
    large = rows.groupBy("first_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select("first_id")
    return rows.where("id <> first_id").join(large, "first_id").select("first_id", "id")


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/vectors.parquet"))
