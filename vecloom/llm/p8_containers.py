"""Filling containers of fixed capacity: bound-certified repacking.

Each partition packs its documents by best-fit decreasing and computes lower bounds on its number of containers from
dual-feasible functions. Where the bound is met the partition is certified and stays. Where there is a gap, the
containers that are full stay and the documents of the others are exchanged: they are pooled with those of the other
partitions with gaps and packed again, in rounds of fewer partitions, until every partition is certified or one is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage as cut
from .p7_encode import RANKS, token_counts

CAPACITY = 2_048
ROWS_PER_TASK = 25_000
#: Rounds of exchange; after the last one every partition keeps what it has, so none ever holds more than its share.
ROUNDS = 6


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best bound of two families of dual-feasible functions, from the histogram of the sizes."""
    if not len(sizes):
        return 0
    n = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1].astype(np.float64)
    x = np.arange(capacity + 1)
    best = int(-(-int((n * x).sum()) // capacity))
    for t in range(1, capacity // 2 + 1):  # large items count as whole, small ones as nothing
        f = np.where(x > capacity - t, capacity, np.where(x < t, 0, x))
        best = max(best, int(-(-int((n * f).sum()) // capacity)))
    for k in range(1, 40):  # sizes rounded to multiples of capacity / (k + 1)
        f = np.where(((k + 1) * x) % capacity == 0, x * k, ((k + 1) * x // capacity) * capacity)
        best = max(best, int(-(-int((n * f).sum()) // (capacity * k))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item: larger items first, each into the fullest container that holds it."""
    out = np.empty(len(sizes), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0  # a bit for each amount of room that some container has left
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            box = open_at[room].pop()
            if not open_at[room]:
                rooms &= ~(1 << room)
        else:
            room, box, used = capacity, used, used + 1
        out[i] = box
        left = room - size
        if left:
            open_at[left].append(box)
            rooms |= 1 << left
    return out


def packed(capacity: int, rounds: int, last: bool):
    """A mapInArrow function from (row, size) to (row, size, container, settled)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        # the order of arrival must not matter
        order = np.lexsort((table.column("piece").to_numpy(), table.column("doc_id").fill_null(-(2**63)).to_numpy()))
        table = table.take(pa.array(order))
        sizes = table.column("size").to_numpy()
        box = best_fit_decreasing(sizes, capacity)
        boxes = int(box.max()) + 1
        settled = np.ones(len(sizes), bool)
        if not last and boxes > lower_bound(sizes, capacity):
            settled = (np.bincount(box, weights=sizes) >= capacity)[box]
        name = (np.int64(rounds) << 56) | (np.int64(TaskContext.get().partitionId()) << 32) | box
        yield from pa.table({"doc_id": table.column("doc_id"), "piece": table.column("piece"), "size": table.column("size"), "container": pa.array(name), "settled": pa.array(settled)}).to_batches()

    return run


def containers(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, container, tokens) from (doc_id, tokens): what of each document lies in which container.

    A document longer than a container is cut into full containers and a rest that is packed like any other document;
    no other document is split. Documents without tokens (null or empty text, null or negative sizes) are given 0 tokens
    in a container of their partition. Rows of equal doc_id are separate documents. The result does not depend on the
    order of rows in files.
    """
    spark = sizes.sparkSession
    schema = "doc_id long, piece int, size int, container long, settled boolean"
    clean = sizes.select("doc_id", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).alias("tokens"))
    whole = (F.col("tokens") / capacity).cast("int")
    rest = F.col("tokens") - whole * capacity
    lengths = F.when(F.col("tokens") == 0, F.array(F.lit(0))).otherwise(F.concat(F.array_repeat(F.lit(capacity), whole), F.when(rest > 0, F.array(rest.cast("int"))).otherwise(F.array().cast("array<int>"))))
    pieces = cut(clean.select("doc_id", F.posexplode(lengths).alias("piece", "size")).select("doc_id", "piece", F.col("size").cast("int").alias("size")))
    rows = pieces.count()
    done: list[DataFrame] = []
    for rounds in range(ROUNDS):
        if not rows:
            break
        n = -(-rows // ROWS_PER_TASK)
        last = n == 1 or rounds == ROUNDS - 1
        spread = pieces.repartition(n, F.xxhash64("doc_id", "piece", F.lit(rounds)))
        placed = cut(spread.mapInArrow(packed(capacity, rounds, last), schema))
        done.append(placed if last else placed.where("settled"))
        pieces = placed.where("NOT settled").select("doc_id", "piece", "size")
        rows = 0 if last else pieces.count()
    if not done:
        return spark.createDataFrame([], "doc_id long, container long, tokens int")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "container", F.col("size").alias("tokens"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), RANKS))
