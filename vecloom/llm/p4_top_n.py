"""Top N items of every group by simultaneous bisection.

An item's rank is its order-preserving code: the distance's bits mapped so that unsigned order is numeric order,
followed by the arrival number. All groups of a task are bisected together: each round counts, for every group, the
codes at or below the group's midpoint and halves its interval, until the cutoff keeps exactly N codes. The bisection
runs twice: on each task's rows before the exchange, so that a group of any size leaves at most N rows a task, and on
what arrives. Hot groups are thus spread over all tasks and no task meets more than N rows a group and sender.

Groups that want more than ``LARGE_K`` items are bisected globally instead: each round counts the rows of every group by
the next ``DIGIT`` bits of their codes (so many midpoints at once) and narrows its interval, all groups together; no
rows of such a group are brought together at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage as cut
from .common import checked_broadcast, partitions

DEFAULT_K = 10
#: Groups that want more items are bisected over all tasks; bits of the code settled in one of their rounds.
LARGE_K, DIGIT = 100_000, 16
#: Rows of a task after the exchange.
ROWS_PER_TASK = 500_000


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """uint64 codes whose unsigned order is the order of the doubles; -0.0 and 0.0 share one."""
    b = (np.asarray(x, np.float64) + 0.0).view(np.int64)
    return np.where(b < 0, ~b, b | np.int64(-(2**63))).view(np.uint64)


def cutoffs(group: np.ndarray, code: np.ndarray, want: np.ndarray) -> np.ndarray:
    """For each group the least code with at least ``want[group]`` codes at or below it (the greatest code if fewer)."""
    low = np.full(len(want), np.iinfo(np.uint64).max)
    high = np.zeros(len(want), np.uint64)
    want = np.maximum(want, 1)
    np.minimum.at(low, group, code)
    np.maximum.at(high, group, code)
    size = np.bincount(group, minlength=len(want))
    low = np.where(size <= want, high, low)
    live = np.arange(len(group))
    while True:
        openg = low < high
        live = live[openg[group[live]]]
        if not len(live):
            return high
        middle = low + ((high - low) >> np.uint64(1))
        g = group[live]
        below = np.bincount(g[code[live] <= middle[g]], minlength=len(want))
        enough = below >= want
        # codes above a lowered upper bound or below a raised lower one are settled and leave the count
        settled_low = openg & ~enough
        want = np.where(settled_low, want - below, want)
        high = np.where(openg & enough, middle, high)
        low = np.where(settled_low, middle + np.uint64(1), low)
        keep = (code[live] <= high[g]) & (code[live] >= low[g])
        live = live[keep]


def keep_first(group: np.ndarray, codes: list[np.ndarray], want: np.ndarray) -> np.ndarray:
    """Rows of the ``want[group]`` least code tuples of each group; tuples are unique within a group."""
    chosen = np.zeros(len(group), bool)
    left = want.astype(np.int64).copy()
    rows = np.flatnonzero(left[group] > 0)
    for i, code in enumerate(codes):
        if not len(rows):
            break
        c, g = code[rows], group[rows]
        at = cutoffs(g, c, left)
        under = c < at[g] if i + 1 < len(codes) else c <= at[g]
        chosen[rows[under]] = True
        left = left - np.bincount(g[under], minlength=len(want))
        rows = rows[(c == at[g]) & ~under]
    return np.flatnonzero(chosen)


def bisected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (query_id, k, dist, seq, id) of a task that are among the k first of their query in it."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    _, group = np.unique(table.column("query_id").to_numpy(), return_inverse=True)
    want = np.zeros(group.max() + 1, np.int64)
    want[group] = table.column("k").to_numpy()
    seq = table.column("seq").to_numpy().astype(np.int64) ^ np.int64(-(2**63))
    rows = keep_first(group, [ordered_bits(table.column("dist").to_numpy()), seq.view(np.uint64)], want)
    yield from table.take(pa.array(np.sort(rows))).to_batches()


def candidates(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, k, dist, seq, id): the best delivered row of each id of each query, in the partitions it asks for.

    Rows with a null id, query or seq and null or NaN distances are none; k null means 10, a negative k counts as 0. A
    query's null or empty ``partition_ids`` stands for all; a null partition is never one that was asked for.
    """
    asked = F.col("partition_ids").isNull() | (F.size("partition_ids") == 0)
    q = queries.select("query_id", F.greatest(F.coalesce("k", F.lit(DEFAULT_K)), F.lit(0)).cast("int").alias("k"), F.when(~asked, F.col("partition_ids")).alias("partition_ids"))
    r = results.where("id IS NOT NULL AND seq IS NOT NULL AND dist IS NOT NULL AND NOT isnan(dist)").select("query_id", "partition_id", "id", "dist", "seq")
    inside = F.col("partition_ids").isNull() | F.coalesce(F.array_contains("partition_ids", F.col("partition_id")), F.lit(False))
    # partition ids count as keys, too
    keys = q.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.when(F.col("partition_ids").isNotNull(), F.size("partition_ids"))), F.lit(0))).first()[0]
    hits = r.join(checked_broadcast(q, keys), "query_id").where(inside)
    return hits.groupBy("query_id", "id").agg(F.min(F.struct((F.col("dist") + 0.0).alias("dist"), "seq")).alias("m"), F.first("k").alias("k")).select("query_id", "k", "m.dist", "m.seq", "id")


_SCHEMA = "query_id long, k int, dist double, seq long, id string"


def with_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with ``code``, 16 bytes whose order is that of (dist, seq)."""
    for batch in batches:
        seq = batch.column("seq").to_numpy().astype(np.int64) ^ np.int64(-(2**63))
        code = np.stack([ordered_bits(batch.column("dist").to_numpy()), seq.view(np.uint64)], axis=1).astype(">u8")
        offsets = np.arange(len(code) + 1, dtype=np.int32) * 16
        column = pa.Array.from_buffers(pa.binary(), len(code), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(code).tobytes())])
        yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "code"])


def global_top(rows: DataFrame) -> DataFrame:
    """The ``k`` first rows of each query, whatever their number, by counts alone. (query_id, seq) is unique."""
    coded = cut(rows.mapInArrow(with_codes, _SCHEMA + ", code binary"))
    # of each group: the cutoff's bytes so far and how many rows with this prefix are wanted
    state = cut(coded.groupBy("query_id").agg(F.first("k").cast("long").alias("want"), F.count(F.lit(1)).alias("n")).where("n > want").select("query_id", F.lit(b"").alias("prefix"), "want"))
    n = state.count()
    whole = coded.join(checked_broadcast(state.select("query_id"), n), "query_id", "left_anti")
    width = DIGIT // 8
    for at in range(0, 16, width):
        level = coded.join(checked_broadcast(state, n), "query_id").where(F.substring("code", 1, at) == F.col("prefix"))
        counts = level.groupBy("query_id", "prefix", "want", F.substring("code", at + 1, width).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        up_to = F.sum("n").over(Window.partitionBy("query_id").orderBy("digit"))
        found = counts.withColumn("up_to", up_to).where((F.col("up_to") >= F.col("want")) & (F.col("up_to") - F.col("n") < F.col("want")))
        state = cut(found.select("query_id", F.concat("prefix", "digit").alias("prefix"), (F.col("want") - F.col("up_to") + F.col("n")).alias("want")))
    cutoffs_ = state.select("query_id", F.col("prefix").alias("last"))
    kept = coded.join(checked_broadcast(cutoffs_, n), "query_id").where(F.col("code") <= F.col("last"))
    columns = [c.split()[0] for c in _SCHEMA.split(", ")]
    return whole.select(*columns).unionByName(kept.select(*columns))


def top_n(queries: DataFrame, results: DataFrame, large: int = LARGE_K) -> DataFrame:
    """(query_id, k, dist, seq, id): the k first candidates of every query by (dist, seq); all if there are fewer.

    Ties in distance go to the earlier arrival. A query without candidates, or with k = 0, has no rows.
    """
    rows = candidates(queries, results).where("k > 0").select("query_id", "k", "dist", "seq", "id")
    most = queries.agg(F.max("k")).first()[0] or DEFAULT_K
    few = rows if most <= large else rows.where(F.col("k") <= large)
    local = few.mapInArrow(bisected, _SCHEMA)
    out = local.repartition(partitions(queries.sparkSession, results.count(), ROWS_PER_TASK), "query_id").mapInArrow(bisected, _SCHEMA)
    return out if most <= large else out.unionByName(global_top(rows.where(F.col("k") > large)))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/queries.parquet"), spark.read.parquet(f"{sf_dir}/search_results.parquet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(*_tables(spark, sf_dir)).select("query_id", "id")


def p4_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(*_tables(spark, sf_dir)).select("query_id", "id", "dist", "seq")


_CANDIDATES = """
SELECT r.query_id, coalesce(q.k, 10) AS k, r.id, r.dist, r.seq FROM search_results r JOIN queries q USING (query_id)
WHERE r.id IS NOT NULL AND r.dist IS NOT NULL AND NOT isnan(r.dist)
  AND (q.partition_ids IS NULL OR len(q.partition_ids) = 0 OR list_contains(q.partition_ids, r.partition_id))
QUALIFY row_number() OVER (PARTITION BY r.query_id, r.id ORDER BY r.dist, r.seq) = 1
"""
_TOP = f"""
WITH c AS ({_CANDIDATES})
SELECT query_id, id, dist, seq FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, seq) <= k
"""
SQL = {"p4_found": f"SELECT query_id, id FROM ({_TOP})", "p4_topn": _TOP}
