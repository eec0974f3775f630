"""Mutations as DataFrame functions: numbering, upserts, deletes, metadata changes and spilling to partitions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows numbered by one task.
CHUNK = 200_000


def numbered(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """``df`` with contiguous positions from 0 by ``order`` (which must be unique), without sorting in one task.

    Rows are range-partitioned; each task numbers its own and adds the rows of the tasks before it.
    """
    parts = max(1, -(-df.count() // CHUNK))
    spread = cut_lineage(df.repartitionByRange(parts, *order).withColumn("task__", F.spark_partition_id()))
    sizes = spread.groupBy("task__").agg(F.count(F.lit(1)).alias("n__"))
    # as many rows as tasks
    before = sizes.withColumn("before__", F.coalesce(F.sum("n__").over(Window.orderBy("task__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("task__", "before__")
    own = F.row_number().over(Window.partitionBy("task__").orderBy(*order)) - 1
    return spread.withColumn("own__", own).join(F.broadcast(before), "task__").withColumn(name, (F.col("own__") + F.col("before__")).cast("long")).drop("own__", "before__", "task__")


def assign_ids(batch: DataFrame, counter: int = 1, order: str = "pos") -> DataFrame:
    """``batch`` (id, id_is_num, ...) in the order of the contiguous ``order``, null ids replaced by numbers.

    A running counter gives the numbers; an explicit number at or above it moves it past that number, text ids do not.
    In closed form a row's counter is a + max(counter, max over earlier numbers n of n + 1 - a_n), where a counts the null
    ids before a row; both parts are running aggregates, taken chunk by chunk.
    """
    auto = F.col("id").isNull().cast("long")
    chunk = (F.col(order) / CHUNK).cast("long")
    explicit = F.when(F.col("id_is_num"), F.col("id").try_cast("long"))
    rows = batch.withColumn("chunk__", chunk).withColumn("auto__", auto)
    within = Window.partitionBy("chunk__").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("chunk__").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    sums = rows.groupBy("chunk__").agg(F.sum("auto__").alias("n__")).withColumn("base__", F.coalesce(F.sum("n__").over(earlier), F.lit(0))).select("chunk__", "base__")
    rows = rows.join(F.broadcast(sums), "chunk__").withColumn("a__", F.coalesce(F.sum("auto__").over(within), F.lit(0)) + F.col("base__"))
    rows = rows.withColumn("lift__", explicit + 1 - F.col("a__"))
    tops = rows.groupBy("chunk__").agg(F.max("lift__").alias("m__")).withColumn("top__", F.max("m__").over(earlier)).select("chunk__", "top__")
    rows = rows.join(F.broadcast(tops), "chunk__").withColumn("number__", F.col("a__") + F.greatest(F.lit(counter).cast("long"), F.col("top__"), F.max("lift__").over(within)))
    null = F.col("id").isNull()
    out = rows.withColumn("id_is_num", F.when(null, F.lit(True)).otherwise(F.col("id_is_num"))).withColumn("id", F.when(null, F.col("number__").cast("string")).otherwise(F.col("id")))
    return out.select(*batch.columns)


def next_counter(records: DataFrame, counter: int = 1) -> int:
    """The counter after these records: past every numeric id."""
    top = records.where("id_is_num").agg(F.max(F.col("id").try_cast("long"))).first()[0]
    return max(counter, (top or 0) + 1)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records after writing ``new`` over ``old``: per id the row of greatest seq wins; metadata is kept where the winner
    has none."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in ("id", "id_is_num", "metadata")]
    won = both.groupBy("id", "id_is_num").agg(
        F.max_by(F.struct(*rest), "seq").alias("w"),
        F.max_by("metadata", F.when(F.col("metadata").isNotNull(), F.col("seq"))).alias("metadata"),
    )
    return won.select("id", "id_is_num", "w.*", "metadata").select(*both.columns)


def delete(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records whose (id, id_is_num) is not among ``ids``."""
    return records.join(ids.select("id", "id_is_num").distinct(), ["id", "id_is_num"], "left_anti")


def update_vectors(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Vectors replaced by ``changes`` (id, id_is_num, vector); metadata stays, unknown ids are ignored."""
    new = changes.select("id", "id_is_num", F.col("vector").alias("new__"), F.lit(True).alias("hit__"))
    out = records.join(new, ["id", "id_is_num"], "left").withColumn("vector", F.when(F.col("hit__"), F.col("new__")).otherwise(F.col("vector")))
    return out.select(*records.columns)


def merged_json(current: Any, patch: Any):
    """A JSON object column with the top-level fields of ``patch`` laid over ``current``; types are kept.

    Null or malformed sides count as empty objects; two of them give null.
    """
    a, b = (F.from_json(c, "map<string,variant>") for c in (current, patch))
    a, b = F.coalesce(a, F.create_map().cast("map<string,variant>")), F.coalesce(b, F.create_map().cast("map<string,variant>"))
    both = F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)
    return F.when(current.isNotNull() | patch.isNotNull(), F.to_json(both))


def merge_metadata(records: DataFrame, patches: DataFrame) -> DataFrame:
    """Shallow merge of ``patches`` (id, id_is_num, patch JSON) into the metadata of known ids."""
    out = records.join(patches.select("id", "id_is_num", "patch"), ["id", "id_is_num"], "left")
    return out.withColumn("metadata", F.when(F.col("patch").isNotNull(), merged_json(F.col("metadata"), F.col("patch"))).otherwise(F.col("metadata"))).select(*records.columns)


def replace_metadata(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Metadata replaced by ``changes`` (id, id_is_num, patch JSON or null) for known ids."""
    out = records.join(changes.select("id", "id_is_num", "patch", F.lit(True).alias("hit__")), ["id", "id_is_num"], "left")
    return out.withColumn("metadata", F.when(F.col("hit__"), F.col("patch")).otherwise(F.col("metadata"))).select(*records.columns)


def map_metadata(records: DataFrame, f: Callable[[dict | None], dict | None], where=None) -> DataFrame:
    """Metadata of the selected records passed through a Python function of the parsed object, in Arrow batches."""
    import json

    def changed(t: str | None) -> str | None:
        new = f(None if t is None else json.loads(t))
        return None if new is None else json.dumps(new)

    @F.pandas_udf("string")
    def apply(text: pd.Series, chosen: pd.Series) -> pd.Series:
        # a UDF is evaluated for every row, so the selection goes in as an argument
        return pd.Series([changed(t) if c else t for t, c in zip(text, chosen)], dtype=object)

    return records.withColumn("metadata", apply("metadata", F.lit(True) if where is None else F.coalesce(where, F.lit(False))))


def spilled(batch: DataFrame, active_count: int, capacity: int, pos: str = "pos") -> DataFrame:
    """``batch`` with partition_no: 0 while the active partition has room, then 1, 2, ... of ``capacity`` rows each."""
    return batch.withColumn("partition_no", F.floor((F.lit(active_count) + F.col(pos)) / F.lit(capacity)).cast("int"))
