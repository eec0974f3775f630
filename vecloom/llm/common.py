"""Shared pieces of the training-data operators: size-checked joins and the stored-record view."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage as cut
from ..session import written

#: Keys a broadcast side may hold; a larger side takes a shuffle join instead.
BROADCAST_KEYS = 400_000
#: Members of a class of copies that one task puts back.
HOT_MEMBERS = 100_000
#: Items of one key that meet in one task when its pairs are listed.
PAIR_BLOCK = 1_000


def partitions(spark: SparkSession, rows: float, per_task: int) -> int:
    """Tasks that keep at most about ``per_task`` rows each, never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_task))


def checked_broadcast(small: DataFrame, rows: int, bound: int | None = None) -> DataFrame:
    """``small`` with a broadcast hint if its counted ``rows`` are within ``bound`` (``BROADCAST_KEYS`` by default);
    beyond it the planner shuffles. Rows are keys of some ten bytes; what is longer is counted by its parts."""
    return F.broadcast(small) if rows <= (BROADCAST_KEYS if bound is None else bound) else small


def repeated_keys(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Distinct values of ``key`` that occur in more than one row, materialised, with their number."""
    keys = cut(df.groupBy(key).agg(F.count(F.lit(1)).alias("n__")).where("n__ > 1").select(key))
    return keys, keys.count()


def split_repeated(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose key is unique, rows whose key repeats or None). Only the second part needs a shuffle afterwards."""
    keys, n = repeated_keys(df.select(key), key)
    if n == 0:
        return df, None
    side = checked_broadcast(keys, n)
    return df.join(side, key, "left_anti"), df.join(side, key, "left_semi")


def latest(df: DataFrame, value: str) -> DataFrame:
    """(id, value) of the row of greatest ``seq`` of each id; rows with a null id are none, a null seq is the least.

    Most ids are written once, so only the ids written again are shuffled with their values.
    """
    rows = df.where(F.col("id").isNotNull()).select("id", F.coalesce("seq", F.lit(-(2**63))).alias("seq"), value)
    once, again = split_repeated(rows, "id")
    once = once.select("id", value)
    if again is None:
        return once
    order = F.struct("seq", F.xxhash64(value).alias("h"))
    # kept, as every later scan of the records would shuffle them anew
    return once.unionByName(written(again.groupBy("id").agg(F.max_by(value, order).alias(value))))


def stored_vectors(vectors: DataFrame) -> DataFrame:
    """(id, vector) of the stored records, before the checks on components (see :func:`vectors.usable`)."""
    v = F.col("vector").cast("array<float>")
    return latest(vectors.select("id", "seq", v.alias("vector")), "vector").where(F.size("vector") > 0)


def stored_metadata(vectors: DataFrame) -> DataFrame:
    """(id, metadata): of the row of greatest ``seq`` among the rows of the id where metadata is not null."""
    return latest(vectors.where(F.col("metadata").isNotNull()).select("id", "seq", "metadata"), "metadata")


def with_copies(rows: DataFrame, members: DataFrame | None, rep: str, name: str) -> DataFrame:
    """``rows`` of representatives, one for each record: ``rep`` becomes ``name``, repeated for the ids of ``members``
    (id, rep; a representative is among its own).

    The members of a large class are salted over many tasks. There is one such class for ``HOT_MEMBERS`` members at
    most, so the table of their salts is small whatever the data.
    """
    if members is None:
        return rows.withColumnRenamed(rep, name)
    others = [c for c in rows.columns if c != rep]
    salts = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / HOT_MEMBERS).cast("int").alias("salts__")).where("salts__ > 1").withColumnRenamed("rep", rep)
    of = members.select(F.col("id").alias("member__"), F.col("rep").alias(rep)).join(F.broadcast(salts), rep, "left")
    of = of.withColumn("salt__", F.pmod(F.xxhash64("member__"), F.coalesce("salts__", F.lit(1))).cast("int")).drop("salts__")
    wide = rows.join(F.broadcast(salts), rep, "left").withColumn("salt__", F.explode(F.sequence(F.lit(0), F.coalesce("salts__", F.lit(1)) - 1)))
    joined = wide.join(of, [rep, "salt__"], "left").where("member__ IS NOT NULL OR salts__ IS NULL")
    return joined.select(F.coalesce("member__", rep).alias(name), *others)


def spread_pairs(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b), a < b: pairs of distinct items under one key. A key with many items is met block by block in many tasks."""
    size = rows.groupBy(key).agg(F.count(F.lit(1)).alias("size__")).where("size__ > 1")
    sized = rows.join(size, key).withColumn("blocks__", F.ceil(F.col("size__") / PAIR_BLOCK).cast("int"))
    left = sized.select(key, F.col(item).alias("a"), F.pmod(F.xxhash64(item), F.col("blocks__")).cast("int").alias("block__"))
    right = sized.select(key, F.col(item).alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks__") - 1)).alias("block__"))
    return left.join(right, [key, "block__"]).where("a < b").select("a", "b").distinct()
