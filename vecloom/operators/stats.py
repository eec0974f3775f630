"""Statistics of records and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dim_histogram(records: DataFrame, vector: str = "vector") -> DataFrame:
    """(dim, n): records of each vector size; null vectors are left out."""
    return records.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("dim")).agg(F.count(F.lit(1)).alias("n"))


def most_common_dim(records: DataFrame, vector: str = "vector") -> DataFrame:
    """(dim): the most frequent size, the smallest of several; null for no records."""
    return dim_histogram(records, vector).agg(F.max_by("dim", F.struct("n", (-F.col("dim")).alias("d"))).alias("dim"))


def memory_bytes(vector: str = "vector", metadata: str = "metadata"):
    """An estimate for one record: 4 bytes a component, 2 a metadata character."""
    return F.coalesce(F.size(vector), F.lit(0)).cast("long") * 4 + F.coalesce(F.char_length(metadata), F.lit(0)).cast("long") * 2


def collection_stats(records: DataFrame) -> DataFrame:
    """One row (vector_count, metadata_count, dims, memory_bytes)."""
    return records.agg(
        F.count("vector").alias("vector_count"), F.count("metadata").alias("metadata_count"), F.countDistinct(F.when(F.col("vector").isNotNull(), F.size("vector"))).alias("dims"), F.coalesce(F.sum(memory_bytes()), F.lit(0)).alias("memory_bytes")
    )


def partition_stats(records: DataFrame, partitions: DataFrame) -> DataFrame:
    """(partition_id, partition_name, active, vector_count, dims, fill) with counts taken now, 0 for empty partitions."""
    now = records.groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.size("vector")).alias("d"))
    out = partitions.select("partition_id", "partition_name", "active", "capacity").join(now, "partition_id", "left")
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return out.select("partition_id", "partition_name", "active", n.alias("vector_count"), F.coalesce("d", F.lit(0)).cast("bigint").alias("dims"), (n / F.col("capacity")).alias("fill"))
