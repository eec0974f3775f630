"""Schemas of the engine's tables, id encoding and argument checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORDS = "partition_id string, id string, id_is_num boolean, seq bigint, vector array<float>, metadata string"
PARTITIONS = "partition_id string, partition_name string, active boolean, capacity int, description string"
CENTROIDS = "partition_id string, cluster_id int, dim int, size bigint, centroid array<float>, radius double"
RESULTS = "query_id bigint, rank int, partition_id string, id string, dist double"

METRIC_NAMES = ("euclidean", "cosine", "manhattan", "dot", "inner", "chebyshev", "squared_euclidean", "hamming")
_PARTITION_ID = re.compile(r"[a-zA-Z0-9._-]+")


def encode_id(value: int | str) -> tuple[str, bool]:
    """An id as (text, is a number): 1 and "1" are different ids."""
    if isinstance(value, bool) or not isinstance(value, (int, str)):
        raise TypeError("an id is an int or a str")
    return str(value), isinstance(value, int)


def id_matches(value: int | str, id_col: str = "id", num_col: str = "id_is_num") -> Column:
    text, number = encode_id(value)
    return (F.col(id_col) == text) & (F.col(num_col) == number)


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with ``id`` as one unique text: the id after "n" for a number, "s" for a text."""
    return df.withColumn("id", F.concat(F.when(F.coalesce("id_is_num", F.lit(False)), "n").otherwise("s"), "id"))


def plain(key: str) -> list[Column]:
    """The id of a key of :func:`keyed` under the same name, and ``<name>_is_num``."""
    return [F.substring(key, 2, 2_147_483_647).alias(key), (F.substring(key, 1, 1) == "n").alias(f"{key}_is_num")]


def prefer_text_id(df: DataFrame, value: int | str) -> DataFrame:
    """Rows of an id given as text from outside: the text id if there is one, else the number it spells."""
    text = str(value)
    rows = df.where(F.col("id") == text)
    if not text.lstrip("-").isdigit():
        return rows.where("NOT id_is_num")
    return rows.orderBy(F.col("id_is_num").asc()).limit(1)


def partition_name_ok(partition_id: str) -> bool:
    return bool(_PARTITION_ID.fullmatch(partition_id))


def check_vector(values, size: int | None = None, strict: bool = False) -> list[float]:
    """The vector as floats. Strict refuses an empty vector, non-numbers and another size than ``size``."""
    out = [float(x) for x in values]
    if strict and (not out or any(x != x for x in out)):
        raise ValueError("a vector is a non-empty sequence of numbers")
    if strict and size is not None and len(out) != size:
        raise ValueError(f"vector has {len(out)} components, not {size}")
    return out


def check_k(k: int, strict: bool = False) -> int:
    if not isinstance(k, int) or k < 0 or strict and not 1 <= k <= 1000:
        raise ValueError("k must be an integer" + (" between 1 and 1000" if strict else " of at least 0"))
    return k


def check_threshold(t: float) -> float:
    if not isinstance(t, (int, float)) or not t > 0:
        raise ValueError("threshold must be a positive number")
    return float(t)
