"""Import and export: packed float32 files with a JSON description, JSON lines, CSV and Parquet."""

from __future__ import annotations

import gzip
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RECORDS, encode_id

#: The description's format number; a fixed value.
FORMAT_VERSION = 1


def to_bytes(vector) -> bytes:
    return np.asarray(vector, "<f4").tobytes()


def from_bytes(data: bytes, dim: int | None = None) -> list[float]:
    """Little-endian float32 components; a length that does not fit ``dim`` is an error."""
    if len(data) % 4 or dim is not None and len(data) != 4 * dim:
        raise ValueError(f"{len(data)} bytes are not {dim if dim is not None else 'whole'} float32 components")
    return np.frombuffer(data, "<f4").tolist()


def decoded(column: Column) -> Column:
    """An array<float> column from packed bytes; null where the length is no multiple of 4."""

    @F.pandas_udf("array<float>")
    def decode(data: pd.Series) -> pd.Series:
        return data.map(lambda b: np.frombuffer(b, "<f4") if b is not None and len(b) % 4 == 0 else None)

    return decode(column)


def encoded(column: Column) -> Column:
    @F.pandas_udf("binary")
    def encode(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else to_bytes(x))

    return encode(column)


def read_packed(spark: SparkSession, path: str, partition_id: str = "default") -> DataFrame:
    """Records of ``path``/meta.json and vec.bin (or both with .gz): ids with byte offsets, lengths and sizes, metadata by id.

    Missing files are an empty collection; entries that reach past the end of the data, or whose length does not fit
    their size, are skipped; another format number is an error. One such pair is one capacity-bounded partition, read by
    one task; the vectors are sliced there, not on the driver.
    """
    both = spark.read.format("binaryFile").load([f"{path}/*"]) if _exists(spark, path) else None
    empty = spark.createDataFrame([], RECORDS)
    if both is None:
        return empty
    named = both.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").where(F.col("name").isin("meta.json", "meta.json.gz", "vec.bin", "vec.bin.gz"))

    def parse(files: pd.DataFrame) -> pd.DataFrame:
        held = {n.removesuffix(".gz"): gzip.decompress(c) if n.endswith(".gz") else bytes(c) for n, c in zip(files["name"], files["content"])}
        rows = []
        if "meta.json" in held and "vec.bin" in held:
            meta = json.loads(held["meta.json"])
            if meta.get("version") != FORMAT_VERSION:
                raise ValueError(f"unsupported format version {meta.get('version')!r}")
            for seq, v in enumerate(meta["vectors"]):
                end = v["offset"] + v["length"]
                if end > len(held["vec.bin"]) or v["length"] != 4 * v["dim"]:
                    continue
                text, number = encode_id(v["id"])
                found = meta["metadata"].get(text)
                rows.append((partition_id, text, number, seq, np.frombuffer(held["vec.bin"][v["offset"] : end], "<f4"), json.dumps(found) if found else None))
        return pd.DataFrame(rows, columns=["partition_id", "id", "id_is_num", "seq", "vector", "metadata"])

    return named.groupBy(F.lit(1).alias("one")).applyInPandas(parse, RECORDS)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_packed(records: DataFrame, path: str) -> None:
    """Packed float32 vectors as Parquet rows (id, id_is_num, seq, data BINARY, dim, metadata): the scalable form."""
    records.select("partition_id", "id", "id_is_num", "seq", encoded(F.col("vector")).alias("data"), F.size("vector").alias("dim"), "metadata").write.mode("overwrite").parquet(path)


def read_packed_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("partition_id", "id", "id_is_num", "seq", decoded(F.col("data")).alias("vector"), "metadata")


def export(records: DataFrame, path: str, kind: str = "parquet", compression: str | None = None) -> None:
    """Parquet, JSON lines (vectors as arrays) or CSV (vectors and metadata as JSON text)."""
    if kind not in ("parquet", "json", "csv"):
        raise ValueError(f"unknown kind {kind!r}")
    out = records if kind != "csv" else records.withColumn("vector", F.to_json("vector"))
    writer = out.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        writer.parquet(path)


def import_records(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """What :func:`export` wrote, with its schema given, so nothing is inferred."""
    if kind == "parquet":
        return spark.read.schema(RECORDS).parquet(path)
    if kind == "json":
        return spark.read.schema(RECORDS).json(path)
    if kind != "csv":
        raise ValueError(f"unknown kind {kind!r}")
    text = spark.read.schema(RECORDS.replace("vector array<float>", "vector string")).option("header", True).option("escape", '"').csv(path)
    return text.withColumn("vector", F.from_json("vector", "array<float>"))
