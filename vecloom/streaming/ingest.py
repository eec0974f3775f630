"""Streaming ingestion into a database, and windows over a stream of events."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder


def ingest(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, interval: str = "10 seconds"):
    """Start writing each micro-batch with ``write(batch, batch_id)``; ``once`` stops after what is available.

    The checkpoint remembers what was read; a batch repeated after a failure has the same id, so ``write`` can be made
    idempotent with it (an upsert by id and seq is by itself).
    """
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a streaming aggregate says once all that is available is read. For results of bounded size, such as windows.

    The stream's checkpoint lies in the folder of ``spark.checkpoint.dir``, a temporary one only where that is unset.
    """
    spark = stream.sparkSession
    name = f"drained_{uuid.uuid4().hex}"
    base = shared_folder(spark, "stream states")
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{base}/{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def latest_per_id(stream: DataFrame, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """First delivery of each (id, seq) within the watermark: repeated deliveries are dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(["id", "seq"])


def tumbling(stream: DataFrame, every: str = "1 hour", late: str = "10 minutes", ts: str = "ts", value: str = "value") -> DataFrame:
    """(window_start, n, total): events and their sum in tumbling windows, closed by the watermark."""
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, every)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "n", "total")


def sliding(stream: DataFrame, length: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes", ts: str = "ts", value: str = "value") -> DataFrame:
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, length, step)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", key: str = "user_id", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """(key, session_start, session_end, n): activity of each key without a pause of ``gap``."""
    out = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
