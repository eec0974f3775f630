"""Monitoring of a query log: (ts, method, duration_ms, cache_hit) and statistics over windows of it."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG = "ts timestamp, method string, duration_ms double, k int, results int, cache_hit boolean, error string"


def moving_average(value: str, order: list[str], n: int = 10, by: list[str] | None = None) -> Column:
    """Mean of the last n values, the current one included. Without ``by`` all rows are one window, in one task: meant for
    a bounded log, such as a database keeps."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(-(n - 1), 0)
    return F.avg(value).over(w)


def percentile(value: str, p: float, accuracy: int | None = None) -> Column:
    """Nearest-rank percentile, p in 0..1: the value at place ceil(p * n). The exact one keeps a group's distinct values in
    one task; with ``accuracy`` a bounded sketch is kept instead, off by at most 1 / accuracy of the ranks."""
    if accuracy is not None:
        return F.percentile_approx(value, p, accuracy)
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)")


def latest_window(log: DataFrame, n: int = 1000) -> DataFrame:
    """The last n entries."""
    return log.orderBy(F.col("ts").desc()).limit(n)


def summary(log: DataFrame, interval_s: int = 60) -> DataFrame:
    """(searches, avg_ms, p95_ms, queries_per_minute, hit_rate): of the log; the rate is null without cache entries."""
    hits, seen = F.sum(F.col("cache_hit").cast("int")), F.count("cache_hit")
    return log.agg(F.count(F.lit(1)).alias("searches"), F.avg("duration_ms").alias("avg_ms"), percentile("duration_ms", 0.95).alias("p95_ms"), F.round(F.count(F.lit(1)) * 60.0 / interval_s).alias("queries_per_minute"), F.when(seen > 0, hits / seen).alias("hit_rate"))


def per_method(log: DataFrame) -> DataFrame:
    return log.groupBy("method").agg(F.count(F.lit(1)).alias("searches"), F.avg("duration_ms").alias("avg_ms"), percentile("duration_ms", 0.95).alias("p95_ms"))


def snapshots(log: DataFrame, every: str = "60 seconds") -> DataFrame:
    """(window_start, searches, avg_ms) of tumbling windows; works on batch and streaming logs."""
    out = log.groupBy(F.window("ts", every)).agg(F.count(F.lit(1)).alias("searches"), F.avg("duration_ms").alias("avg_ms"))
    return out.select(F.col("window.start").alias("window_start"), "searches", "avg_ms")


class Timer:
    """Elapsed milliseconds by name, with splits."""

    def __init__(self) -> None:
        self.began: dict[str, float] = {}
        self.splits: dict[str, list[float]] = {}

    def start(self, name: str) -> None:
        self.began[name], self.splits[name] = time.perf_counter(), []

    def elapsed(self, name: str) -> float:
        return (time.perf_counter() - self.began[name]) * 1000

    def split(self, name: str) -> float:
        self.splits[name].append(self.elapsed(name))
        return self.splits[name][-1]

    def stop(self, name: str) -> float:
        value = self.elapsed(name)
        del self.began[name]
        return value

    @contextmanager
    def measure(self, name: str) -> Iterator[None]:
        self.start(name)
        try:
            yield
        finally:
            self.splits[name].append(self.stop(name))
