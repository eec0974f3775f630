"""One ranking from several scores: robust rank aggregation.

Every score becomes ranks within its query, so scales and distributions no longer matter. An item's normalised ranks
are sorted; under the hypothesis of random order the j-th of m is a beta order statistic, and the least of the m
probabilities, corrected for taking a minimum (times m), is the item's significance. Items are ordered by it.

A weight says how much a field's ranks may count: a normalised rank r becomes r^(w / W), W the query's greatest weight.
Ranks of the greatest weight (and of the distance) stay as they are, those of small weights move towards 1, where they
lend no significance, and last ranks stay last whatever the weight.

Ranks of a query of any size are taken without gathering it: rows are range-partitioned by (group, value), each task
ranks its own run and the few groups that span tasks get the counts of the tasks before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage as cut
from .common import checked_broadcast, partitions, stored_metadata
from .p4_top_n import candidates

#: The name of the distance among the scores; no JSON field can carry it.
DISTANCE = "\x00dist"
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def number(text: Column) -> Column:
    """The finite double a string reads as, else null."""
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def _local_ranks(keys: list[str], order: list[str]):
    """Rank of each row within its run of equal ``keys`` in a task sorted by keys and order: 1 + rows strictly before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        last_key, last_value, seen, rank = None, None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in order]
            new_key = np.zeros(n, bool)
            new_value = np.zeros(n, bool)
            for c in columns:
                new_key[1:] |= c[1:] != c[:-1]
            for c in values:
                new_value[1:] |= c[1:] != c[:-1]
            new_key[0] = last_key != tuple(c[0] for c in columns)
            new_value[0] = last_value != tuple(c[0] for c in values)
            new_value |= new_key
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new_key, at, -1))
            position = np.where(start < 0, seen + at, at - start)
            first = np.maximum.accumulate(np.where(new_value, at, -1))
            ranks = np.where(first < 0, rank, position[np.maximum(first, 0)] + 1)
            last_key, last_value = tuple(c[-1] for c in columns), tuple(c[-1] for c in values)
            seen, rank = int(position[-1]) + 1, int(ranks[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks, pa.int64()), pa.array(np.full(n, task), pa.int32())], names=[*batch.schema.names, "rank", "task"])

    return run


def ranked(df: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """``df`` with ``rank``: 1 + the rows of the same ``keys`` strictly before by ``order`` (no nulls in either)."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", rank long, task int"
    sorted_rows = df.repartitionByRange(partitions(df.sparkSession, rows, 500_000), *keys, *order).sortWithinPartitions(*keys, *order)
    local = cut(sorted_rows.mapInArrow(_local_ranks(keys, order), schema))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    # a task has at most one group that began in an earlier task, so there are fewer offsets than tasks
    offsets = local.groupBy(*keys, "task").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).where("before > 0").select(*keys, "task", "before")
    joined = local.join(F.broadcast(offsets), [*keys, "task"], "left")
    return joined.withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0))).drop("before", "task")


def significance(ranks: Column, m: Column) -> Column:
    """Corrected least beta probability of the sorted normalised ``ranks`` of ``m`` lists."""
    # P(j-th of m uniforms <= x) = sum over i >= j of C(m, i) x^i (1 - x)^(m - i)
    def choose(n: Column, i: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), i), F.lit(1.0), lambda c, t: F.when(t == 0, c).otherwise(c * (n - t + 1) / t))

    def tail(x: Column, j: Column) -> Column:
        return F.aggregate(F.sequence(j, m), F.lit(0.0), lambda s, i: s + choose(m, i) * F.pow(x, i) * F.pow(1 - x, m - i))

    each = F.transform(F.sort_array(ranks), lambda x, j: tail(x, j + 1))
    return F.least(F.lit(1.0), F.array_min(each) * m)


def weighted_queries(queries: DataFrame) -> DataFrame:
    """(query_id, k, partition_ids, fields): queries whose weights give at least one field a number above 0; ``fields``
    are these fields with their power, the weight divided by the query's greatest."""
    w = F.from_json("weights", "map<string,string>")
    above = F.filter(F.transform(F.map_entries(w), lambda e: F.struct(e["key"].alias("field"), number(e["value"]).alias("w"))), lambda e: F.coalesce(e["w"] > 0, F.lit(False)))
    rows = queries.withColumn("above", above).where(F.size("above") > 0)
    most = F.array_max(F.transform("above", lambda e: e["w"]))
    return rows.select("query_id", "k", "partition_ids", F.transform("above", lambda e: F.struct(e["field"].alias("field"), (e["w"] / most).alias("power"))).alias("fields"))


def scored(queries: DataFrame, results: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, id, dist, seq, n, m, ranks, worst, missing, significance) of every candidate of a weighted query.

    ``ranks`` are normalised by the query's ``n`` candidates and raised to the powers of their weights, a missing score
    counting as last (1.0). Null or malformed metadata, absent fields and values that are no numbers are missing scores;
    equal scores share the better rank.
    """
    q = cut(weighted_queries(queries))
    n_queries = q.count()
    found = candidates(q, results)
    meta = F.from_json("metadata", "map<string,string>")
    wide = found.join(checked_broadcast(q.select("query_id", "fields"), n_queries), "query_id").join(stored_metadata(vectors), "id", "left").withColumn("meta", meta)
    scores = F.concat(
        F.array(F.struct(F.lit(DISTANCE).alias("field"), F.col("dist").alias("value"), F.lit(1.0).alias("power"))),
        F.transform("fields", lambda f: F.struct(f["field"].alias("field"), (-number(F.try_element_at("meta", f["field"]))).alias("value"), f["power"].alias("power"))),
    )
    long = wide.select("query_id", "id", "seq", F.size("fields").alias("fields"), "dist", F.explode(scores).alias("s")).select("query_id", "id", "seq", "dist", "fields", "s.field", "s.power", (F.col("s.value") + 0.0).alias("value")).where("value IS NOT NULL")
    ranks = ranked(long, ["query_id", "field"], ["value"], 3 * results.count())
    size = ranks.where(F.col("field") == DISTANCE).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    items = ranks.groupBy("query_id", "id").agg(F.collect_list(F.struct("rank", "power")).alias("r"), F.first("seq").alias("seq"), F.first("dist").alias("dist"), (F.first("fields") + 1).alias("m"))
    items = items.join(checked_broadcast(size, n_queries), "query_id")
    missing = F.col("m") - F.size("r")
    filled = F.concat(F.transform("r", lambda x: F.pow(x["rank"] / F.col("n"), x["power"])), F.array_repeat(F.lit(1.0), missing))
    worst = F.array_max(F.transform("r", lambda x: x["rank"]))
    out = items.select("query_id", "id", "dist", "seq", "n", "m", filled.alias("ranks"), worst.alias("worst"), missing.alias("missing"))
    return out.withColumn("significance", significance(F.col("ranks"), F.col("m")))


def fused(queries: DataFrame, results: DataFrame, vectors: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, place, id, significance, columns of :func:`scored` to keep): one order of each weighted query's
    candidates; equal significance goes to the lower mean rank, then the distance, then the arrival."""
    mean = F.aggregate("ranks", F.lit(0.0), lambda a, x: a + x) / F.col("m")
    rows = scored(queries, results, vectors).select("query_id", "id", F.round("significance", 12).alias("significance"), F.round(mean, 12).alias("mean"), "dist", "seq", *keep)
    return ranked(rows, ["query_id"], ["significance", "mean", "dist", "seq"], results.count()).select("query_id", F.col("rank").alias("place"), "id", "significance", *keep)


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("queries", "search_results", "vectors")]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the ranking, the candidates that are among the best fifth on every score.

    An item that is among the best fifth by distance has a least normalised rank of at most f = ceil(n / 5) / n, so its
    significance is at most m (1 - (1 - f)^m). The ranking's rows are taken down to that significance; the exact test of
    the ranks follows.
    """
    rows = cut(fused(*_tables(spark, sf_dir), keep=("n", "m", "worst", "missing")))
    fifth = F.ceil(F.col("n") / 5) / F.col("n")
    bound = F.least(F.lit(1.0), F.col("m") * (1 - F.pow(1 - fifth, F.col("m"))))
    significant = rows.where("n >= 5").where(F.col("significance") <= bound + 1e-9)
    return significant.where("missing = 0").where(F.col("worst") <= F.ceil(F.col("n") / 5)).select("query_id", "id")


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(*_tables(spark, sf_dir)).withColumn("significance", F.round("significance", 9))


_NUM = r"CASE WHEN regexp_matches({0}, '^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$') THEN try_cast(trim({0}) AS DOUBLE) END"
_SCORES = f"""
w AS (
  SELECT query_id, f, partition_ids, w / max(w) OVER (PARTITION BY query_id) AS power FROM (
    SELECT query_id, partition_ids, f, {_NUM.format("json_extract_string(j, '$.\"' || f || '\"')")} AS w FROM (
      SELECT query_id, partition_ids, json(weights) AS j, unnest(json_keys(json(weights))) AS f FROM queries WHERE json_valid(weights) AND json_type(json(weights)) = 'OBJECT'))
  WHERE w > 0),
q AS (SELECT query_id, any_value(partition_ids) AS partition_ids FROM w GROUP BY 1),
c AS (
  SELECT r.query_id, r.id, r.dist, r.seq FROM search_results r JOIN q USING (query_id)
  WHERE r.id IS NOT NULL AND r.dist IS NOT NULL AND NOT isnan(r.dist)
    AND (q.partition_ids IS NULL OR len(q.partition_ids) = 0 OR list_contains(q.partition_ids, r.partition_id))
  QUALIFY row_number() OVER (PARTITION BY r.query_id, r.id ORDER BY r.dist, r.seq) = 1),
n AS (SELECT query_id, count(*) AS n FROM c GROUP BY 1),
meta AS (
  SELECT id, CASE WHEN json_valid(metadata) AND json_type(json(metadata)) = 'OBJECT' THEN json(metadata) END AS j
  FROM vectors WHERE metadata IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
s AS (
  SELECT query_id, id, '' AS f, dist AS v, 1.0::DOUBLE AS power FROM c
  UNION ALL
  SELECT c.query_id, c.id, w.f, -({_NUM.format("json_extract_string(m.j, '$.\"' || w.f || '\"')")}), w.power
  FROM c JOIN w USING (query_id) LEFT JOIN meta m ON m.id = c.id),
r AS (SELECT query_id, id, v, power, rank() OVER (PARTITION BY query_id, f ORDER BY v NULLS LAST) AS rk FROM s)
"""
SQL = {
    "p6_found": f"""
WITH {_SCORES}
SELECT r.query_id, r.id FROM r JOIN n USING (query_id) WHERE n >= 5
GROUP BY r.query_id, r.id, n HAVING count(*) = count(v) AND max(rk) <= ceil(n / 5)
""",
    "p6_ranking": f"""
WITH {_SCORES},
x AS (
  SELECT r.query_id, r.id, list_sort(list(CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE pow(rk / n::DOUBLE, power) END)) AS x, count(*) AS m
  FROM r JOIN n USING (query_id) GROUP BY 1, 2),
p AS (
  SELECT query_id, id, round(list_sum(x) / m, 12) AS mean,
    round(least(1.0, m * list_min(list_transform(x, lambda p, j: list_sum(list_transform(range(j, m + 1), lambda i: factorial(m::INTEGER)::DOUBLE / (factorial(i::INTEGER)::DOUBLE * factorial((m - i)::INTEGER)::DOUBLE) * pow(p, i) * pow(1 - p, m - i)))))), 12) AS significance
  FROM x)
SELECT p.query_id, row_number() OVER (PARTITION BY p.query_id ORDER BY p.significance, p.mean, c.dist, c.seq) AS place, p.id, round(p.significance, 9) AS significance
FROM p JOIN c USING (query_id, id)
""",
}
