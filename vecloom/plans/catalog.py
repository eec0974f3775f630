"""Catalogue of the engine's own queries over the test tables, each with the SQL it must agree with.

Floats are rounded to six places (and have 0.0 added, against negative zeros); ties are settled by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.filters import ColumnFields, JsonFields, all_of, any_of, compile_filter, lookup, none_of
from ..functions.metrics import METRICS, dot, euclidean, normalized, vector_literal
from ..operators import cluster, graph, monitor, mutations, stats
from ..operators.index.hnsw import SmallWorldIndex
from ..operators.index.ivf import ClusterIndex
from ..operators.index.lsh import SignHashIndex
from ..operators.index.pq import ProductQuantizer
from ..operators.rerank import diversity, standard, weighted
from ..operators.search import batch_nearest, nearest, similar_to
from ..streaming.ingest import drained, sessions, tumbling

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The batch queries are the records whose id is divisible by EVERY; the capacity of a partition; the relationship
#: threshold over unit vectors.
EVERY, CAPACITY, THRESHOLD = 50, 100, 1.1


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as records: id, seq, vector, partition_id (label modulo 5), metadata JSON with the label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"), F.pmod("label", F.lit(5)).cast("string").alias("partition_id"), "label", F.to_json(F.struct("label")).alias("metadata")
    )


def rounded(c: str, digits: int = 6):
    return (F.round(c, digits) + F.lit(0.0)).alias(c)


def first_vector(records: DataFrame) -> list[float]:
    return records.where("id = 0").first().vector


# --- nearest neighbours ---------------------------------------------------------------------------------------------

_A, _B = "q.embedding::DOUBLE[]", "e.embedding::DOUBLE[]"
_ZIP = f"list_transform(list_zip({_A}, {_B}), lambda z: {{}})"
_DISTANCE = {
    "euclidean": f"list_distance({_A}, {_B})",
    "cosine": f"1 - list_cosine_similarity({_A}, {_B})",
    "manhattan": f"list_sum({_ZIP.format('abs(z[1] - z[2])')})",
    "chebyshev": f"list_max({_ZIP.format('abs(z[1] - z[2])')})",
    "squared_euclidean": f"list_sum({_ZIP.format('(z[1] - z[2]) * (z[1] - z[2])')})",
    "hamming": f"list_sum({_ZIP.format('CASE WHEN z[1] <> z[2] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END')})",
    "dot": f"list_dot_product({_A}, {_B})",
    "inner": f"-list_dot_product({_A}, {_B})",
}


def _knn(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = embeddings(spark, sf_dir)
        return nearest(e, first_vector(e), 10, name).select(F.col("id").alias("vec_id"), rounded("dist"))

    run.__name__ = f"knn_{name}"
    order = "DESC" if METRICS[name].similarity else "ASC"
    query(f"SELECT e.vec_id, round({_DISTANCE[name]}, 6) + 0.0 AS dist FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_DISTANCE[name]} {order}, e.vec_id LIMIT 10")(run)


for _name in _DISTANCE:
    _knn(_name)


@query("SELECT e.vec_id, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS dist FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label IN (1, 3) ORDER BY list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id LIMIT 10")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    where = compile_filter([{"field": "label", "operator": "$in", "value": [1, 3]}], JsonFields("metadata"))
    return nearest(e, first_vector(e), 10, where=where).select(F.col("id").alias("vec_id"), rounded("dist"))


@query("SELECT e.vec_id, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS dist FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id LIMIT 10 OFFSET 10")
def knn_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return nearest(e, first_vector(e), 10, offset=10).select(F.col("id").alias("vec_id"), rounded("dist"))


@query("SELECT e.vec_id, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS dist FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label % 5 IN (1, 2) ORDER BY list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id LIMIT 10")
def knn_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return nearest(e, first_vector(e), 10, partition_ids=["1", "2"]).select(F.col("id").alias("vec_id"), rounded("dist"))


@query(
    """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 2 = 1 THEN list_slice(embedding::DOUBLE[], 1, 32) ELSE embedding::DOUBLE[] END AS x FROM embeddings),
    d AS (SELECT e.vec_id, sqrt(list_sum(list_transform(list_zip(list_slice(q.x, 1, least(len(q.x), len(e.x))), list_slice(e.x, 1, least(len(q.x), len(e.x)))), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + 0.01 * abs(len(q.x) - len(e.x))) AS dist
    FROM v e, v q WHERE q.vec_id = 0)
    SELECT vec_id, round(dist, 6) + 0.0 AS dist FROM d ORDER BY d.dist, vec_id LIMIT 20"""
)
def knn_mixed_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    query_vector = first_vector(e)
    e = e.withColumn("vector", F.when(F.col("id") % 2 == 1, F.slice("vector", 1, 32)).otherwise(F.col("vector")))
    return nearest(e, query_vector, 20).select(F.col("id").alias("vec_id"), rounded("dist"))


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = embeddings(spark, sf_dir)
    return e, e.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("qvector"), F.col("id").alias("self_id"))


def _batch_sql(where: str, by: str, distance: str = "euclidean", k: int = 10, cols: str = "") -> str:
    return f"""WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, {_DISTANCE[distance]} AS dist FROM embeddings e, embeddings q WHERE q.vec_id % {EVERY} = 0 AND {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY dist, vec_id) AS rank FROM d)
    SELECT query_id, {cols} CAST(rank AS INTEGER) AS rank, vec_id, round(dist, 6) + 0.0 AS dist FROM r WHERE rank <= {k}"""


@query(_batch_sql("true", "query_id"))
def batch_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _batch(spark, sf_dir)
    return batch_nearest(e, q, 10).select("query_id", "rank", F.col("id").alias("vec_id"), rounded("dist"))


@query(_batch_sql("true", "query_id", "cosine"))
def batch_knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _batch(spark, sf_dir)
    return batch_nearest(e, q, 10, "cosine").select("query_id", "rank", F.col("id").alias("vec_id"), rounded("dist"))


@query(_batch_sql("q.vec_id <> e.vec_id", "query_id", k=5))
def similar_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _batch(spark, sf_dir)
    return similar_to(e, q.select("query_id"), 5).select("query_id", "rank", F.col("id").alias("vec_id"), rounded("dist"))


@query(_batch_sql("true", "query_id, label % 5", k=3, cols="CAST(label % 5 AS VARCHAR) AS partition_id,"))
def knn_per_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _batch(spark, sf_dir)
    return batch_nearest(e, q, 3, per_partition=True).select("query_id", "partition_id", "rank", F.col("id").alias("vec_id"), rounded("dist"))


@query(_batch_sql("e.label % 5 IN (q.label % 5, 0)", "query_id", k=5))
def batch_knn_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _batch(spark, sf_dir)
    q = e.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("qvector"), F.array_distinct(F.array("partition_id", F.lit("0"))).alias("partition_ids"))
    return batch_nearest(e, q, 5).select("query_id", "rank", F.col("id").alias("vec_id"), rounded("dist"))


# --- metadata --------------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _filter_query(name: str, filters, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _events(spark, sf_dir).where(compile_filter(filters, JsonFields("props"))).select("event_id")

    run.__name__ = name
    query(f"SELECT event_id FROM events WHERE props IS NOT NULL AND ({sql})")(run)


_K = "CAST(props->>'k' AS DOUBLE)"
for _name, _filters, _sql in (
    ("filter_eq", {"k": 87}, f"{_K} = 87"),
    ("filter_ne", [{"field": "k", "operator": "$ne", "value": 87}], f"{_K} IS DISTINCT FROM 87"),
    ("filter_gt", [{"field": "k", "operator": "$gt", "value": 90}], f"{_K} > 90"),
    ("filter_gte", [{"field": "k", "operator": "$gte", "value": 50}], f"{_K} >= 50"),
    ("filter_lt", [{"field": "k", "operator": "$lt", "value": 10}], f"{_K} < 10"),
    ("filter_lte", [{"field": "k", "operator": "$lte", "value": 10}], f"{_K} <= 10"),
    ("filter_in", [{"field": "k", "operator": "$in", "value": [1, 2, 3]}], f"{_K} IN (1, 2, 3)"),
    ("filter_nin", [{"field": "k", "operator": "$nin", "value": [1, 2, 3]}], f"coalesce({_K} NOT IN (1, 2, 3), true)"),
    ("filter_exists", [{"field": "k", "operator": "$exists", "value": True}], "props->>'k' IS NOT NULL"),
    ("filter_not_exists", [{"field": "missing", "operator": "$exists", "value": False}], "props->>'missing' IS NULL"),
    (
        "filter_and_or_not",
        any_of(all_of({"field": "k", "operator": "$gte", "value": 20}, {"field": "k", "operator": "$lt", "value": 30}), none_of({"field": "k", "operator": "$lt", "value": 95})),
        f"({_K} >= 20 AND {_K} < 30) OR NOT ({_K} < 95)",
    ),
):
    _filter_query(_name, _filters, _sql)


def _metadata_query(name: str, filters, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "vectors").where(compile_filter(filters, JsonFields("metadata"))).select("partition_id", "id", "seq")

    run.__name__ = name
    query(f"SELECT partition_id, id, seq FROM (SELECT *, json_valid(metadata) AND json_type(metadata) = 'OBJECT' AS ok FROM vectors) WHERE {sql}")(run)


for _name, _filters, _sql in (
    ("metadata_typed", [{"field": "popularity", "operator": "$gte", "value": 50}], "CASE WHEN ok AND json_type(metadata, '$.popularity') IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'VARCHAR') THEN try_cast(trim(json_extract_string(metadata, '$.popularity')) AS DOUBLE) >= 50 END"),
    ("metadata_exists", [{"field": "rating", "operator": "$exists", "value": True}], "CASE WHEN ok THEN coalesce(json_type(metadata, '$.rating'), 'NULL') <> 'NULL' END"),
    ("metadata_not_exists", [{"field": "rating", "operator": "$exists", "value": False}], "CASE WHEN ok THEN coalesce(json_type(metadata, '$.rating'), 'NULL') = 'NULL' END"),
    ("metadata_regex", [{"field": "category", "operator": "$regex", "value": "^[a-m].*e"}], "CASE WHEN ok AND json_type(metadata, '$.category') = 'VARCHAR' THEN regexp_matches(json_extract_string(metadata, '$.category'), '^[a-m].*e') END"),
):
    _metadata_query(_name, _filters, _sql)


@query("SELECT event_id FROM events WHERE regexp_matches(event_type, '^[a-c]') AND value > 50")
def filter_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.where(compile_filter([{"field": "event_type", "operator": "$regex", "value": "^[a-c]"}, {"field": "value", "operator": "$gt", "value": 50}], ColumnFields(e))).select("event_id")


@query("SELECT event_id FROM events WHERE json_type(props, '$.k') IS NOT NULL")
def metadata_lookup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(_events(spark, sf_dir), "k", metadata="props").select("event_id")


@query(f"SELECT event_id FROM events WHERE {_K} = 5")
def metadata_lookup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(_events(spark, sf_dir), ["k"], [5], metadata="props").select("event_id")


@query(f"SELECT event_id FROM events WHERE {_K} = 7 ORDER BY event_id LIMIT 25")
def metadata_lookup_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(_events(spark, sf_dir), {"k": 7}, limit=25, metadata="props", order="event_id").select("event_id")


@query(
    """SELECT partition_id, id, seq FROM (SELECT * FROM vectors WHERE json_valid(metadata)) WHERE json_extract_string(metadata, '$.category') = 'article'
    AND json_type(metadata, '$.rating') IN ('DOUBLE', 'BIGINT', 'UBIGINT') AND try_cast(json_extract_string(metadata, '$.rating') AS DOUBLE) >= 4
    AND json_type(metadata, '$.flags.published') = 'BOOLEAN' AND json_extract_string(metadata, '$.flags.published') = 'true'"""
)
def filter_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vectors")
    f = [{"field": "category", "value": "article"}, {"field": "rating", "operator": "$gte", "value": 4}, {"field": "rating", "operator": "$exists", "value": True}, {"field": "flags.published", "value": True}]
    fields = JsonFields("metadata")
    return v.where(compile_filter(f, fields) & fields("rating").number.isNotNull()).select("partition_id", "id", "seq")


# --- graph -----------------------------------------------------------------------------------------------------------

_PAIRS = f"SELECT a.vec_id AS id_a, b.vec_id AS id_b, a.label % 5 AS pa, b.label % 5 AS pb, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= {THRESHOLD}"
_COMPONENTS = """WITH RECURSIVE p AS ({pairs}), e AS (SELECT id_a AS s, id_b AS t FROM p UNION ALL SELECT id_b, id_a FROM p),
    r(id, root) AS (SELECT DISTINCT s, s FROM e UNION SELECT e.t, r.root FROM r JOIN e ON e.s = r.id)
    SELECT id AS vec_id, min(root) AS community FROM r GROUP BY id"""


@query(f"WITH p AS ({_PAIRS}) SELECT id_a, id_b, round(dist, 6) + 0.0 AS dist FROM p")
def relationships_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relationships(embeddings(spark, sf_dir), THRESHOLD, scope="global").select("id_a", "id_b", rounded("dist"))


@query(f"WITH p AS ({_PAIRS}) SELECT CAST(pa AS VARCHAR) AS partition_id, id_a, id_b, round(dist, 6) + 0.0 AS dist FROM p WHERE pa = pb")
def relationships_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relationships(embeddings(spark, sf_dir), THRESHOLD).select("partition_id", "id_a", "id_b", rounded("dist"))


@query(f"WITH p AS ({_PAIRS}) SELECT id_a AS id, count(*) AS links FROM (SELECT id_a FROM p UNION ALL SELECT id_b FROM p) GROUP BY id_a")
def relationship_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = graph.relationships(embeddings(spark, sf_dir), THRESHOLD, scope="global")
    return pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))


@query(_COMPONENTS.format(pairs=_PAIRS))
def communities_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.communities(embeddings(spark, sf_dir), THRESHOLD, scope="global").select(F.col("id").alias("vec_id"), "community")


@query(_COMPONENTS.format(pairs=f"SELECT * FROM ({_PAIRS}) WHERE pa = pb"))
def communities_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.communities(embeddings(spark, sf_dir), THRESHOLD).select(F.col("id").alias("vec_id"), "community")


# --- reranking -------------------------------------------------------------------------------------------------------


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e, q = _batch(spark, sf_dir)
    return e, batch_nearest(e, q, 10)


_DELIVERED = """SELECT query_id, id, dist, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, seq) AS INTEGER) AS rank FROM (
    SELECT query_id, id, dist, seq FROM search_results WHERE query_id IS NOT NULL AND id IS NOT NULL AND seq IS NOT NULL AND dist IS NOT NULL AND NOT isnan(dist)
    QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY dist, seq) = 1)"""


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, id, dist, rank): every query's delivered ids at their least distance, ranked."""
    r = table(spark, sf_dir, "search_results").where("query_id IS NOT NULL AND id IS NOT NULL AND seq IS NOT NULL AND dist IS NOT NULL AND NOT isnan(dist)")
    best = r.groupBy("query_id", "id").agg(F.min(F.struct("dist", "seq")).alias("m")).select("query_id", "id", "m.dist", "m.seq")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "seq")).cast("int")
    return best.withColumn("rank", rank).drop("seq")


@query(
    f"""WITH b AS ({_DELIVERED}), m AS (SELECT id, metadata FROM vectors WHERE metadata IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
    v AS (SELECT b.query_id, b.id, b.rank AS before, b.dist, CASE WHEN json_valid(metadata) AND json_type(metadata) = 'OBJECT' THEN metadata END AS j FROM b LEFT JOIN m USING (id)),
    s AS (SELECT query_id, id, before, dist - (0::DOUBLE + {{0}} * 0.1::DOUBLE + {{1}} * 0.05::DOUBLE) AS score FROM v)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, before) AS INTEGER) AS rank, id, round(score, 6) + 0.0 AS weighted_score FROM s""".format(
        *[f"coalesce(CASE WHEN json_type(j, '$.{f}') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(json_extract(j, '$.{f}') AS DOUBLE) END, 0)" for f in ("rating", "recency")]
    )
)
def rerank_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vectors").where("id IS NOT NULL AND metadata IS NOT NULL").groupBy("id").agg(F.max_by("metadata", "seq").alias("metadata"))
    out = weighted(_delivered(spark, sf_dir).join(v, "id", "left"), {"rating": 0.1, "recency": 0.05})
    return out.select("query_id", "rank", "id", rounded("weighted_score"))


@query(f"SELECT query_id, rank, id FROM ({_DELIVERED}) WHERE rank <= 4")
def rerank_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standard(_delivered(spark, sf_dir), 4).select("query_id", "rank", "id")


def _mmr_sql(k: int = 4, balance: float = 0.7) -> str:
    base = _batch_sql("true", "query_id")
    ctes = [f"b AS ({base})", "x AS (SELECT b.query_id, b.vec_id, b.rank, r.dist AS d, e.embedding::DOUBLE[] AS v FROM b JOIN embeddings e USING (vec_id) JOIN embeddings q ON q.vec_id = b.query_id, LATERAL (SELECT list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS dist) r)"]
    ctes.append("s1 AS (SELECT query_id, vec_id, v, 1 AS place FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, rank) = 1)")
    for i in range(2, k + 1):
        ctes.append(
            f"s{i} AS (SELECT * FROM s{i - 1} UNION ALL (SELECT query_id, vec_id, v, {i} AS place FROM (SELECT x.query_id, x.vec_id, x.v, x.rank, {balance} / (1 + any_value(x.d)) + {1 - balance} * min(list_distance(x.v, c.v)) AS score "
            f"FROM x JOIN s{i - 1} c USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM s{i - 1} o WHERE o.query_id = x.query_id AND o.vec_id = x.vec_id) GROUP BY x.query_id, x.vec_id, x.v, x.rank) "
            f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank) = 1))"
        )
    return f"WITH {', '.join(ctes)} SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id FROM s{k}"


@query(_mmr_sql())
def rerank_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = _results(spark, sf_dir)
    return diversity(r, e, 4).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"))


# --- clusters and indexes --------------------------------------------------------------------------------------------

_CENTROIDS = "SELECT label, i, avg(x) AS c FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1, 2"


@query(f"SELECT label, CAST(i AS INTEGER) AS i, round(c, 6) + 0.0 AS c FROM ({_CENTROIDS})")
def centroid_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cluster.centroids_of(embeddings(spark, sf_dir), "label")
    return c.select("label", F.posexplode("centroid").alias("i", "c")).select("label", "i", rounded("c"))


@query(
    f"""WITH c AS (SELECT label, list(c ORDER BY i) AS v FROM ({_CENTROIDS}) GROUP BY 1)
    SELECT e.vec_id, c.label AS cluster_id FROM embeddings e, c QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], c.v), c.label) = 1"""
)
def assign_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    c = cluster.centroids_of(e, "label").select(F.col("label").alias("cluster_id"), "centroid")
    return cluster.assign(e, c).select(F.col("id").alias("vec_id"), "cluster_id")


@query(
    f"""WITH c AS (SELECT label, list(c ORDER BY i) AS v FROM ({_CENTROIDS}) GROUP BY 1)
    SELECT e.label AS cluster_id, count(*) AS size, CAST(any_value(len(c.v)) AS INTEGER) AS dim, round(any_value(sqrt(list_dot_product(c.v, c.v))), 6) + 0.0 AS centroid_norm, round(max(list_distance(e.embedding::DOUBLE[], c.v)), 6) + 0.0 AS radius
    FROM embeddings e JOIN c USING (label) GROUP BY 1"""
)
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir).withColumnRenamed("label", "cluster_id")
    s = cluster.cluster_stats(e, cluster.centroids_of(e).select("cluster_id", "centroid"))
    return s.select("cluster_id", "size", "dim", rounded("centroid_norm"), rounded("radius"))


@query("SELECT vec_id, i, x FROM (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i, round(unnest(embedding::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) + 0.0 AS x FROM embeddings)")
def normalized_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir).select(F.col("id").alias("vec_id"), F.posexplode(normalized(F.col("vector"))).alias("i", "x"))
    return e.select("vec_id", "i", rounded("x"))


@query("SELECT count(*) AS members, CAST(10 AS BIGINT) AS clusters, true AS nearest, true AS tighter FROM embeddings")
def kmeans_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record is in one of the ten clusters, in that of its nearest centroid, and the clusters are tighter than the
    labels' own centroids are."""
    e = embeddings(spark, sf_dir)
    c = cluster.kmeans(e, 10)
    placed = cluster.assign(e, c)
    rows = c.orderBy("cluster_id").collect()
    each = F.array(*[F.struct(euclidean(F.col("vector"), vector_literal(r.centroid)).alias("d"), F.lit(r.cluster_id).alias("c")) for r in rows])
    labels = cluster.centroids_of(e, "label").select("label", "centroid")
    own = e.join(F.broadcast(labels), "label").agg(F.avg(F.pow(euclidean(F.col("vector"), F.col("centroid")), 2)).alias("label_spread"))
    out = placed.withColumn("best", F.array_min(each)).agg(
        F.count("cluster_id").alias("members"), F.countDistinct("cluster_id").alias("clusters"), F.bool_and(F.abs(F.element_at(each, F.col("cluster_id") + 1)["d"] - F.col("best.d")) < 1e-6).alias("nearest"), F.avg(F.pow("best.d", 2)).alias("spread")
    )
    return out.crossJoin(own).select("members", "clusters", "nearest", (F.col("spread") < F.col("label_spread")).alias("tighter"))


@query(f"SELECT vec_id, dist FROM ({_SQL['knn_euclidean']})")
def ivf_all_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return ClusterIndex.build(e, 8).search(first_vector(e), 10).select(F.col("id").alias("vec_id"), rounded("dist"))


def _recall(found: DataFrame, e: DataFrame, q: DataFrame, k: int = 10) -> DataFrame:
    """One row (queries, places, reached): whether at least nine tenths of the true k nearest of every query were found."""
    true = batch_nearest(e, q, k).select("query_id", "id")
    hit = found.select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    return true.join(hit, ["query_id", "id"], "left").agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("places"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count(F.lit(1))).alias("reached"))


_REACHED = f"SELECT count(*) AS queries, 10 * count(*) AS places, true AS reached FROM embeddings WHERE vec_id % {EVERY} = 0"


@query(_REACHED)
def ivf_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _batch(spark, sf_dir)
    return _recall(ClusterIndex.build(e, 16).batch_search(q, 10, nprobe=11), e, q)


@query(_REACHED)
def lsh_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _batch(spark, sf_dir)
    return _recall(SignHashIndex.build(e, tables=24, hashes=6, buckets=64).batch_search(q, 10, probes=3), e, q)


@query("SELECT CAST(8 AS BIGINT) AS tables, 8 * count(*) AS entries, count(*) AS ids, true AS right_buckets FROM embeddings")
def lsh_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record is once in each table, in the bucket of its own signs."""
    e = embeddings(spark, sf_dir)
    index = SignHashIndex.build(e, tables=8, hashes=6)
    planes = index.model.planes(64)
    sign = lambda t: sum((F.when(dot(F.col("vector"), vector_literal(planes[t, h])) >= 0, F.lit(2**h)).otherwise(F.lit(0)) for h in range(6)), F.lit(0))
    own = e.select("id", F.array(*[sign(t) for t in range(8)]).alias("signs"))
    rows = index.buckets.join(own, "id").withColumn("right", F.element_at("signs", F.col("table_no") + 1) == F.col("bucket"))
    return rows.agg(F.countDistinct("table_no").alias("tables"), F.countDistinct("table_no", "id").alias("entries"), F.countDistinct("id").alias("ids"), F.bool_and("right").alias("right_buckets"))


@query(_REACHED)
def pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the records is re-ranked by true distances."""
    e, q = _batch(spark, sf_dir)
    pq = ProductQuantizer.train(e, clusters=64)
    return _recall(pq.batch_search(pq.encode(e), q, 10, exact_from=max(120, e.count() // 5)), e, q)


@query(_REACHED)
def hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _batch(spark, sf_dir)
    return _recall(SmallWorldIndex.build(e, ef_construction=60).batch_search(q, 10, ef_search=120), e, q)


@query("SELECT count(*) AS members, true AS bounded, true AS numbered FROM embeddings")
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of leader clustering: every record is placed, no cluster is larger than it may grow, and clusters are
    numbered in the order in which their first records arrived."""
    placed = cluster.leader_clusters(embeddings(spark, sf_dir), cluster_size=100, size_factor=1.5, threshold=1.2)
    each = placed.groupBy("partition_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("opened"))
    before = F.lag("opened").over(Window.partitionBy("partition_id").orderBy("cluster_id"))
    each = each.withColumn("ordered", F.coalesce(before < F.col("opened"), F.lit(True)))
    return each.agg(F.sum("n").alias("members"), (F.max("n") <= 150).alias("bounded"), F.bool_and("ordered").alias("numbered"))


# --- statistics and monitoring ---------------------------------------------------------------------------------------


@query("SELECT CAST(len(vector) AS INTEGER) AS dim, count(*) AS n FROM vectors WHERE vector IS NOT NULL GROUP BY 1")
def dim_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dim_histogram(table(spark, sf_dir, "vectors"))


@query("SELECT CAST(len(vector) AS INTEGER) AS dim FROM vectors WHERE vector IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def most_common_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.most_common_dim(table(spark, sf_dir, "vectors"))


@query("SELECT count(vector) AS vector_count, count(metadata) AS metadata_count, count(DISTINCT len(vector)) AS dims, CAST(sum(coalesce(len(vector), 0) * 4 + coalesce(length(metadata), 0) * 2) AS BIGINT) AS memory_bytes FROM vectors")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.collection_stats(table(spark, sf_dir, "vectors"))


@query(
    """SELECT p.partition_id, partition_name, active, count(v.partition_id) AS vector_count, count(DISTINCT len(v.vector)) AS dims, count(v.partition_id) / capacity AS fill
    FROM vector_partitions p LEFT JOIN vectors v USING (partition_id) GROUP BY p.partition_id, partition_name, active, capacity"""
)
def partition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.partition_stats(table(spark, sf_dir, "vectors"), table(spark, sf_dir, "vector_partitions"))


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1")
def monitor_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(monitor.percentile("value", 0.95).alias("p95"), F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, count(*) AS searches, round(avg(value), 6) + 0.0 AS avg_ms FROM events GROUP BY 1")
def qpm_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("duration_ms"))
    return monitor.snapshots(log, "1 hour").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "searches", rounded("avg_ms"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) + 0.0 AS average FROM events")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("average", monitor.moving_average("value", ["ts", "event_id"], 10, ["user_id"])).select("event_id", rounded("average"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _events(spark, sf_dir).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM events GROUP BY 1")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained(tumbling(_event_stream(spark, sf_dir)))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", rounded("total"))


@query(
    """WITH s AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT user_id, ts, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM n GROUP BY user_id, session"""
)
def sessions_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("SELECT e.vec_id, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS dist FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND (e.vec_id + e.label) % 3 = 0 ORDER BY list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id LIMIT 10")
def knn_filter_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return nearest(e, first_vector(e), 10, where=lambda id, m: (id + m["label"]) % 3 == 0).select(F.col("id").alias("vec_id"), rounded("dist"))


# --- mutations -------------------------------------------------------------------------------------------------------

_WINNER = "row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "vectors").select("partition_id", "id", "id_is_num", "seq", "vector", "metadata").dropDuplicates(["id", "id_is_num", "seq"])


@query(
    f"""WITH w AS (SELECT DISTINCT ON (id, id_is_num, seq) partition_id, id, id_is_num, seq, vector, metadata FROM vectors),
    m AS (SELECT id, id_is_num, arg_max(metadata, seq) AS metadata FROM w WHERE metadata IS NOT NULL GROUP BY 1, 2)
    SELECT w.partition_id, w.id, w.seq, CAST(coalesce(len(w.vector), -1) AS INTEGER) AS dim, m.metadata FROM w LEFT JOIN m USING (id, id_is_num)
    QUALIFY row_number() OVER (PARTITION BY w.id, w.id_is_num ORDER BY w.seq DESC) = 1"""
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _writes(spark, sf_dir)
    middle = w.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    out = mutations.upsert(w.where(F.col("seq") <= middle), w.where(F.col("seq") > middle))
    return out.select("partition_id", "id", "seq", F.coalesce(F.size("vector"), F.lit(-1)).alias("dim"), "metadata")


@query("SELECT id, seq FROM (SELECT DISTINCT id, id_is_num, seq FROM vectors) v WHERE NOT EXISTS (SELECT 1 FROM vectors d WHERE d.id = v.id AND d.id_is_num = v.id_is_num AND d.vector IS NULL)")
def delete_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _writes(spark, sf_dir)
    return mutations.delete(w, w.where("vector IS NULL")).select("id", "seq")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind FROM events""")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _events(spark, sf_dir).select("event_id", mutations.merged_json(F.col("props"), F.to_json(F.struct(F.col("event_type").alias("kind")))).alias("m"))
    return merged.select("event_id", F.get_json_object("m", "$.k").alias("k"), F.get_json_object("m", "$.kind").alias("kind"))


@query(f"SELECT vec_id, CAST(floor((30 + row_number() OVER (ORDER BY vec_id) - 1) / {CAPACITY}) AS INTEGER) AS partition_no FROM embeddings")
def partition_spill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = mutations.numbered(table(spark, sf_dir, "embeddings").select("vec_id"), ["vec_id"])
    return mutations.spilled(e, 30, CAPACITY).select("vec_id", "partition_no")


@query(
    """WITH o AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL WHEN vec_id % 50 = 1 THEN vec_id * 2 END AS explicit, vec_id % 3 <> 0 AND vec_id % 50 <> 1 AS text FROM embeddings),
    a AS (SELECT *, explicit IS NULL AND NOT text AS auto, count(*) FILTER (explicit IS NULL AND NOT text) OVER (ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM o)
    SELECT vec_id, CASE WHEN auto THEN CAST(n + greatest(1, coalesce(max(explicit + 1 - n) OVER (ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)) AS VARCHAR) WHEN text THEN 't' || vec_id ELSE CAST(explicit AS VARCHAR) END AS id FROM a"""
)
def auto_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("pos"), F.when(v % 3 == 0, None).when(v % 50 == 1, (v * 2).cast("string")).otherwise(F.concat(F.lit("t"), v)).alias("id"), ((v % 3 != 0) & (v % 50 == 1)).alias("id_is_num"))
    return mutations.assign_ids(e).select("vec_id", "id")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
