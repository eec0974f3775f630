"""Top N, rank fusion and varied subsets against brute force."""

import json
import math
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.llm import common, p1_subset, p4_top_n, p6_rank_fusion

from .conftest import VECTORS, record

QUERIES = "query_id bigint, k int, rerank_method string, partition_ids array<string>, weights string, rank int, n int, dist double"
RESULTS = "seq bigint, query_id bigint, partition_id string, id string, dist double, k int, fields string, rank int"


def made(seed=0, n=400):
    rng = np.random.default_rng(seed)
    queries = [
        (1, 3, "diversity", None, '{"rating": 0.5, "popularity": 1}', 0, 0, 0.0),
        (2, None, "diversity", [], '{"popularity": "0.3", "recency": -1}', 0, 0, 0.0),
        (3, 5, None, ["a", "b"], '{"rating": 0}', 0, 0, 0.0),
        (4, 0, "diversity", None, "not json", 0, 0, 0.0),
        (5, 2, "weighted", ["none"], None, 0, 0, 0.0),
        (6, 4, "diversity", [None, "c"], '{"nowhere": 2.0}', 0, 0, 0.0),
        (7, 20, "diversity", None, '{"rating": 1.0}', 0, 0, 0.0),
    ]
    rows = []
    for s in range(n):
        dist = rng.choice([0.1, 0.2, 0.5, float(rng.random()), None, float("nan"), -0.0, 0.0, -1.5])
        rows.append((s, int(rng.choice([1, 1, 1, 1, 2, 3, 5, 6, 7, 99])), str(rng.choice(["a", "b", "c"])) if rng.random() < 0.9 else None, f"v{rng.integers(0, 60)}" if rng.random() < 0.97 else None, dist, 1, "x", 2))
    rows += [rows[3], rows[9], (None, 1, "a", "v1", 0.0, 1, "x", 2), (n, None, "a", "v1", 0.0, 1, "x", 2)]
    meta = []
    for i in range(60):
        m = {"rating": float(np.round(rng.random() * 5, 1)), "popularity": int(10 ** rng.integers(1, 6)), "recency": float(rng.random()), "category": str(rng.choice(["x", "Y", "z "]))}
        if i % 7 == 0:
            m["rating"] = rng.choice([1, 2]).item() and "2.5"
        if i % 11 == 0:
            del m["popularity"]
        if i % 13 == 0:
            m["rating"] = [None, "many", True, {"a": 1}][i // 13 % 4]
        meta.append(record(f"v{i}", i, rng.normal(size=6) if i % 5 else None, json.dumps(m)))
    meta += [record("v3", 500, [1.0] * 6, None), record("v4", -1, [1.0], '{"rating": 99}'), record("v5", 501, [1.0] * 6, ""), record("v6", 502, [1.0] * 6, "{broken")]
    return queries, rows, meta


@pytest.fixture(scope="module")
def tables(spark):
    q, r, v = made()
    return spark.createDataFrame(q, QUERIES), spark.createDataFrame(r, RESULTS).repartition(5), spark.createDataFrame(v, VECTORS)


def candidates(queries, rows):
    out = {}
    for q in queries:
        best = {}
        for seq, qid, part, id, dist, *_ in rows:
            if qid != q[0] or id is None or seq is None or dist is None or math.isnan(dist) or q[3] and part not in [p for p in q[3] if p]:
                continue
            best[id] = min(best.get(id, (math.inf, math.inf)), (dist + 0.0, seq))
        out[q[0]] = sorted((d, s, i) for i, (d, s) in best.items())
    return out


@pytest.mark.parametrize("large, keys", [(p4_top_n.LARGE_K, 400_000), (4, 400_000), (0, 0), (p4_top_n.LARGE_K, 0)])
def test_top_n(tables, monkeypatch, large, keys):
    monkeypatch.setattr(common, "BROADCAST_KEYS", keys)
    q, r, _ = made()
    most = {x[0]: 10 if x[1] is None else x[1] for x in q}
    want = {(k, i, d) for k, c in candidates(q, r).items() for d, s, i in c[: most[k]]}
    got = [(x.query_id, x.id, x.dist) for x in p4_top_n.top_n(tables[0], tables[1], large).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.floats(allow_nan=False), st.integers(-(2**62), 2**62)), min_size=1, max_size=80, unique_by=lambda x: (x[0], x[2])), st.integers(0, 9))
def test_bisection(rows, k):
    names, group = np.unique([r[0] for r in rows], return_inverse=True)
    seq = np.array([r[2] for r in rows], np.int64)
    kept = p4_top_n.keep_first(group, [p4_top_n.ordered_bits(np.array([r[1] for r in rows])), (seq ^ np.int64(-(2**63))).view(np.uint64)], np.full(len(names), k))
    want = {i for g in names for i in sorted((i for i, r in enumerate(rows) if r[0] == g), key=lambda i: (rows[i][1] + 0.0, rows[i][2]))[:k]}
    assert set(kept.tolist()) == want


def number(x):
    if isinstance(x, bool) or not isinstance(x, (int, float, str)):
        return None
    try:
        value = float(x)
    except ValueError:
        return None
    return value if math.isfinite(value) else None


def positive(weights):
    """Fields of weight above 0 with the power of their ranks."""
    try:
        w = json.loads(weights)
    except (TypeError, ValueError):
        return {}
    w = {f: number(x) for f, x in w.items() if (number(x) or 0) > 0}
    return {f: w[f] / max(w.values()) for f in sorted(w)}


def scores():
    q, r, v = made()
    meta = {}
    for row in sorted(v, key=lambda x: x[2]):
        if row[4] is not None:
            meta[row[1]] = row[4]
    out = {}
    for k, c in candidates(q, r).items():
        fields = positive({x[0]: x[4] for x in q}[k])
        if not fields or not c:
            continue
        columns = [{i: d for d, _, i in c}]
        for f in fields:
            col = {}
            for _, _, i in c:
                try:
                    value = number(json.loads(meta[i]).get(f))
                except (KeyError, ValueError):
                    value = None
                if value is not None:
                    col[i] = -value
            columns.append(col)
        ranks = {i: [1 + sum(y < col[i] for y in col.values()) if i in col else None for col in columns] for _, _, i in c}
        out[k] = (len(c), ranks, [1.0, *fields.values()])
    return out


def test_scores_and_significance(tables):
    want = scores()
    got = {(x.query_id, x.id): x for x in p6_rank_fusion.scored(*tables).collect()}
    assert set(got) == {(k, i) for k, (_, r, _) in want.items() for i in r} and len(want) == 4
    for k, (n, ranks, powers) in want.items():
        for i, r in ranks.items():
            x = sorted((v / n) ** p if v else 1.0 for v, p in zip(r, powers))
            m = len(x)
            p = min(1.0, m * min(sum(comb(m, t) * v**t * (1 - v) ** (m - t) for t in range(j, m + 1)) for j, v in enumerate(x, 1)))
            assert abs(got[k, i].significance - p) < 1e-9 and got[k, i].missing == r.count(None) and got[k, i].n == n


def test_weights_decide(spark):
    """Two items are first on one field each: the heavier field's comes first."""
    meta = [record(f"i{i}", i, [1.0], json.dumps({"a": 9 if i == 1 else i % 3, "b": 9 if i == 2 else i % 4})) for i in range(1, 9)]
    rows = [(i, q, "p", f"i{i}", 1.0, 1, "x", 2) for q in (1, 2) for i in range(1, 9)]
    queries = [(1, 3, None, None, '{"a": 2.5, "b": 0.05}', 0, 0, 0.0), (2, 3, None, None, '{"a": 0.05, "b": 2.5}', 0, 0, 0.0)]
    df = p6_rank_fusion.fused(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(rows, RESULTS), spark.createDataFrame(meta, VECTORS))
    assert {r.query_id: r.id for r in df.where("place = 1").collect()} == {1: "i1", 2: "i2"}


def test_order(tables):
    rows = p6_rank_fusion.fused(*tables).collect()
    for k, (n, _, _) in scores().items():
        mine = sorted((r.place, r.significance) for r in rows if r.query_id == k)
        assert [p for p, _ in mine] == list(range(1, n + 1)) and [s for _, s in mine] == sorted(s for _, s in mine)


def test_found_comes_from_the_order(spark, tables, tmp_path, monkeypatch):
    for name, df in zip(("queries", "search_results", "vectors"), tables):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    want = {(k, i) for k, (n, ranks, _) in scores().items() if n >= 5 for i, r in ranks.items() if None not in r and max(r) <= math.ceil(n / 5)}
    assert {(r.query_id, r.id) for r in p6_rank_fusion.p6_found(spark, str(tmp_path)).collect()} == want and want
    monkeypatch.setattr(p6_rank_fusion, "significance", lambda ranks, m: F.raise_error(F.concat(F.lit("evaluated "), m.cast("string"))).cast("double"))
    with pytest.raises(Exception, match="evaluated"):
        p6_rank_fusion.p6_found(spark, str(tmp_path)).collect()


def test_ranks_span_tasks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(1 if rng.random() < 0.9 else 2, float(rng.integers(0, 40))) for _ in range(500)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(4)
    monkeypatch.setattr(p6_rank_fusion, "partitions", lambda *_: 7)
    got = sorted((r.g, r.v, r["rank"]) for r in p6_rank_fusion.ranked(df, ["g"], ["v"], 1).collect())
    assert got == sorted((g, v, 1 + sum(a == g and b < v for a, b in rows)) for g, v in rows)


@pytest.mark.parametrize("quota", ["sqrt", "equal"])
def test_subset(tables, quota):
    q, r, v = made()
    diverse = tables[0].where("rerank_method = 'diversity'")
    got = {}
    for x in p1_subset.varied(diverse, tables[1], tables[2], quota).collect():
        got.setdefault(x.query_id, []).append(x)
    want = {k: c for k, c in candidates(q, r).items() if c and k in (1, 2, 6, 7)}
    assert set(got) == set(want)
    k_of = {1: 3, 2: 10, 6: 4, 7: 20}
    for k, rows in got.items():
        near = {i: d for d, _, i in want[k]}
        assert len(rows) == min(k_of[k], len(near)) == len({x.id for x in rows}) and {x.place for x in rows} == set(range(1, len(rows) + 1))
        assert all(near[x.id] == x.dist for x in rows)
        if quota == "equal" and len(rows) < len(near):
            # no cluster takes a second place before every cluster of the query has one
            sizes = np.unique([x.cluster for x in rows], return_counts=True)[1]
            assert sizes.max() - sizes.min() <= 1 or sizes.min() >= 1


def test_large_groups_do_not_take_most_places(spark):
    rng = np.random.default_rng(0)
    c = np.eye(8)
    rows = [record(f"m{i:03}", i, c[0] + 0.01 * rng.normal(size=8)) for i in range(200)] + [record(f"o{g}-{i}", 300 + 10 * g + i, c[g] + 0.01 * rng.normal(size=8)) for g in range(1, 6) for i in range(9)]
    v = spark.createDataFrame(rows, VECTORS)
    r = spark.createDataFrame([(i, 1, "a", x[1], 0.1 if x[1][0] == "m" else 0.2, 1, "x", 0) for i, x in enumerate(rows)], RESULTS)
    q = spark.createDataFrame([(1, 10, "diversity", None, None, 0, 0, 0.0)], QUERIES)
    got = p1_subset.varied(q, r, v).collect()
    assert len(got) == 10 and sum(x.id[0] == "m" for x in got) <= 6 and len({x.id.split("-")[0] for x in got if x.id[0] == "o"}) >= 3


def test_empty_tables(spark, tables, no_vectors):
    q, r = tables[0], tables[1]
    assert p4_top_n.top_n(q, r.where("false")).isEmpty() and p4_top_n.top_n(q.where("false"), r).isEmpty()
    assert p6_rank_fusion.scored(q, r.where("false"), no_vectors).isEmpty() and p6_rank_fusion.fused(q.where("false"), r, no_vectors).isEmpty()
    assert p1_subset.varied(q.where("false"), r, no_vectors).isEmpty()
    assert p1_subset.varied(q, r, no_vectors).where("cluster <> -1").isEmpty()
    with pytest.raises(ValueError):
        p1_subset.varied(q, r, no_vectors, "nonsense")
