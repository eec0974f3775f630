"""Neighbours, clusters and near duplicates against brute force, with nulls, copies, ties and empty tables."""

from collections import Counter

import numpy as np
import pytest

from vecloom.llm import collisions, common, p2_knn, p3_clusters, p5_near_duplicates, vectors as v

from .conftest import VECTORS, cosines, grouped, record, stored


def neighbours(good, k, least):
    c = cosines(good)
    out = {}
    for i in good:
        near = sorted((-x, j) for (a, j), x in c.items() if a == i and x >= least)[:k]
        if near:
            out[i] = near
    return out


def test_neighbours(spark, vectors):
    want = neighbours(stored(grouped()), 5, 0.85)
    got = {(r.id_a, r.id_b) for r in p2_knn.near_pairs(vectors).collect()}
    assert got == {(min(i, j), max(i, j)) for i, near in want.items() for _, j in near} and len(got) > 100


@pytest.mark.parametrize("block", [p2_knn.OPEN_ROWS, 5])
def test_all_neighbours_of_all(spark, vectors, monkeypatch, block):
    """Records alone have their nearest too, however far."""
    monkeypatch.setattr(p2_knn.completed, "__defaults__", (p2_knn.RADII[-1], block))
    lists = {}
    for r in sorted(p2_knn.all_neighbours(vectors, 3).collect(), key=lambda r: r["rank"]):
        lists.setdefault(r.id, []).append((-r.cosine, r.neighbour_id))
    assert lists == neighbours(stored(grouped()), 3, -2) and min(len(x) for x in lists.values()) == 1


def test_exact_search_completes_what_cells_miss(spark, monkeypatch):
    rng = np.random.default_rng(21)
    rows = [record(f"r{i:03}", i, rng.normal(size=24)) for i in range(300)]
    monkeypatch.setattr(v, "CELL_ROWS", 20)
    monkeypatch.setattr(v.fit_directions, "__defaults__", (20, *v.fit_directions.__defaults__[1:]))
    df = spark.createDataFrame(rows, VECTORS)
    want = neighbours(stored(rows), 4, -2)
    merged, _, _ = p2_knn.nearest_classes(common.stored_vectors(df), 4, -1.0, 300)
    cells = {r.rep: {x[7:] for x in r.near[:4]} for r in merged.collect()}
    assert sum(len(cells[i] & {j for _, j in want[i]}) for i in want) < 0.9 * 4 * 300
    lists = {}
    for r in sorted(p2_knn.all_neighbours(df, 4).collect(), key=lambda r: r["rank"]):
        lists.setdefault(r.id, []).append((-r.cosine, r.neighbour_id))
    assert lists == want


@pytest.mark.parametrize("hot", [100_000, 7])
def test_many_copies_are_ordered_by_id(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_MEMBERS", hot)
    rows = [record(f"c{i:03}", i, [1.0, 2.0, 3.0]) for i in range(60)] + [record("scaled", 99, [2.0, 4.0, 6.0]), record("far", 100, [-1.0, 0.0, 0.0])]
    got = {}
    for r in p2_knn.all_neighbours(spark.createDataFrame(rows, VECTORS), 3).orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.neighbour_id)
    first = ["c000", "c001", "c002", "c003"]
    assert len(got) == 62 and all(got[i] == [x for x in first if x != i][:3] for i in got)


def test_blocks_of_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(v, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(4)
    c = rng.normal(size=16)
    rows = [record(f"r{i:03}", i, c + 0.4 * rng.normal(size=16) / 4) for i in range(150)]
    df = spark.createDataFrame(rows, VECTORS)
    assert v.fit_directions(p2_knn.stored_vectors(df), 150).blocks[16].max() > 2
    want = neighbours(stored(rows), 5, 0.85)
    assert {(r.id_a, r.id_b) for r in p2_knn.near_pairs(df).collect()} == {(min(i, j), max(i, j)) for i, near in want.items() for _, j in near}
    pairs = {frozenset(p) for p, x in cosines(stored(rows)).items() if x >= 0.95}
    got = {r.id: r.first_id for r in p3_clusters.cluster_members(df, 0.95).collect()}
    assert got == single_linkage(stored(rows), pairs)


def test_large_group_of_similar_rows_is_met_whole(spark, monkeypatch):
    monkeypatch.setattr(v, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(12)
    c = rng.normal(size=32)
    c /= np.linalg.norm(c)
    rows = [record(f"g{i:03}", i, c + 0.27 * rng.normal(size=32) / np.sqrt(32)) for i in range(400)] + [record(f"o{i:03}", 400 + i, rng.normal(size=32)) for i in range(400)]
    records = p2_knn.stored_vectors(spark.createDataFrame(rows, VECTORS))
    fit = v.fit_directions(records, 800, cell_rows=20)
    assert len(fit.centroids[32]) > 20
    got = {r.id: {x[7:] for x in r.near} for r in p2_knn.knn_lists(records, 5, 0.85, 800, fit).collect()}
    assert got == {i: {j for _, j in near} for i, near in neighbours(stored(rows), 5, 0.85).items()} and len(got) == 400


def test_collisions_decide_what_is_verified():
    rng = np.random.default_rng(3)
    groups = rng.normal(size=(60, 64))
    u = v.unit((groups[rng.integers(0, 60, 1_500)] + 0.25 * rng.normal(size=(1_500, 64))).astype(np.float32))
    axes = collisions.projections(u)
    arrays = collisions.SortedArrays(u @ axes)
    windows = collisions.Windows(arrays, 64, collisions.radius(0.85))
    words = windows.candidates((u @ axes)[:200])
    got = collisions.dense(words, len(u))
    # the bit-sliced count is the count of windows that hold the row, up to half a grid step
    p = u @ axes
    half = windows.step * collisions.STEPS
    inside = np.abs(p[:200, None] - p[None])
    sure, maybe = (inside <= half - 1e-5).sum(2), (inside <= half + windows.step + 1e-5).sum(2)
    assert (got >= (sure >= windows.need)).all() and (got <= (maybe >= windows.need)).all()
    q, c = collisions.members(words)
    assert (np.argwhere(got) == np.stack([q, c], axis=1)).all()
    work = np.zeros(2)
    q, n = p2_knn.top_of_array(u, u, 5, 0.85, True, work)
    assert work[1] < 0.2 * work[0]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    found = set(zip(q.tolist(), n.tolist()))
    best = [(i, j) for i in range(len(u)) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.85]
    assert sum(x in found for x in best) >= 0.995 * len(best)


def test_windows_lose_nothing(monkeypatch):
    monkeypatch.setattr(p2_knn, "TILE", 16)
    rng = np.random.default_rng(8)
    c = rng.normal(size=(9, 20))
    u = v.unit((c[rng.integers(0, 9, 300)] + 0.3 * rng.normal(size=(300, 20))).astype(np.float32))
    s = u @ u.T
    np.fill_diagonal(s, -2)
    for same, least in ((True, 0.85), (True, -1.0), (False, 0.9)):
        a, b = (u, u) if same else (u[:100], u[100:])
        t = s if same else s[:100, 100:]
        q, n = p2_knn.top_of_array(a, b, 4, least, same)
        got = set(zip(q.tolist(), n.tolist()))
        for i in range(len(a)):
            want = [j for j in np.argsort(-t[i], kind="stable")[:4] if t[i, j] >= least]
            assert all((i, j) in got for j in want)


def test_packing_is_lossless():
    rng = np.random.default_rng(1)
    m = np.concatenate([np.round(rng.normal(size=(5, 7)) * 1024) / 1024, rng.normal(size=(4, 7)), rng.normal(size=(2, 7)) * 1e6]).astype(np.float32)
    order, parts = v.pack(m)
    assert len(parts) == 2 and np.array_equal(v.unpack(v.binary(parts), 7), m[order])


def single_linkage(good, linked):
    first = {i: i for i in good}
    changed = True
    while changed:
        changed = False
        for a, b in map(tuple, linked):
            low = min(first[a], first[b])
            if (first[a], first[b]) != (low, low):
                first[a] = first[b] = low
                changed = True
    return first


def average_linkage(good, least):
    """Clusters by merging the pair of greatest average cosine, one at a time; copies of a vector first."""
    c = cosines(good)
    groups = [[i] for i in sorted(good)]
    while True:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                pairs = [c.get((x, y), -9) for x in groups[i] for y in groups[j]]
                v = sum(pairs) / len(pairs)
                if v >= least and (best is None or v > best[0]):
                    best = (v, i, j)
        if best is None:
            return {frozenset(g) for g in groups}
        _, i, j = best
        groups[i] += groups.pop(j)


def linked(df, least, **options):
    rows, members = p3_clusters.linked_rows(df, least, **options)
    out = {}
    for r in common.with_copies(rows, members, "rep", "id").collect():
        out.setdefault(r["first"], {})[r.id] = r.typical
    assert all(min(g) == f for f, g in out.items())
    return out


def test_clusters(spark, vectors):
    good = stored(grouped())
    want = single_linkage(good, {frozenset(p) for p, x in cosines(good).items() if x >= 0.88})
    assert {r.id: r.first_id for r in p3_clusters.cluster_members(vectors, 0.88).collect()} == want
    want = average_linkage(good, 0.88)
    assert {frozenset(g) for g in linked(vectors, 0.88).values()} == want
    out = {r.first_id: r for r in p3_clusters.clusters(vectors, 0.88).collect()}
    assert {f: r["size"] for f, r in out.items()} == {min(g): len(g) for g in want if len(g) >= 5} and len(out) > 5
    of = {i: g for g in want for i in g}
    assert all(len(r.typical_ids) == 3 and all(i in of[f] for i in r.typical_ids) for f, r in out.items())


@pytest.fixture(scope="module")
def chains(spark):
    """Two chains of vectors, each near its neighbours only, and a tight group with copies."""
    rng = np.random.default_rng(9)
    step = 0.4 * (np.arange(8) + 0.01 * rng.normal(size=8))
    rows = [record(f"a{i}", i, [np.cos(t), np.sin(t), 0, 0, 0]) for i, t in enumerate(step)]
    rows += [record(f"b{i}", 20 + i, [0, 0, np.cos(t), np.sin(t), 0.05]) for i, t in enumerate(step[:5] * 1.1)]
    rows += [record(f"c{i}", 40 + i, [0.03 * (i % 3), 0.1, -0.02 * (i % 3), 0.1, 1]) for i in range(7)]
    return rows, spark.createDataFrame(rows, VECTORS)


def test_chains_are_no_clusters(chains):
    rows, df = chains
    whole = {r.id: r.first_id for r in p3_clusters.cluster_members(df, 0.88).collect()}
    assert {whole[f"a{i}"] for i in range(8)} == {"a0"}
    want = average_linkage(stored(rows), 0.88)
    got = linked(df, 0.88)
    assert {frozenset(g) for g in got.values()} == want
    assert max(len(g) for g in want if "a0" in g or "a4" in g) < 4 and any(len(g) == 7 for g in want)


def test_large_components_take_rounds(chains):
    _, df = chains
    assert linked(df, 0.88, large=3) == linked(df, 0.88)
    assert linked(df, 0.88, smallest=8, large=3) == {f: g for f, g in linked(df, 0.88).items() if f[0] == "a"}


def test_typical_is_of_the_whole_cluster(spark, monkeypatch):
    monkeypatch.setattr(v, "BLOCK_ROWS", 20)  # a cluster of several cells
    rng = np.random.default_rng(5)
    c = rng.normal(size=16)
    rows = [record(f"r{i:03}", i, c + 0.4 * rng.normal(size=16) / 4) for i in range(150)]
    rows += [record(f"c{i:03}", 200 + i, rows[3][3]) for i in range(60)]
    good = stored(rows)
    u = {i: x.astype(float) / np.linalg.norm(x.astype(float)) for i, x in good.items()}
    mean = sum(u.values())
    want = {i: float(x @ mean / np.linalg.norm(mean)) for i, x in u.items()}
    got = linked(spark.createDataFrame(rows, VECTORS), 0.75)
    assert set(got) == {"c000"} and all(abs(t - want[i]) < 2e-6 for i, t in got["c000"].items())


def test_average_linkage():
    rng = np.random.default_rng(2)
    u = v.unit(rng.normal(size=(60, 3)).astype(np.float32)).astype(np.float64)
    a, b = p3_clusters.links(u.astype(np.float32), 0.8)
    label = p3_clusters.average_linkage(u, np.ones(60), a, b, 0.8)
    groups = [np.flatnonzero(label == x) for x in np.unique(label)]
    mean = np.array([u[g].mean(0) for g in groups])
    between = mean @ mean.T
    np.fill_diagonal(between, -1)
    assert between.max() < 0.8 + 1e-5 and 5 < len(groups) < 40
    assert all(label[g].min() == g[0] for g in groups)
    # a cluster counts as often as it has copies
    x = np.array([[1, 0], [np.cos(0.3), np.sin(0.3)], [np.cos(0.75), np.sin(0.75)]])
    ends = (np.array([0, 1]), np.array([1, 2]))
    assert len(set(p3_clusters.average_linkage(x, np.array([1, 1, 1]), *ends, 0.8))) == 1
    assert len(set(p3_clusters.average_linkage(x, np.array([9, 1, 1]), *ends, 0.8))) == 2


def multiset(x):
    return Counter((np.asarray(x, np.float32) + np.float32(0)).tolist())


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    rows = [r for r in grouped(1)]
    for n in range(8):
        base = (np.round(rng.normal(size=40) * 64) / 1024).tolist()
        rows.append(record(f"n{n}", 1000 + 20 * n, base))
        for e in range(4):
            x = list(base)
            for at in rng.choice(40, 2, replace=False):
                x[at] = float(rng.normal())
            x = (x[3:] + x[:3])[: 40 - e % 2] + [0.5] * e
            rows.append(record(f"n{n}-{e}", 1001 + 20 * n + e, x))
        rows.append(record(f"n{n}-moved", 1010 + 20 * n, base[::-1]))
    rows += [record("z1", 5000, [0.0, 1.0]), record("z2", 5001, [-0.0, 1.0]), record("z3", 5002, [1.0, 1.0, 1.0]), record("z4", 5003, [1.0, 1.0])]
    good = stored(rows)
    ids = sorted(good)
    want = {}
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = multiset(good[ids[a]]), multiset(good[ids[b]])
            s = sum((x & y).values()) / sum((x | y).values())
            if s >= 0.7:
                want[ids[a], ids[b]] = s
    df = spark.createDataFrame(rows, VECTORS)
    got = {(r.id_a, r.id_b): r.similarity for r in p5_near_duplicates.near_duplicates(df).collect()}
    assert set(got) <= set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in got)
    assert len(got) >= 0.97 * len(want) and {p for p, s in want.items() if s >= 0.9} <= set(got) and ("z1", "z2") in got
    assert {p for p, s in want.items() if s >= 0.85} <= set(got)
    groups = {r.id: r.group_id for r in p5_near_duplicates.duplicate_groups(df).collect()}
    whole = single_linkage({i: None for p in got for i in p}, {frozenset(p) for p in got})
    assert groups == whole


@pytest.mark.parametrize("keys", [400_000, 0])
def test_groups_of_edited_copies_need_few_links(spark, monkeypatch, keys):
    """A chain of drifting copies: the first under a key is not similar to all the others under it."""
    monkeypatch.setattr(common, "BROADCAST_KEYS", keys)  # beyond the bound the joins shuffle
    monkeypatch.setattr(p5_near_duplicates, "LISTED", 3)
    rng = np.random.default_rng(13)
    base, rows = rng.normal(size=60), []
    for i in range(400):
        base = base.copy()
        base[rng.integers(0, 60)] = rng.normal()
        rows.append(record(f"d{i:03}", i, base))
    df = spark.createDataFrame(rows, VECTORS)
    pairs = {(r.id_a, r.id_b) for r in p5_near_duplicates.near_duplicates(df).collect()}
    distinct, _ = p5_near_duplicates.duplicate_classes(common.stored_vectors(df))
    links = p5_near_duplicates.star_links(distinct, 400, 0.7).collect()
    assert {(r.a, r.b) for r in links} <= pairs and len(links) < len(pairs) / 2
    groups = {r.id: r.group_id for r in p5_near_duplicates.duplicate_groups(df).collect()}
    assert groups == single_linkage({i: None for p in pairs for i in p}, {frozenset(p) for p in pairs})


def test_similar_pairs_share_a_variant():
    rng = np.random.default_rng(14)
    a = rng.normal(size=(4_000, 64)).astype(np.float32)
    b = a.copy()
    b[:, :11] = rng.normal(size=(4_000, 11))  # 53 of 75 in common: 0.707
    x, y = p5_near_duplicates.signatures(a), p5_near_duplicates.signatures(b)
    met = (p5_near_duplicates.variants(x[0]) == p5_near_duplicates.variants(y[0])).any((1, 2))
    near = np.bitwise_count(x[1] ^ y[1]) <= p5_near_duplicates.SKETCH_BITS
    assert (met & near).mean() >= 0.95


@pytest.mark.parametrize("same", [True, False])
def test_signatures_follow_similarity(same):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(300, 60)).astype(np.float32)
    b = a.copy()
    b[:, :6] = rng.normal(size=(300, 6))
    if not same:
        b = rng.normal(size=(300, 60)).astype(np.float32)
    x, y = p5_near_duplicates.signatures(a), p5_near_duplicates.signatures(b[:, ::-1])
    bits = np.bitwise_count(x[1] ^ y[1])
    shared = (p5_near_duplicates.variants(x[0]) == p5_near_duplicates.variants(y[0])).any((1, 2))
    assert (shared.mean() > 0.97 and (bits <= p5_near_duplicates.SKETCH_BITS).mean() > 0.99) if same else (not shared.any() and bits.mean() > 18)


def test_empty_tables(no_vectors):
    assert p2_knn.near_pairs(no_vectors).isEmpty() and p2_knn.all_neighbours(no_vectors).isEmpty()
    assert p3_clusters.clusters(no_vectors).isEmpty() and p3_clusters.cluster_members(no_vectors, 0.88).isEmpty()
    assert p5_near_duplicates.near_duplicates(no_vectors).isEmpty() and p5_near_duplicates.duplicate_groups(no_vectors).isEmpty()


def test_nothing_usable(spark):
    df = spark.createDataFrame([record("a", 1, None), record("b", 2, []), record("c", 3, [0.0]), record("d", 4, [0.0])], VECTORS)
    assert p2_knn.near_pairs(df).isEmpty() and p3_clusters.cluster_members(df, 0.9).isEmpty() and p5_near_duplicates.near_duplicates(df).isEmpty()
