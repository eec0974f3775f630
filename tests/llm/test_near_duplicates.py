"""What near duplicates exchange and look at as the table grows."""

import numpy as np
import pytest

from vecloom.llm import common, p5_near_duplicates

from .conftest import VECTORS, record
from .test_vectors import multiset


def coarse(n, seed=21, levels=48):
    """Unrelated records of coarse components, and an edited copy of every fiftieth."""
    rng = np.random.default_rng(seed)
    m = np.round(rng.normal(size=(n, 64)) * levels) / 1024
    rows = [record(f"u{i:05}", i, v) for i, v in enumerate(m)]
    for i in range(0, n, 50):
        v = m[i].copy()
        v[rng.choice(64, 4, replace=False)] = rng.normal(size=4)
        rows.append(record(f"e{i:05}", n + i, v))
    return rows


def test_unrelated_records_leave_no_candidates(spark, monkeypatch):
    """Unrelated records meet under shared variants, more often with the square of the rows; none may be exchanged."""
    seen, verified = [], p5_near_duplicates.verified_pairs
    monkeypatch.setattr(p5_near_duplicates, "verified_pairs", lambda records, candidates, least: seen.append(candidates.count()) or verified(records, candidates, least))
    df = spark.createDataFrame(coarse(4_000), VECTORS).repartition(4)
    got = {(r.id_a, r.id_b) for r in p5_near_duplicates.near_duplicates(df).collect()}
    assert got == {(f"e{i:05}", f"u{i:05}") for i in range(0, 4_000, 50)}
    groups = {r.id: r.group_id for r in p5_near_duplicates.duplicate_groups(df).collect()}
    assert groups == {i: min(p) for p in got for i in p}
    assert all(n < 2 * len(got) for n in seen)


@pytest.mark.parametrize("keys", [2_000_000, 0])
def test_ids_written_again_and_copies_beyond_the_bounds(spark, monkeypatch, keys):
    """The latest write counts and copies are put back, whether their keys are broadcast or shuffled."""
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(p5_near_duplicates, "OPEN_KEYS", keys)
    rows = coarse(300)
    rows += [record("u00000", 5_000, rows[1][3]), record("u00050", 5_001, None), record("u00100", -1, rows[2][3]), rows[3], record("copy", 5_002, rows[150][3][::-1])]
    last = {r[1]: r[3] for r in sorted(rows, key=lambda r: r[2]) if r[1]}
    good = {i: multiset(v) for i, v in last.items() if v}
    want = {(a, b) for a in good for b in good if a < b and sum((good[a] & good[b]).values()) >= 0.7 * sum((good[a] | good[b]).values())}
    got = {(r.id_a, r.id_b) for r in p5_near_duplicates.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == want and ("u00000", "u00001") in got and ("copy", "u00150") in got and ("copy", "e00150") in got


def test_large_keys_are_met_in_blocks():
    """Blocks give the pairs that every pair of entries gives, whatever the size of the key."""
    rng = np.random.default_rng(22)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    for n in (2, 3, 9, 65, 700):
        flips = np.uint64(1) << rng.integers(0, 63, (n, 6), dtype=np.uint64)
        low, high = np.bitwise_xor.reduce(flips, 1) ^ base[rng.integers(0, 3, n)], base[rng.integers(3, 6, n)]
        entry = {"key": np.full(n, 5, np.uint32), "bits": np.full((n, 3), 7, np.uint16), "uid": np.arange(n, dtype=np.uint32), "low": low, "high": high, "label": np.zeros(n, np.uint32)}
        met = p5_near_duplicates.Met(0, 1, 1, entry)
        pairs = {tuple(sorted(p)) for run in met.large(1) for x, y in met.blocks(run) for p in zip(met.uid[x].tolist(), met.uid[y].tolist())}
        stepped = {tuple(sorted(p)) for x, y in met.small(n) for p in zip(met.uid[x].tolist(), met.uid[y].tolist())}
        first = low[:, None] ^ low
        near = (np.bitwise_count(first) <= p5_near_duplicates.SKETCH_BITS) & (np.bitwise_count(first | (high[:, None] ^ high)) <= p5_near_duplicates.MISMATCHES)
        assert pairs == stepped == {(a, b) for a in range(n) for b in range(a + 1, n) if near[a, b]}
