import numpy as np
import pytest

VECTORS = "partition_id string, id string, seq bigint, vector array<float>, metadata string, h bigint, n__ int, cell string, rep string"


def record(id, seq, vector, metadata=None, partition="p"):
    """A row of a vectors table with extra columns whose names clash with the operators' own."""
    return (partition, id, seq, None if vector is None else [None if x is None else float(x) for x in vector], metadata, 7, 1, "x", "y")


def grouped(seed=0, groups=12, size=9, dim=24, spread=0.25):
    """Rows in tight groups, some alone, with writes, copies and vectors of no use among them."""
    rng = np.random.default_rng(seed)
    rows, seq = [], 0
    for g in range(groups):
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        for i in range(size if g % 4 else 3):
            v = c + spread * rng.normal(size=dim) / np.sqrt(dim)
            rows.append(record(f"g{g}-{i}", seq, v * rng.choice([0.25, 1.0, 12.0])))
            seq += 1
    for i in range(10):
        rows.append(record(f"s{i}", seq + i, rng.normal(size=dim)))
    seq += 10
    rows += [record("bad-null", seq, None), record("bad-empty", seq + 1, []), record("bad-zero", seq + 2, [0.0] * dim), record("bad-nan", seq + 3, [float("nan")] + [1.0] * (dim - 1)), record("bad-hole", seq + 4, [None] + [1.0] * (dim - 1)), record(None, seq + 5, [1.0] * dim)]
    rows += [record("copy-b", seq + 6, rows[5][3]), record("copy-a", seq + 7, rows[5][3]), record("short", seq + 8, [1.0, 2.0]), record("short2", seq + 9, [1.0, 2.1])]
    rows += [record("g1-0", -5, rng.normal(size=dim)), record("g2-1", seq + 10, None), rows[7], rows[8]]  # written before, written away, delivered twice
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(grouped(), VECTORS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_vectors(spark):
    return spark.createDataFrame([], VECTORS)


def stored(rows):
    last = {}
    for r in rows:
        if r[1] is not None and (r[1] not in last or r[2] >= last[r[1]][2]):
            last[r[1]] = r
    good = {}
    for i, r in last.items():
        v = r[3]
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32)
    return good


def cosines(good):
    out = {}
    ids = sorted(good)
    for i in ids:
        for j in ids:
            if i != j and len(good[i]) == len(good[j]):
                a, b = good[i].astype(float), good[j].astype(float)
                out[i, j] = round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6)
    return out
