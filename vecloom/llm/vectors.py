"""Vector cells: every vector joins the few single projections on which it lies furthest out.

The projection directions are centroids of a mini-batch k-means over a bounded sample (``SAMPLE_ROWS``); every row
is then hashed with them. A row *hits* the direction of its largest projection and, as the query-centred window is
expanded, every direction whose projection is at most ``margin`` below it. Vectors that hit a common direction collide.
Directions that mostly the same rows hit (a large group of similar rows gets many) are *bundled* and count as one. One
bundle's sorted array is a *cell*; cells expected to be too large for a task are split into block pairs, so all pairs
are still met and no task holds more than about two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the sample the directions are fitted on: ``PER_DIRECTION`` for each direction, at least and at most these.
SAMPLE_ROWS, SAMPLE_MOST, PER_DIRECTION = 40_000, 160_000, 16
#: Rows aimed at per direction. Directions grow with the rows as long as the sample does (to ten million rows); beyond,
#: cells grow and are met block by block.
CELL_ROWS = 1_000
#: Rows of the sample that show which directions are hit together, and the hits a direction needs for that.
BUNDLE_ROWS, BUNDLE_HITS = 8_192, 8
#: Cells expected to exceed this are met block by block.
BLOCK_ROWS = 8_192
#: How far below a row's largest projection its window opens, and the share of common rows that bundles two directions.
MARGIN, COMMON = 0.06, 0.5
#: Fixed-point exponent of the packed form; vectors that it does not hold exactly stay float32.
FIXED_POINT = 8_192.0


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of a list column without nulls in its rows (null components become NaN)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, row numbers, matrix) for each vector size of a batch; unusable vectors (NaN, infinite, all zero) left out."""
    values, start = flat(column)
    sizes = np.diff(start)
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        m = values[start[rows][:, None] + np.arange(d)]
        good = np.isfinite(m).all(1) & m.any(1)
        if good.any():
            yield int(d), rows[good], m[good]


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1, float32, computed in double precision."""
    w = m.astype(np.float64)
    return (w / np.sqrt((w * w).sum(1))[:, None]).astype(np.float32)


def binary(rows: list[np.ndarray]) -> pa.Array:
    """A binary column from 2-d arrays whose rows become its values."""
    lengths = np.concatenate([np.full(len(r), r.shape[1] * r.itemsize, np.int64) for r in rows])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    data = np.concatenate([np.ascontiguousarray(r).view(np.uint8).ravel() for r in rows])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def pack(m: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row order, arrays for :func:`binary`): lossless, as int16 where every component is a fixed-point number."""
    scaled = m * np.float32(FIXED_POINT)
    exact = ((scaled == np.rint(scaled)) & (np.abs(scaled) < 32767)).all(1)
    a, b = np.flatnonzero(exact), np.flatnonzero(~exact)
    return np.concatenate([a, b]), [x for x in (scaled[a].astype("<i2"), m[b].astype("<f4")) if len(x)]


def unpack(column: pa.Array, d: int) -> np.ndarray:
    """The float32 matrix of packed vectors that all have size ``d``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    start = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    out = np.empty((len(column), d), np.float32)
    lengths = np.diff(start)
    for width, kind, factor in ((2 * d, "<i2", 1 / FIXED_POINT), (4 * d, "<f4", 1.0)):
        rows = np.flatnonzero(lengths == width)
        if len(rows):
            raw = data[start[rows][:, None] + np.arange(width)]
            out[rows] = np.ascontiguousarray(raw).view(kind).astype(np.float32) * np.float32(factor)
    return out


def minibatch_kmeans(m: np.ndarray, k: int, seed: int = 7, rounds: int = 24, batch: int = 8_192, start: np.ndarray | None = None) -> np.ndarray:
    """Spherical mini-batch k-means: unit centroids, the learning rate of each falling with the rows it has seen.

    It starts from random rows, so that dense regions get many centroids, or from ``start``.
    """
    rng = np.random.default_rng(seed)
    c = (m[rng.choice(len(m), k, replace=False)] if start is None else start).astype(np.float32).copy()
    k = len(c)
    seen = np.zeros(k)
    for _ in range(rounds):
        b = m[rng.choice(len(m), min(batch, len(m)), replace=False)]
        at = (b @ c.T).argmax(1)
        order = np.argsort(at, kind="stable")
        hit, first, n = np.unique(at[order], return_index=True, return_counts=True)
        seen[hit] = 0.5 * seen[hit] + n
        mean = np.add.reduceat(b[order], first, axis=0) / n[:, None]
        rate = (n / seen[hit])[:, None]
        c[hit] = (1 - rate) * c[hit] + rate * mean
        norm = np.linalg.norm(c, axis=1)
        c[norm > 0] /= norm[norm > 0][:, None]
    return c.astype(np.float32)


@dataclass
class Directions:
    """Fitted projection directions of each vector size, in the order of their bundles; the first direction of each
    bundle and the number of blocks of its cell; ``copies``, the cells that a row enters on average."""

    centroids: dict[int, np.ndarray] = field(default_factory=dict)
    starts: dict[int, np.ndarray] = field(default_factory=dict)
    blocks: dict[int, np.ndarray] = field(default_factory=dict)
    rows: int = 0
    copies: float = 1.0
    margin: float = MARGIN


def fit_directions(records: DataFrame, rows: int, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS, seed: int = 7, margin: float = MARGIN) -> Directions:
    """Fit on at most about ``sample_rows`` records, chosen by a hash of the id; ``rows`` is the number of all records."""
    wanted = min(SAMPLE_MOST, max(sample_rows, PER_DIRECTION * rows // cell_rows))
    share = min(1.0, wanted / max(rows, 1))
    pick = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1_000_000)) < math.ceil(share * 1_000_000)
    sample = records.where(pick).select("vector").toArrow().column("vector") if rows else None
    out = Directions(rows=rows, margin=margin)
    if sample is None or len(sample) == 0:
        return out
    total, copies = len(sample), 0
    for d, _, m in by_size(sample):
        expected = rows * len(m) / total
        k = int(min(max(1, round(expected / cell_rows)), max(1, len(m) // PER_DIRECTION)))
        u = unit(m)
        c = minibatch_kmeans(u, k, seed) if k > 1 else unit(u.sum(0, keepdims=True) + np.float32(1e-6))
        c, starts = bundled(u, c, margin, seed)
        _, bundle, _ = hits(u, c, starts, margin)
        entered = np.bincount(bundle, minlength=len(starts))
        blocks = np.maximum(1, np.ceil(entered * rows / total / BLOCK_ROWS - 1)).astype(np.int64)
        out.centroids[d], out.starts[d], out.blocks[d] = c, starts, blocks
        copies += (entered * blocks).sum()
    out.copies = max(1.0, copies / total)
    return out


def _chunk(columns: int) -> int:
    return max(64, 2_000_000 // max(columns, 1))


def bundled(u: np.ndarray, c: np.ndarray, margin: float = MARGIN, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The directions in the order of their bundles, and the first of each bundle. Two directions are bundled, also by
    way of others, if at least the share ``COMMON`` of the rows of ``u`` that hit either hit both."""
    if len(u) > BUNDLE_ROWS:
        u = u[np.random.default_rng(seed).choice(len(u), BUNDLE_ROWS, replace=False)]
    near = np.concatenate([(p >= p.max(1, keepdims=True) - margin) for p in (u[s : s + _chunk(len(c))] @ c.T for s in range(0, len(u), _chunk(len(c))))])
    often = np.flatnonzero(near.sum(0) >= BUNDLE_HITS)
    near = near[:, often].astype(np.float32)
    both = near.T @ near
    n = np.diag(both)
    a, b = np.nonzero((both >= COMMON * np.maximum(n[:, None] + n[None, :] - both, 1)) & (both >= BUNDLE_HITS))
    a, b = often[a], often[b]
    root = np.arange(len(c))
    while True:
        new = root.copy()
        np.minimum.at(new, root[a], root[b])
        new = new[new]
        if (new == root).all():
            break
        root = new
    order = np.argsort(root, kind="stable")
    return c[order], np.unique(root[order], return_index=True)[1]


def hits(u: np.ndarray, c: np.ndarray, starts: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bundle, is the row's first): all bundles with a direction within ``margin`` of each row's largest projection."""
    rows, bundles, first = [], [], []
    alone = len(starts) == len(c)
    for s in range(0, len(u), _chunk(len(c))):
        p = u[s : s + _chunk(len(c))] @ c.T
        p = p if alone else np.maximum.reduceat(p, starts, axis=1)
        best = p.argmax(1)
        at = np.flatnonzero(p >= p[np.arange(len(p)), best][:, None] - np.float32(margin))
        row, bundle = at // p.shape[1], at % p.shape[1]
        rows.append(s + row)
        bundles.append(bundle)
        first.append(bundle == best[row])
    return np.concatenate(rows), np.concatenate(bundles), np.concatenate(first)


def cell_code(d: int, direction: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key for size, direction and block pair (14 bits a block, 20 bits a direction)."""
    return ((np.int64(d) << 48) | (direction.astype(np.int64) << 28)) + (a << 14) + b


def cell_size(code: int) -> int:
    return int(code) >> 48


def to_cells(fit: Directions, key: str):
    """A mapInArrow function from (key, vector) to (cell, home, own, side, key, packed): a row for each cell it belongs to.

    ``own`` marks the rows in the cell of their largest projection, the others are visitors; ``home`` marks one row of
    each record. ``side`` is 0 or 1, the block of a block pair the row is in (0 in a whole cell and in a pair of a block
    with itself).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, m in by_size(batch.column("vector")):
                u = unit(m)
                c = fit.centroids.get(d)
                if c is None:
                    at, direction, first = np.arange(len(u)), np.zeros(len(u), np.int64), np.ones(len(u), bool)
                    blocks = np.ones(1, np.int64)
                else:
                    at, direction, first = hits(u, c, fit.starts[d], fit.margin)
                    blocks = fit.blocks[d]
                direction = direction.astype(np.int64)
                nb = blocks[direction]
                # the block follows the vector, so that equal rows of a cell stay together whatever their order
                mix = (np.abs(m).astype(np.float64) @ np.sqrt(np.arange(1, d + 1) + 0.5) * 7919).astype(np.int64)[at]
                place = mix % nb
                rep = np.repeat(np.arange(len(at)), nb)
                other = np.arange(len(rep)) - np.repeat(np.cumsum(nb) - nb, nb)
                mine = place[rep]
                lo, hi = np.minimum(mine, other), np.maximum(mine, other)
                code = cell_code(d, direction[rep], lo, hi)
                side = (mine == hi) & (lo != hi)
                own = first[rep]
                home = own & (mine == other)
                order, parts = pack(m)
                inverse = np.empty(len(order), np.int64)
                inverse[order] = np.arange(len(order))
                packed = binary(parts).take(pa.array(inverse)).take(pa.array(at[rep]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code), pa.array(home), pa.array(own), pa.array(side), batch.column(key).take(pa.array(rows[at[rep]])), packed],
                    names=["cell", "home", "own", "side", key, "packed"],
                )

    return run


def grouped(batches: Iterator[pa.RecordBatch], column: str = "cell") -> Iterator[tuple[int, pa.Table]]:
    """The rows of a task by cell. A task holds a bounded number of cells of bounded size (see ``partitions``)."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    del batches
    code = table.column(column).to_numpy()
    order = np.argsort(code, kind="stable")
    codes, first = np.unique(code[order], return_index=True)
    for c, idx in zip(codes, np.split(order, first[1:])):
        yield int(c), table.take(pa.array(idx))
