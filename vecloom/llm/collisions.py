"""Collision counting on single projections, bit-sliced.

A hash function is one projection; its sorted array answers a window ``[p - w, p + w]`` centred on a query by a run of
ranks. For every projection the runs of a grid of centres are kept as bitmaps over the rows, so that a query's window is
one row of words; the bitmaps of a query's windows are added by carry-save adders, 64 rows a word, and the rows whose
number of collisions reaches the threshold are read from the planes of the sum. Virtual rehashing widens the windows.

A pair at distance R differs by R / sqrt(d) on a projection in the quadratic mean, so windows of ``WIDTH`` times that
hold a pair at R on 87 % of the projections; ``SHARE`` of them must collide, which a pair at R misses about once in 500
times and a nearer one less. No pair differs by more than R on any projection, so windows never need to be wider.
"""

from __future__ import annotations

import numpy as np

#: Single projections, half-width of a window in mean differences, share of the projections that must collide, and
#: grid steps in a half-width.
PROBES, WIDTH, SHARE, STEPS = 32, 1.5, 0.69, 6


def projections(v: np.ndarray, most: int = PROBES) -> np.ndarray:
    """Up to ``most`` orthonormal directions (as columns) on which the rows of ``v`` differ most."""
    x = v - v.mean(0)
    _, vectors = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(vectors[:, ::-1][:, :most], np.float32)


def radius(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def threshold(probes: int) -> int:
    """Collisions that make a row a candidate."""
    return max(1, int(SHARE * probes))


class SortedArrays:
    """The sorted array of each projection of rows ``pv`` (rows x projections)."""

    def __init__(self, pv: np.ndarray):
        self.rows, self.probes = pv.shape
        self.order = np.argsort(pv, axis=0, kind="stable")
        self.sorted = np.take_along_axis(pv, self.order, 0)
        # places beyond the last row fill the last word
        self.rank = np.full((self.probes, -(-self.rows // 64) * 64), self.rows, np.int32)
        np.put_along_axis(self.rank, self.order.T, np.arange(self.rows, dtype=np.int32)[None], 1)


class Windows:
    """The windows of one radius over sorted arrays, as bitmaps."""

    def __init__(self, arrays: SortedArrays, dim: int, r: float):
        self.need, self.words = threshold(arrays.probes), arrays.rank.shape[1] // 64
        half = min(WIDTH * r / np.sqrt(dim), r) + 1e-6
        self.step = step = half / STEPS
        self.low = arrays.sorted[0] - half
        self.maps = []
        for i in range(arrays.probes):
            p, rank = arrays.sorted[:, i], arrays.rank[i]
            centres = self.low[i] + step * np.arange(int((p[-1] + half - self.low[i]) / step) + 2)
            # a query is at most half a step from its centre
            begin = np.searchsorted(p, centres - half - step / 2, "left").astype(np.int32)
            end = np.searchsorted(p, centres + half + step / 2, "right").astype(np.int32)
            inside = (rank >= begin[:, None]) & (rank < end[:, None])
            bits = np.packbits(inside, axis=1, bitorder="little").view(np.uint64)
            # centres outside the rows' range share the empty window at the end
            self.maps.append(np.concatenate([bits, np.zeros((1, self.words), np.uint64)]))

    def candidates(self, pq: np.ndarray) -> np.ndarray:
        """A word matrix (queries x words): the rows that collide with each query often enough."""
        waiting: list[list[np.ndarray]] = [[]]  # of each binary place, what is not yet added up

        def add(level: int, x: np.ndarray) -> None:
            if level == len(waiting):
                waiting.append([])
            waiting[level].append(x)
            if len(waiting[level]) == 3:
                a, b, c = waiting[level]
                half = a ^ b
                waiting[level] = [half ^ c]
                add(level + 1, (a & b) | (half & c))

        for i, maps in enumerate(self.maps):
            at = np.rint((pq[:, i] - self.low[i]) / self.step)
            at = np.where((at < 0) | (at >= len(maps) - 1), len(maps) - 1, at).astype(np.int64)
            add(0, maps[at])
        planes, level = [], 0
        while level < len(waiting):
            if len(waiting[level]) == 2:
                a, b = waiting[level]
                waiting[level] = [a ^ b]
                add(level + 1, a & b)
            planes.append(waiting[level][0])
            level += 1
        # the sum is at least the threshold: greater in its highest differing bit, or equal throughout
        more, same = np.zeros_like(planes[0]), np.full_like(planes[0], np.iinfo(np.uint64).max)
        if self.need >> len(planes):
            return more
        for level in range(len(planes) - 1, -1, -1):
            if self.need >> level & 1:
                same &= planes[level]
            else:
                more |= same & planes[level]
                same &= ~planes[level]
        return more | same


def members(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the bits that are set, by query."""
    at = np.flatnonzero(words)
    bits = np.flatnonzero(np.unpackbits(words.ravel()[at].view(np.uint8), bitorder="little"))
    at, bit = at[bits >> 6], bits & 63
    return at // words.shape[1], (at % words.shape[1]) * 64 + bit


def dense(words: np.ndarray, rows: int) -> np.ndarray:
    """The word matrix as booleans (queries x rows)."""
    return np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")[:, :rows].view(bool)
