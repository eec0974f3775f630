"""Near-duplicate vectors by their components: deletion-variant signatures.

A record's components form a multiset; the n-th copy of a value is its own element, so multiset similarity becomes set
similarity. A signature has ``SEGMENTS * WIDTH`` symbols (minimum hashes of the elements); two records of similarity s
agree on each with probability s. A segment of six symbols differs in at most one with probability s^6 + 6 s^5 (1 - s),
0.42 at 0.7, so all six segments differ in more in one pair of 26 at 0.7 itself, one of 97 at 0.75, one of 660 at 0.8.
Each segment is indexed under its ``WIDTH`` variants with one symbol deleted. Variants are joined on equality, thinned by
two bits of each of 64 further hashes in the same task, and every remaining pair is verified on its exact multisets.
(Shorter segments would miss less, but unrelated records of coarse components have 0.06 to 0.14 in common and would meet
by the million.)

A variant holds one half of its segment whole, so a row is sent once under each of the two halves, with 16 bits for each
variant that the half is part of: twelve entries a row instead of 36. Unrelated records that share a variant grow with the
square of the rows. They are looked at where they meet, block by block, and leave no trace: only pairs near by all 128
bits leave the task, one unrelated pair in some ten thousand.

Groups need no pairs: under a key with many near pairs every entry that has one is linked to one representative. Only keys
whose entries are not all of one group after that are looked at again, and there only entries of different groups are
paired.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage as cut
from ..session import written
from .common import checked_broadcast, partitions, repeated_keys, spread_pairs
from .vectors import binary, by_size, pack, unpack

SEGMENTS, WIDTH, SKETCH = 6, 6, 64
HALF = WIDTH // 2
#: A candidate may differ in the first bit of so many of the sketch's hashes, and in either of two bits of so many; at
#: similarity 0.7 it is 9.6 and 14.4 on average, and 1.6 pairs of 1,000 differ in more.
SKETCH_BITS, MISMATCHES = 19, 25
#: Near pairs of an entry, on average, beyond which a key's entries are linked to a representative for groups.
LISTED = 128
#: Entries of a key up to which they are compared at each distance, all keys at once; larger keys are met in blocks of
#: so many pairs.
STEPPED, BLOCK = 64, 1 << 17
#: Keys that are looked at again, and keys of 64 bits that are written or met more than once, may be sent to every task up
#: to this number.
OPEN_KEYS = 2_000_000
#: Bytes of an index entry, entries of a task, and pair ends (four numbers each) that may be broadcast.
ENTRY, ENTRIES_PER_TASK, BROADCAST_ENDS = 30, 1_000_000, 1_000_000
#: Rows from which shuffle files of finished steps are deleted before the next step writes its own.
RELEASED_ROWS = 1_000_000
#: Entries of a row: each half of each segment.
ROUTES = 2 * SEGMENTS
_RNG = np.random.default_rng(20)
#: The hashes of the symbols and of the first 40 of the sketch are drawn first, so that the same pairs share variants.
_DRAWN = [_RNG.integers(1, 2**32, n, dtype=np.uint64).astype(np.uint32) for n in (SEGMENTS * WIDTH + 40,) * 2 + (SKETCH - 40,) * 2]
_A, _B = np.concatenate(_DRAWN[::2]) | np.uint32(1), np.concatenate(_DRAWN[1::2])


def mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def elements(m: np.ndarray) -> np.ndarray:
    """Exact elements of the rows' multisets, sorted: the bits of a value and how many equal ones came before it."""
    s = np.sort(m + np.float32(0), axis=1)
    occurrence = np.zeros(s.shape, np.uint64)
    for j in range(1, s.shape[1]):
        occurrence[:, j] = np.where(s[:, j] == s[:, j - 1], occurrence[:, j - 1] + np.uint64(1), 0)
    return (np.ascontiguousarray(s, np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | occurrence


def planes(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of shape rows x SEGMENTS * WIDTH, two sketches: the first and the second bit of each further hash)."""
    e = mix64(elements(m)).astype(np.uint32)
    n = SEGMENTS * WIDTH
    symbols = np.empty((len(m), n), np.uint32)
    low, high = np.zeros(len(m), np.uint64), np.zeros(len(m), np.uint64)
    for i in range(len(_A)):
        h = e * _A[i]
        h += _B[i]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x846CA68B)
        least = h.min(1)
        if i < n:
            symbols[:, i] = least
        else:
            bits = ((least * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint64)
            low |= (bits >> np.uint64(1)) << np.uint64(i - n)
            high |= (bits & np.uint64(1)) << np.uint64(i - n)
    return symbols, low, high


def signatures(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, first sketch) of :func:`planes`."""
    return planes(m)[:2]


def variants(symbols: np.ndarray) -> np.ndarray:
    """Keys of shape rows x SEGMENTS x WIDTH: each segment with each one of its symbols left out."""
    at = np.arange(symbols.shape[1], dtype=np.uint64)
    each = mix64(symbols.astype(np.uint64) | ((at + np.uint64(1)) << np.uint64(32))).reshape(len(symbols), SEGMENTS, WIDTH)
    return mix64(each.sum(2, keepdims=True) - each + at.reshape(SEGMENTS, WIDTH))


def routes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of shape rows x ROUTES, bits of shape rows x ROUTES x HALF): each half of each segment, and 16 bits of each
    variant that it is whole in. Two rows share a variant if and only if they share a half's key and one of its bits (but
    for chance)."""
    at = np.arange(symbols.shape[1], dtype=np.uint64)
    each = mix64(symbols.astype(np.uint64) | ((at + np.uint64(1)) << np.uint64(32))).reshape(len(symbols), SEGMENTS, 2, HALF)
    bits = variants(symbols).reshape(len(symbols), SEGMENTS, 2, HALF)[:, :, ::-1]
    return mix64(each.sum(3)).reshape(len(symbols), ROUTES), (bits >> np.uint64(48)).astype(np.uint16).reshape(len(symbols), ROUTES, HALF)


def _variant(short: np.ndarray, j: int, bits: np.ndarray) -> np.ndarray:
    """One key for a half's shortened key, the place of the deleted symbol and the variant's bits."""
    return mix64(((short.astype(np.uint64) * np.uint64(HALF) + np.uint64(j)) << np.uint64(16)) | bits.astype(np.uint64))


def to_variants(parts: int, only: np.ndarray | None = None):
    """A mapInArrow function from (uid, d, v[, label]) to (part, entries): the routes of a batch, one blob a part.

    An entry is 30 bytes: 32 bits of the half's key (the rest chose the part), 32 of the uid, two sketches and the bits of
    three variants; with a label it has 4 more. Blobs instead of rows keep the exchange at the size of the entries and out
    of the row format. ``only``, a sorted array, limits the entries to those with one of these variants.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            label = batch.column("label").to_numpy() if "label" in batch.schema.names else None
            width = ENTRY if label is None else ENTRY + 4
            for rows, m in sized(batch):
                done = [planes(m[s : s + 4_096]) for s in range(0, len(rows), 4_096)]
                low, high = (np.concatenate([x[i] for x in done]) for i in (1, 2))
                keys, bits = (np.concatenate(x) for x in zip(*(routes(x[0]) for x in done)))
                row, keys, bits = np.repeat(np.arange(len(rows)), ROUTES), keys.ravel(), bits.reshape(-1, HALF)
                short, part = keys // np.uint64(parts) & np.uint64(2**32 - 1), (keys % np.uint64(parts)).astype(np.int64)
                if only is not None and len(only):
                    known = np.zeros(len(keys), bool)
                    for j in range(HALF):
                        key = _variant(short * np.uint64(parts) + part.astype(np.uint64), j, bits[:, j])
                        known |= only[np.minimum(np.searchsorted(only, key), len(only) - 1)] == key
                    row, short, part, bits = row[known], short[known], part[known], bits[known]
                if not len(row):
                    continue
                entry = np.empty((len(row), width), np.uint8)
                order = np.argsort(part, kind="stable")
                row = row[order]
                fields = [short[order].astype(np.uint32), uid[rows].astype(np.uint32)[row], low[row], high[row], bits[order]]
                fields += [] if label is None else [label[rows].astype(np.uint32)[row]]
                at = 0
                for x in fields:
                    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(row), -1)
                    entry[:, at : at + raw.shape[1]] = raw
                    at += raw.shape[1]
                held, first = np.unique(part[order], return_index=True)
                offsets = np.append(first, len(entry)).astype(np.int32) * width
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(offsets), pa.py_buffer(entry)])], names=["part", "entries"])

    return run


class Met:
    """Entries of one part that share a variant with others, in the order of their variants: uids, sketches and labels;
    ``first`` and ``size`` of each variant's run of entries, and its key (``variant``)."""

    def __init__(self, part: int, parts: int, j: int, entry: dict[str, np.ndarray]):
        key = (entry["key"].astype(np.uint64) << np.uint64(16)) | entry["bits"][:, j]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        kept = np.repeat(size > 1, size)
        order, key, self.size = order[kept], key[kept], size[size > 1]
        self.first = np.cumsum(self.size) - self.size
        self.uid, self.low, self.high, self.label = (entry[c][order] for c in ("uid", "low", "high", "label"))
        self.variant = _variant((key[self.first] >> np.uint64(16)) * np.uint64(parts) + np.uint64(part), j, key[self.first] & np.uint64(2**16 - 1))

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of the places ``x`` are near the places ``y`` by both sketches."""
        first = self.low[x] ^ self.low[y]
        return (np.bitwise_count(first) <= SKETCH_BITS) & (np.bitwise_count(first | (self.high[x] ^ self.high[y])) <= MISMATCHES)

    def small(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Near pairs (x, y) of places under the variants of up to ``most`` entries."""
        end = np.repeat(self.first + self.size, self.size)
        live, step = np.flatnonzero(np.repeat(self.size <= most, self.size)), 1
        while len(live):
            live = live[live + step < end[live]]
            for s in range(0, len(live), 1 << 20):
                x = live[s : s + (1 << 20)]
                x = x[self.near(x, x + step)]
                yield x, x + step
            step += 1

    def blocks(self, run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Near pairs (x, y) of places, x < y, under one variant, a block of entries with all later ones at a time."""
        s, e = self.first[run], self.first[run] + self.size[run]
        while s < e - 1:
            n = min(max(8, (e - s) // 4), max(1, BLOCK // (e - s)), e - 1 - s)
            columns = e - s - 1
            at = np.flatnonzero(np.bitwise_count(self.low[s : s + n, None] ^ self.low[None, s + 1 : e]) <= SKETCH_BITS)
            x, y = s + at // columns, s + 1 + at % columns
            above = y > x
            x, y = x[above], y[above]
            ok = self.near(x, y)
            yield x[ok], y[ok]
            s += n

    def large(self, most: int) -> np.ndarray:
        return np.flatnonzero(self.size > most)


def buckets(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[Met]:
    """The entries of a task's parts as they meet under variants."""
    blobs: dict[int, list[bytes]] = {}
    for batch in batches:
        for part, entries in zip(batch.column("part").to_pylist(), batch.column("entries").to_pylist()):
            blobs.setdefault(part, []).append(entries)
    kind = np.dtype([("key", "<u4"), ("uid", "<u4"), ("low", "<u8"), ("high", "<u8"), ("bits", "<u2", (HALF,)), *([("label", "<u4")] if width > ENTRY else [])])
    for part in list(blobs):
        raw = np.frombuffer(b"".join(blobs.pop(part)), kind)
        entry = {c: np.ascontiguousarray(raw[c]) for c in kind.names}
        entry.setdefault("label", entry["uid"])
        del raw
        for j in range(HALF):
            yield Met(part, parts, j, entry)


def colliding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, entries) to (a, b), a <= b: near uids under equal variants. All pairs of a variant are looked at."""
    waiting, n = [], 0
    for met in buckets(batches, ENTRY, 1):
        for pairs in (met.small(STEPPED), *(met.blocks(run) for run in met.large(STEPPED))):
            for x, y in pairs:
                if len(x):
                    waiting.append(_ends(met.uid[x], met.uid[y]))
                    n += len(x)
                if n > 1 << 21:
                    yield _pairs(np.unique(np.concatenate(waiting)))
                    waiting, n = [], 0
    if n:
        yield _pairs(np.unique(np.concatenate(waiting)))


def starred(parts: int):
    """A mapInArrow function from (part, entries) to (key, a, b, n, near). Near pairs are given with key 0 and n = 2. Where
    the entries under a variant have more than ``LISTED`` near ones on average, each of these entries is given with the
    first of them instead, whether the two are near, the variant's key and n = 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, n = [], 0
        for met in buckets(batches, ENTRY, parts):
            few = min(STEPPED, LISTED)
            for x, y in met.small(few):
                listed.append(_ends(met.uid[x], met.uid[y]))
                n += len(x)
            for i in met.large(few):
                s, size = met.first[i], met.size[i]
                pairs, many, paired = [], 0, np.zeros(size, bool)
                for x, y in met.blocks(i):
                    paired[x - s] = paired[y - s] = True
                    many += len(x)
                    if 2 * many <= LISTED * size:
                        pairs.append(_ends(met.uid[x], met.uid[y]))
                at = s + np.flatnonzero(paired)
                if 2 * many <= LISTED * len(at):
                    listed += pairs
                    n += many
                    continue
                centre = at[met.uid[at].argmin()]
                at = at[at != centre]
                c = np.full(len(at), centre)
                yield _stars(np.full(len(at), met.variant[i]).view(np.int64), met.uid[c], met.uid[at], np.full(len(at), 3), met.near(c, at))
            if n > 1 << 21:
                yield _listed(listed)
                listed, n = [], 0
        if n:
            yield _listed(listed)

    return run


def _listed(pairs: list[np.ndarray]) -> pa.RecordBatch:
    p = np.unique(np.concatenate(pairs))
    return _stars(np.zeros(len(p), np.int64), p >> np.uint64(32), p & np.uint64(0xFFFFFFFF), np.full(len(p), 2), np.ones(len(p), bool))


def _stars(key: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(near)], names=["key", "a", "b", "n", "near"])


def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, labelled entries) to (a, b): uids under equal variants with different labels and near sketches.

    Under each variant only the entries outside its most frequent label are paired, each with all entries of other labels.
    """
    for met in buckets(batches, ENTRY + 4, 1):
        waiting = []
        for s, e in zip(met.first, met.first + met.size):
            names, n = np.unique(met.label[s:e], return_counts=True)
            if len(names) < 2:
                continue
            for i in s + np.flatnonzero(met.label[s:e] != names[n.argmax()]):
                other = s + np.flatnonzero(met.label[s:e] != met.label[i])
                other = other[met.near(other, np.full(len(other), i))]
                if len(other):
                    waiting.append(_ends(met.uid[other], np.full(len(other), met.uid[i])))
        if waiting:
            yield _pairs(np.unique(np.concatenate(waiting)))


def _ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    return (np.minimum(a, b) << np.uint64(32)) | np.maximum(a, b)


def _pairs(p: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(32)).astype(np.int64)), pa.array((p & np.uint64(0xFFFFFFFF)).astype(np.int64))], names=["a", "b"])


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[i], ..., start[i] + size[i] - 1 of every i, in one array."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def verified(least: float):
    """A mapInArrow function from (a, b, side, id, d, v) to (id_a, id_b, similarity): pairs of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        a, b, side = (table.column(c).to_numpy() for c in ("a", "b", "side"))
        flat, start, size, n = [], np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), 0
        for rows, m in sized(table):
            d = m.shape[1]
            flat.append(elements(m).ravel())
            start[rows], size[rows] = n + d * np.arange(len(rows)), d
            n += len(rows) * d
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
        good = np.flatnonzero(size > 0)
        order = good[np.lexsort((side[good], b[good], a[good]))]
        if not len(order):
            return
        new = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])
        first = np.flatnonzero(new)
        right = np.add.reduceat(side[order].astype(np.int64), first)
        left = np.diff(np.append(first, len(order))) - right
        # a uid can stand for several ids: every combination of the two sides is verified
        i = np.repeat(_ragged(first, left), np.repeat(right, left))
        j = _ragged(np.repeat(first + left, left), np.repeat(right, left))
        i, j = order[i], order[j]
        ids = table.column("id").combine_chunks()
        for s in range(0, len(i), 20_000):
            x, y = i[s : s + 20_000], j[s : s + 20_000]
            both = np.stack([x, y], axis=1).ravel()
            owner = np.repeat(np.repeat(np.arange(len(x)), 2), size[both])
            value = flat[_ragged(start[both], size[both])]
            o = np.lexsort((value, owner))
            owner, value = owner[o], value[o]
            common = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (value[1:] == value[:-1])], minlength=len(x))
            similarity = common / (size[x] + size[y] - common)
            ok = similarity >= least - 1e-12
            p, q = ids.take(pa.array(x[ok])), ids.take(pa.array(y[ok]))
            low = pc.less(p, q)
            out = pa.RecordBatch.from_arrays([pc.if_else(low, p, q), pc.if_else(low, q, p), pa.array(similarity[ok])], names=["id_a", "id_b", "similarity"])
            yield out.filter(pc.not_equal(p, q))

    return run


def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) to (id, h, d, v) of the usable vectors: a digest of the multiset, whatever the order of the components,
    their number, and the sorted components, packed."""
    for batch in batches:
        for d, rows, m in by_size(batch.column("vector")):
            h = mix64(mix64(elements(m)).sum(1) + np.uint64(d))
            order, packed = pack(np.sort(m + np.float32(0), axis=1))
            columns = [batch.column("id").take(pa.array(rows[order])), pa.array(h[order].view(np.int64)), pa.array(np.full(len(rows), d, np.int32)), binary(packed)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "d", "v"])


def sized(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of sorted components) for each vector size of packed rows (d, v)."""
    d = rows.column("d").to_numpy()
    for size in np.unique(d):
        at = np.flatnonzero(d == size)
        yield at, unpack(rows.column("v").take(pa.array(at)), int(size))


def released(spark: SparkSession, rows: int) -> None:
    """Let Spark delete the shuffle files of the steps that are over: they go with the driver's garbage only, which may
    not be collected for minutes. What holds them is let go a moment after the step, hence the pauses. Small tables need
    no such care."""
    for _ in range(2 if rows >= RELEASED_ROWS else 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1.5)


def current_vectors(vectors: DataFrame) -> DataFrame:
    """The rows of :func:`common.stored_vectors`. Ids written again are known by 64 bits, of which a broadcast holds more
    than of ids: the vectors of the others are not shuffled. (Ids that only share those bits are told apart by the ids.)"""
    v = F.col("vector").cast("array<float>").alias("vector")
    rows = vectors.where("id IS NOT NULL").select(F.xxhash64("id").alias("k"), "id", F.coalesce("seq", F.lit(-(2**63))).alias("seq"), v)
    keys, n = repeated_keys(rows.select("k"), "k")
    if n == 0:
        return rows.select("id", "vector").where(F.size("vector") > 0)
    side = checked_broadcast(keys, n, OPEN_KEYS)
    order = F.struct("seq", F.xxhash64("vector").alias("h"))
    again = rows.join(side, "k", "left_semi").groupBy("id").agg(F.max_by("vector", order).alias("vector"))
    return rows.join(side, "k", "left_anti").select("id", "vector").unionByName(again).where(F.size("vector") > 0)


def duplicate_classes(records: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(id, h, d, v) of one record for each multiset of components, and (id, rep) of the usable records that share one.

    The packed records are written once, as every later step reads them; unusable vectors are left out.
    """
    base = written(records.mapInArrow(compact, "id string, h long, d int, v binary"))
    keys, n = repeated_keys(base.select("h"), "h")
    if n == 0:
        return base, None
    side = checked_broadcast(keys, n, OPEN_KEYS)
    copies = written(base.join(side, "h", "left_semi"))
    reps = written(copies.groupBy("h").agg(F.min("id").alias("id"), F.min_by(F.struct("d", "v"), "id").alias("of")).select("id", "h", "of.d", "of.v"))
    members = cut(copies.select("id", "h").join(checked_broadcast(reps.select("h", F.col("id").alias("rep")), n), "h").select("id", "rep"))
    return base.join(side, "h", "left_anti").select("id", "h", "d", "v").unionByName(reps), members


def tagged(distinct: DataFrame) -> DataFrame:
    return distinct.withColumn("uid", F.xxhash64("id").bitwiseAND(F.lit(0xFFFFFFFF)))


def verified_pairs(records: DataFrame, candidates: DataFrame, least: float) -> DataFrame:
    """(id_a, id_b, similarity): the pairs of uids (a, b) of at least ``least``, as ids, once each."""
    n = candidates.count()
    ends = F.explode(F.array(F.struct(F.col("a").alias("uid"), F.lit(0).alias("side")), F.struct(F.col("b").alias("uid"), F.lit(1).alias("side")))).alias("end")
    long = candidates.select("a", "b", ends).select("a", "b", "end.uid", "end.side")
    wide = records.join(checked_broadcast(long, 2 * n, BROADCAST_ENDS), "uid").select("a", "b", "side", "id", "d", "v")
    return wide.repartition(partitions(records.sparkSession, 2 * n, 50_000), "a", "b").mapInArrow(verified(least), "id_a string, id_b string, similarity double").distinct()


def _parts(records: DataFrame, rows: int) -> int:
    return partitions(records.sparkSession, rows * ROUTES, ENTRIES_PER_TASK)


def similar_classes(distinct: DataFrame, rows: int, least: float) -> DataFrame:
    """(id_a, id_b, similarity) of records with different multisets of similarity at least ``least``."""
    records = tagged(distinct)
    parts = _parts(records, rows)
    spread = records.select("uid", "d", "v").mapInArrow(to_variants(3 * parts), "part long, entries binary").repartition(parts, "part")
    released(distinct.sparkSession, rows)
    candidates = cut(spread.mapInArrow(colliding, "a long, b long").distinct())
    released(distinct.sparkSession, rows)
    return verified_pairs(records, candidates, least)


def near_duplicates(vectors: DataFrame, least: float = 0.7) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: stored records whose multisets of components have at least that similarity.

    Null, empty, all-zero and non-finite vectors take no part. Records with the same multiset are compared once as a
    class and put back for the result. An empty table gives no rows.
    """
    distinct, members = duplicate_classes(current_vectors(vectors))
    pairs = similar_classes(distinct, vectors.count(), least)
    if members is None:
        return pairs
    left, right = members.select(F.col("rep").alias("id_a"), F.col("id").alias("x")), members.select(F.col("rep").alias("id_b"), F.col("id").alias("y"))
    wide = pairs.join(left, "id_a", "left").join(right, "id_b", "left").select(F.coalesce("x", "id_a").alias("x"), F.coalesce("y", "id_b").alias("y"), "similarity")
    same = spread_pairs(members, "rep", "id").select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(1.0).alias("similarity"))
    every = wide.unionByName(same)
    return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


def star_links(distinct: DataFrame, rows: int, least: float) -> DataFrame:
    """(a, b) as ids: links of at least ``least`` that join the same records as all such pairs would.

    Under a key of many near pairs the entries are linked to the first; keys whose entries then lie in several components are met again,
    and entries of different components are paired there. The number of links does not grow with the pairs of a group.
    """
    records = tagged(distinct)
    parts = _parts(records, rows)
    spread = records.select("uid", "d", "v").mapInArrow(to_variants(3 * parts), "part long, entries binary").repartition(parts, "part")
    released(distinct.sparkSession, rows)
    stars = written(spread.mapInArrow(starred(3 * parts), "key long, a long, b long, n long, near boolean"))
    released(distinct.sparkSession, rows)
    ends = stars.where("near").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = cut(verified_pairs(records, cut(ends), least).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    found = connected_components(links, "a", "b")
    # keys of few near pairs are settled: all of them are given
    uid = lambda c: F.xxhash64(c).bitwiseAND(F.lit(0xFFFFFFFF))
    label = cut(found.select(uid("id").alias("uid"), uid("community").alias("label")).groupBy("uid").agg(F.min("label").alias("label")))
    side = lambda c: label.select(F.col("uid").alias(c), F.col("label").alias(f"of_{c}"))
    apart = stars.where("n > 2").join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    keys = cut(apart.select("key").distinct())
    n = keys.count()
    if n == 0:
        return links
    only = np.sort(keys.toArrow().column("key").to_numpy().view(np.uint64)) if n <= OPEN_KEYS else None
    labelled = records.join(checked_broadcast(label, label.count()), "uid", "left").select("uid", "d", "v", F.coalesce("label", "uid").alias("label"))
    again = labelled.mapInArrow(to_variants(3 * parts, only), "part long, entries binary").repartition(parts, "part")
    more = verified_pairs(records, cut(again.mapInArrow(crossing, "a long, b long").distinct()), least)
    return links.unionByName(more.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))


def duplicate_groups(vectors: DataFrame, least: float = 0.7) -> DataFrame:
    """(id, group_id): every record with a near duplicate and the least id of its group. No pairs are listed."""
    distinct, members = duplicate_classes(current_vectors(vectors))
    links = star_links(distinct, vectors.count(), least)
    stars = links if members is None else links.unionByName(members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    return connected_components(stars, "a", "b").toDF("id", "group_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/vectors.parquet")).select("id_a", "id_b")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(spark.read.parquet(f"{sf_dir}/vectors.parquet"))
