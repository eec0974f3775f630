"""Long exact spans shared between records: de Bruijn compaction.

A text is a walk over its k-mers of ``SPAN`` characters, the edges of the graph; a span of at least that length stands in
two records just if they share a k-mer. Every k-mer holds a minimiser (the least of its ``WINDOW`` hashed grams of
``GRAM`` characters), and consecutive k-mers of one minimiser make a *run*. Only runs whose minimiser stands in several
records are looked at: equal k-mers have equal minimisers, so they meet under the minimiser's gram, where they are
compared as texts. There nonbranching stretches of repeated k-mers compact to segments; a join on the coordinates in the
source texts then continues paths from run to run. Pairs are listed for the first segment of each path only, as every
record that holds a later segment of the path holds the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage as cut
from ..session import written
from .common import checked_broadcast, partitions, spread_pairs
from .p5_near_duplicates import mix64
from .p7_encode import chunks

SPAN, GRAM = 100, 64
WINDOW = SPAN - GRAM + 1
#: Characters hashed together.
CHUNK_CHARS = 1_000_000
#: Runs of one gram that one task compares.
HOT_KINDS = 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(x: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hashed:
    """Windows of a list of texts, laid end to end."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
        self.size = np.array([len(r) // 4 for r in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.code = code = np.frombuffer(b"".join(raw), np.uint32)
        # positions restart with each text, so that powers stay short
        self.position = np.arange(len(code)) - np.repeat(self.start, self.size)
        longest = int(self.size.max()) + 1
        up, self.down = _powers(_ODD, longest), _powers(_INVERSE, longest)
        term = mix64(code) * up[self.position]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
        self.left = np.repeat(self.start + self.size, self.size) - np.arange(len(code))  # characters from here to the text's end

    def windows(self, length: int) -> np.ndarray:
        """Hash of the ``length`` characters from each place; of no meaning where ``left`` is less."""
        n = len(self.position)
        end = np.minimum(np.arange(n) + length, n)
        return mix64((self.sums[end] - self.sums[:-1]) * self.down[self.position])


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` over x[i : i + width] for each i, by doubling; x is taken as padded with its last value."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = best(out[:-step], out[step:]) if step < len(out) else out[:-step]
        have += step
    return out


def anchors(h: Hashed) -> tuple[np.ndarray, np.ndarray]:
    """(places of minimisers, hashes of all grams): a gram that is the least of some whole window within its text."""
    gram = h.windows(GRAM)
    gram[h.left < GRAM] = np.iinfo(np.uint64).max
    least = sliding(gram, WINDOW, np.minimum)
    least[h.left < SPAN] = 0
    # the greatest of the minima of the windows that hold a place: those that start up to WINDOW - 1 before it
    seen = sliding(least[::-1], WINDOW, np.maximum)[::-1]
    return np.flatnonzero((gram == seen) & (h.left >= GRAM)), gram


def _long_texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str]]]:
    text = batch.column("text").to_pylist()
    rows = np.array([i for i, t in enumerate(text) if t is not None and len(t) >= SPAN], np.int64)
    text = [text[i] for i in rows]
    for a, b in chunks(text, CHUNK_CHARS):
        yield rows[a:b], text[a:b]


def to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, h) to (gram, doc_id, h, place)."""
    for batch in batches:
        doc = batch.column("doc_id").to_numpy()
        for rows, texts in _long_texts(batch):
            h = Hashed(texts)
            at, gram = anchors(h)
            owner = np.repeat(rows, h.size)[at]
            yield pa.RecordBatch.from_arrays([pa.array(gram[at].view(np.int64)), pa.array(doc[owner]), batch.column("h").take(pa.array(owner)), pa.array(h.position[at].astype(np.int32))], names=["gram", "doc_id", "h", "place"])


def first_least(x: np.ndarray, width: int) -> np.ndarray:
    """For each i the first place of the least of x[i : i + width] (of what is left of x at its end)."""
    value, place, have = x.copy(), np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        if step < len(x):
            later = value[step:] < value[:-step]
            place[:-step] = np.where(later, place[step:], place[:-step])
            value[:-step] = np.where(later, value[step:], value[:-step])
        have += step
    return place


def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, places) to (gram, doc_id, start, run): the runs of the minimisers at these places; start is the place
    of the first k-mer, run the text from there to the end of the last."""
    for batch in batches:
        doc, places = batch.column("doc_id").to_numpy(), batch.column("places").to_pylist()
        for rows, texts in _long_texts(batch):
            h = Hashed(texts)
            gram = h.windows(GRAM)
            gram[h.left < GRAM] = np.iinfo(np.uint64).max
            wanted = np.zeros(len(gram), bool)
            for i, r in enumerate(rows):
                p = np.array(places[r], np.int64)
                wanted[h.start[i] + p[p < h.size[i]]] = True
            least = first_least(gram, WINDOW)
            at = np.flatnonzero((h.left >= SPAN) & wanted[least])
            if not len(at):
                continue
            new = np.concatenate([[True], (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (h.position[at[1:]] == 0)])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(at)))
            start = at[first]
            owner = np.repeat(np.arange(len(rows)), h.size)[start]
            begin = h.position[start]
            run = [texts[o][b : b + SPAN + k - 1] for o, b, k in zip(owner.tolist(), begin.tolist(), n.tolist())]
            columns = [pa.array(gram[least[start]].view(np.int64)), pa.array(doc[rows[owner]]), pa.array(begin.astype(np.int32)), pa.array(run, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "doc_id", "start", "run"])


def runs(documents: DataFrame) -> DataFrame:
    """(gram, kind, doc_id, start, run) of the minimisers that stand in several records; kind is a digest of the run."""
    docs = documents.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("h"))
    found = docs.mapInArrow(to_anchors, "gram long, doc_id long, h long, place int")
    twice = cut(found.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("gram"))
    # the anchors are found again instead of being kept: most of them stand in one record only
    places = cut(found.join(checked_broadcast(twice, twice.count()), "gram").groupBy("doc_id", "h").agg(F.collect_set("place").alias("places")))
    wide = docs.join(checked_broadcast(places, places.count(), 40_000), ["doc_id", "h"]).select("doc_id", "text", "places")
    out = wide.mapInArrow(to_runs, "gram long, doc_id long, start int, run string")
    return written(out.select("gram", F.unhex(F.md5(F.col("run").cast("binary"))).alias("kind"), "doc_id", "start", "run"))


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, class) of all k-mers of the texts, by text and place; equal k-mers, and only they, are of one class."""
    h = Hashed(texts)
    at = np.flatnonzero(h.left >= SPAN)
    owner, place = np.repeat(np.arange(len(texts)), h.size)[at], h.position[at]
    _, first, same = np.unique(h.windows(SPAN)[at], return_index=True, return_inverse=True)
    for s in range(0, len(at), 20_000):
        x = slice(s, s + 20_000)
        if (h.code[at[x, None] + np.arange(SPAN)] != h.code[at[first[same[x]], None] + np.arange(SPAN)]).any():
            # two k-mers share a hash: they are told apart as texts
            kmers = [texts[o][p : p + SPAN] for o, p in zip(owner.tolist(), place.tolist())]
            _, same = np.unique(np.array(kmers, object), return_inverse=True)
            break
    return owner, place, same


def segments(texts: list[str], lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place, k-mers, path, occurrences): the nonbranching stretches of repeated k-mers in runs of one gram, each
    text standing ``n`` times in records ``lo`` to ``hi``. Stretches of one path hold the same k-mers."""
    owner, place, kmer = classes(texts)
    most = kmer.max() + 1
    low, high, total = np.full(most, np.iinfo(np.int64).max), np.full(most, np.iinfo(np.int64).min), np.zeros(most, np.int64)
    np.minimum.at(low, kmer, lo[owner])
    np.maximum.at(high, kmer, hi[owner])
    np.add.at(total, kmer, n[owner])
    repeated = low < high
    before = np.where(place == 0, -1, np.concatenate([[-1], kmer[:-1]]))
    b_low, b_high = np.full(most, most), np.full(most, -1)
    np.minimum.at(b_low, kmer, before)
    np.maximum.at(b_high, kmer, before)
    # all occurrences follow those of one k-mer, which has no others
    follows = (b_low == b_high) & (b_low >= 0)
    follows[follows] &= (total[b_low[follows]] == total[follows]) & repeated[b_low[follows]]
    keep = repeated[kmer]
    start = np.flatnonzero(keep & ~((place > 0) & follows[kmer]))
    ends = np.flatnonzero(keep & np.concatenate([(owner[1:] != owner[:-1]) | ~keep[1:] | ~follows[kmer[1:]], [True]]))
    return owner[start], place[start], ends - start + 1, kmer[start], total[kmer[start]]


def compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, kind, run, lo, hi, n) to (gram, kind, place, length, path, n): :func:`segments` of each gram."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    gram = table.column("gram").to_numpy()
    order = np.argsort(gram, kind="stable")
    table, gram = table.take(pa.array(order)), gram[order]
    texts = table.column("run").to_pylist()
    lo, hi, n = (table.column(c).to_numpy() for c in ("lo", "hi", "n"))
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    ends = np.append(first[1:], len(gram))
    size = np.cumsum([len(t) for t in texts])
    s = 0
    while s < len(first):
        # whole grams of together about CHUNK_CHARS; equal k-mers have equal grams, so they are not told apart here
        begin = first[s]
        e = max(s + 1, int(np.searchsorted(size[ends - 1], (size[begin - 1] if begin else 0) + CHUNK_CHARS, "right")))
        x = slice(begin, ends[e - 1])
        row, place, length, path, total = segments(texts[x], lo[x], hi[x], n[x])
        row = begin + row
        yield pa.RecordBatch.from_arrays(
            [table.column(c).take(pa.array(row)).combine_chunks() for c in ("gram", "kind")] + [pa.array(place.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(path.astype(np.int64)), pa.array(total)],
            names=["gram", "kind", "place", "length", "path", "n"],
        )
        s = e


def occurrences(documents: DataFrame) -> DataFrame:
    """(doc_id, place, length, path, n): where the segments of repeated k-mers stand; length is in k-mers, n the number
    of occurrences of the path.

    Equal runs are compared once. A gram with more than ``HOT_KINDS`` different runs is not brought into one task: its
    k-mers are grouped as texts by Spark and stay uncompacted.
    """
    all_runs = runs(documents)
    kinds = all_runs.groupBy("gram", "kind").agg(F.first("run").alias("run"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    hot = cut(all_runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_KINDS).select("gram"))
    n_hot = hot.count()  # one gram for that many runs at most
    hot = checked_broadcast(hot, n_hot)
    cold = kinds.join(hot, "gram", "left_anti") if n_hot else kinds
    spread = cold.repartition(partitions(documents.sparkSession, 0, 1), "gram")
    segs = spread.mapInArrow(compacted, "gram long, kind binary, place int, length int, path long, n long")
    at = all_runs.select("gram", "kind", "doc_id", "start")
    name = F.concat_ws(":", "gram", "path")
    out = segs.join(at, ["gram", "kind"]).select("doc_id", (F.col("start") + F.col("place")).alias("place"), "length", name.alias("path"), "n")
    if not n_hot:
        return out
    each = F.explode(F.sequence(F.lit(0), F.char_length("run") - SPAN)).alias("at")
    kmers = all_runs.join(hot, "gram").select("doc_id", "start", "run", each).select("doc_id", (F.col("start") + F.col("at")).alias("place"), F.substring(F.col("run"), F.col("at") + 1, F.lit(SPAN)).alias("kmer"))
    again = kmers.groupBy("kmer").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("kmer", "n")
    return out.unionByName(kmers.join(again, "kmer").select("doc_id", "place", F.lit(1).alias("length"), F.concat(F.lit("t"), "kmer").alias("path"), "n"))


def first_segments(occ: DataFrame) -> DataFrame:
    """(path): paths that do not continue another. A path continues one that ends right before it at all occurrences of
    both."""
    before = occ.select("doc_id", (F.col("place") + F.col("length")).alias("place"), F.col("path").alias("before"), F.col("n").alias("n_before"))
    joined = occ.join(before, ["doc_id", "place"], "left").groupBy("path").agg(F.max("n").alias("n"), F.count("before").alias("seen"), F.min("before").alias("b1"), F.max("before").alias("b2"), F.max("n_before").alias("n_before"))
    follows = (F.col("seen") == F.col("n")) & (F.col("b1") == F.col("b2")) & (F.col("n_before") == F.col("n"))
    return joined.where(~F.coalesce(follows, F.lit(False))).select("path")


def shared_pairs(documents: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: records whose texts share a verbatim passage of at least ``SPAN`` characters.

    Characters are code points. Null, empty and shorter texts, and rows with a null doc_id, share none; a passage that
    recurs within one record only is not shared. Rows of one doc_id are one record. An empty table gives no rows.
    """
    occ = written(occurrences(documents))
    heads = cut(first_segments(occ))
    where = occ.join(checked_broadcast(heads, heads.count()), "path").select("path", "doc_id").distinct()
    pairs = spread_pairs(written(where), "path", "doc_id")
    return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def shared_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, start, length): the longest stretches of each text all of whose characters lie in shared passages."""
    ends = occurrences(documents).select("doc_id", "place", (F.col("place") + F.col("length") + (SPAN - 1)).alias("end"))
    order = Window.partitionBy("doc_id").orderBy("place", "end")
    fresh = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) < F.col("place"), F.lit(True))
    island = F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = ends.withColumn("fresh", fresh).withColumn("island", island)
    return marked.groupBy("doc_id", "island").agg(F.min("place").alias("start"), F.max("end").alias("end")).select("doc_id", "start", (F.col("end") - F.col("start")).alias("length"))


def shared_characters(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, n_shared): of each record the characters of its text (0 for null) and those that lie in passages
    of at least ``SPAN`` characters that also stand in another record."""
    covered = shared_spans(documents).groupBy("doc_id").agg(F.sum("length").alias("n_shared"))
    all_docs = documents.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))
    return all_docs.join(covered, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_characters(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_GRAMS = f"""
g AS (SELECT doc_id, i, substr(text, i, {SPAN}) AS s FROM (
  SELECT doc_id, text, unnest(range(1, length(text) - {SPAN - 2})) AS i FROM documents WHERE length(text) >= {SPAN})),
r AS (SELECT s FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
o AS (SELECT g.doc_id, g.i, g.s FROM g JOIN r USING (s))
"""
SQL = {
    "p9_found": f"""
WITH {_GRAMS}, d AS (SELECT DISTINCT doc_id, s FROM o)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM d a JOIN d b USING (s) WHERE a.doc_id < b.doc_id
""",
    "p9_shared": f"""
WITH {_GRAMS}, c AS (
  SELECT doc_id, least({SPAN}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {SPAN})) AS gap FROM o)
SELECT d.doc_id, CAST(coalesce(length(d.text), 0) AS BIGINT) AS n_chars, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shared
FROM documents d LEFT JOIN (SELECT doc_id, sum(gap) AS n FROM c GROUP BY 1) s USING (doc_id)
""",
}
