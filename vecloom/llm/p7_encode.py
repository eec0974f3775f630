"""Encoding of a corpus with a public byte-level BPE vocabulary, by batched numpy merge rounds.

The words of many texts lie in one flat symbol array. A round looks up the rank of every adjacent pair of a word by
binary search over the sorted pair keys, finds each word's lowest rank, and merges all its occurrences at once, left to
right without overlap. (A merge of rank r only opens pairs of higher rank, so this equals merging one at a time.)
Words that have no pair left leave the array.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Where the vocabulary's ranks are, by default.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pattern that splits text before the merges; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters encoded together, and words whose ids a Python worker remembers.
CHUNK_CHARS, REMEMBERED = 2_000_000, 200_000
_NONE = np.int64(2**31 - 1)


class Encoder:
    """Ids of words under a rank table (token bytes to rank, the rank being the id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.find = regex.compile(pattern).findall
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.known: dict[str, np.ndarray] = {}

    def pair_ranks(self, symbol: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each symbol; ``_NONE`` at a word's last symbol and for pairs without one."""
        out = np.full(len(symbol), _NONE)
        inside = np.flatnonzero(word[1:] == word[:-1])
        key = symbol[inside] << np.int64(32) | symbol[inside + 1]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        out[inside[found]] = self.rank[at[found]]
        return out

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each (non-empty) word."""
        coded = [w.encode() for w in words]
        size = np.array([len(c) for c in coded], np.int64)
        symbol = self.byte[np.frombuffer(b"".join(coded), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        out: list = [None] * len(words)
        while len(symbol):
            rank = self.pair_ranks(symbol, word)
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(rank, start)
            span = np.diff(np.append(start, len(symbol)))
            finished = lowest == _NONE
            for i in np.flatnonzero(finished):
                out[word[start[i]]] = symbol[start[i] : start[i] + span[i]].astype(np.int32)
            live = np.repeat(~finished, span)
            chosen = live & (rank == np.repeat(lowest, span)) & (rank != _NONE)
            # in a run of chosen starts only every other one can merge
            at = np.flatnonzero(chosen)
            if len(at):
                new_run = np.concatenate([[True], np.diff(at) != 1])
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
                symbol = symbol.copy()
                symbol[at] = rank[at]
                live[at + 1] = False
            symbol, word = symbol[live], word[live]
        return out

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each text); a null and an empty text have none."""
        number: dict[str, int] = {}
        stream, n_words = [], []
        for t in texts:
            found = self.find(t) if t else []
            n_words.append(len(found))
            stream.extend([number.setdefault(w, len(number)) for w in found])
        new = [w for w in number if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list(number)
        self.known.update(zip(new, self.words(new) if new else []))
        parts = [self.known[w] for w in number]
        size = np.array([len(p) for p in parts], np.int64)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        begin = np.cumsum(size) - size
        order = np.array(stream, np.int64)
        n = size[order] if len(order) else np.zeros(0, np.int64)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[order], n) if len(order) else np.zeros(0, np.int64)
        ends = np.cumsum(n_words)
        total = np.concatenate([[0], np.cumsum(n)])
        return flat[at], total[ends] - total[ends - np.array(n_words, np.int64)] if len(texts) else np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str) -> Encoder:
    return Encoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}, pattern)


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Slices of consecutive texts of about ``limit`` characters; a longer text is a slice of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encoded(ranks, pattern: str, key: str, count_only: bool):
    """A mapInArrow function from (key, text) to (key, ids), or to (key, tokens). ``ranks`` is a broadcast of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks.value, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts):
                ids, n = e.texts(texts[a:b])
                if count_only:
                    value, name = pa.array(n.astype(np.int64)), "tokens"
                else:
                    value, name = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32())), "ids"
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(a, b - a), value], names=[key, name])

    return run


def _ranks(spark: SparkSession, path: str):
    with open(path, "rb") as f:  # a vocabulary's size does not grow with the corpus
        return spark.sparkContext.broadcast(f.read())


def token_ids(documents: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids): the ids of each text without special tokens, whose strings are ordinary text.

    Null and empty texts give an empty list. Every row gives one row, whatever its doc_id.
    """
    run = encoded(_ranks(documents.sparkSession, ranks), pattern, "doc_id", False)
    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens): the number of ids of each text, 0 for null and empty ones."""
    run = encoded(_ranks(documents.sparkSession, ranks), pattern, "doc_id", True)
    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens long")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))
