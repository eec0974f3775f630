"""Encoding, containers and shared spans against reference implementations and brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecloom.llm import common, p7_encode, p8_containers, p9_spans

DOCUMENTS = "doc_id bigint, text string, tokens bigint, edge string, place int, n bigint, places string"
TEXTS = [None, "", " ", "\n\t  　", "Hello world", "<|endoftext|> it's they'LL 123abc", "日本語のテキスト😀", "é ﻿​", "aaaaaaaaaaaaaaaaaaaaaaab", "word " * 4_000, "x" * 30_000, "日本語" * 3_000]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 5, "e", 1, 2, "p") for i, t in enumerate(texts)], DOCUMENTS)


@pytest.fixture(scope="module")
def tiktoken_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    with open(p7_encode.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p7_encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    with open(p7_encode.RANKS, "rb") as f:
        return p7_encode.encoder(f.read(), p7_encode.PATTERN)


def test_ids(spark, tiktoken_encoder):
    df = documents(spark, TEXTS).unionByName(spark.createDataFrame([(None, "null id", 0, "", 0, 0, ""), (3, "twice", 0, "", 0, 0, "")], DOCUMENTS))
    got = sorted(((r.doc_id, r.ids) for r in p7_encode.token_ids(df).collect()), key=str)
    want = [(i, tiktoken_encoder.encode_ordinary(t) if t else []) for i, t in enumerate(TEXTS)] + [(None, tiktoken_encoder.encode_ordinary("null id")), (3, tiktoken_encoder.encode_ordinary("twice"))]
    assert got == sorted(want, key=str)
    counts = sorted(((r.doc_id, r.tokens) for r in p7_encode.token_counts(df).collect()), key=str)
    assert counts == sorted(((i, len(x)) for i, x in want), key=str)
    assert p7_encode.token_ids(df.where("false")).isEmpty()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(encoder, tiktoken_encoder, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, n = encoder.texts(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n))[:-1]] == [tiktoken_encoder.encode_ordinary(t) for t in texts]


def test_forgetting_words(encoder, monkeypatch, tiktoken_encoder):
    monkeypatch.setattr(p7_encode, "REMEMBERED", 3)
    for t in ("one two three four five", "six seven one two", "one"):
        assert encoder.texts([t])[0].tolist() == tiktoken_encoder.encode_ordinary(t)


def check(rows, sizes, capacity):
    held, placed, parts = Counter(), Counter(), Counter()
    for r in rows:
        held[r.container] += r.tokens
        placed[r.doc_id] += r.tokens
        parts[r.doc_id] += 1
    assert placed == Counter({i: max(n or 0, 0) for i, n in sizes}) and set(placed) == {i for i, _ in sizes}
    assert max(held.values(), default=0) <= capacity
    assert all(parts[i] == max(1, -(-max(n or 0, 0) // capacity)) for i, n in sizes)
    return len(held)


def test_containers(spark, monkeypatch):
    rng = np.random.default_rng(0)
    sizes = [(i, int(n)) for i, n in enumerate(np.minimum(rng.lognormal(4, 1.3, 900), 700))] + [(1000, 0), (1001, None), (1002, -3), (1003, 100), (1004, 200), (1005, 7)]
    df = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint").repartition(3)
    n = check(p8_containers.containers(df, 100).collect(), sizes, 100)
    ideal = -(-sum(max(t or 0, 0) for _, t in sizes) // 100)
    monkeypatch.setattr(p8_containers, "ROWS_PER_TASK", 300)
    spread = p8_containers.containers(df, 100)
    assert n <= ideal * 1.01 + 1 and check(spread.collect(), sizes, 100) <= ideal * 1.02 + 1
    key = lambda x: sorted((r.doc_id, r.container, r.tokens) for r in x.collect())
    assert key(spread) == key(p8_containers.containers(df.orderBy(-df.doc_id), 100))
    assert p8_containers.containers(df.where("false")).isEmpty()
    only = df.where("tokens <= 0")
    assert {r.tokens for r in p8_containers.containers(only).collect()} == {0}


def test_no_progress_ends(spark, monkeypatch):
    monkeypatch.setattr(p8_containers, "ROWS_PER_TASK", 20)
    sizes = [(i, 60 if i % 2 else 41) for i in range(100)]
    check(p8_containers.containers(spark.createDataFrame(sizes, "doc_id bigint, tokens bigint"), 100).collect(), sizes, 100)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bounds_hold(sizes):
    sizes = np.array(sizes, np.int64)
    box = p8_containers.best_fit_decreasing(sizes, 20)
    used = len(set(box.tolist()))
    assert all(sizes[box == b].sum() <= 20 for b in set(box.tolist()))

    def fewest(left, open_):
        if not left:
            return len(open_)
        best = len(open_) + len(left)
        for i in {o: i for i, o in enumerate(open_)}.values():
            if open_[i] + left[0] <= 20:
                best = min(best, fewest(left[1:], open_[:i] + [open_[i] + left[0]] + open_[i + 1 :]))
        return min(best, fewest(left[1:], [*open_, left[0]])) if len(open_) < best else best

    assert p8_containers.lower_bound(sizes, 20) <= (fewest(sorted(sizes.tolist(), reverse=True), []) if len(sizes) else 0) <= used or not len(sizes)


def span_texts():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh é日😀") for _ in range(n))
    a, b, c, d = word(100), word(180), word(99), "xy" * 200
    texts = [None, "", "short", word(400), a, word(50) + a + word(70), b + word(30), word(10) + b[20:170], b[:120], c + word(60), word(60) + "|" + c, d, d[:150], d[1:101], "xz" * 80, word(30) + a + a, a + word(5) + b + word(5) + a, word(3000)]
    return texts + [texts[3], texts[3]] + [word(300) * 2]


def brute(texts, n=100):
    where = defaultdict(set)
    for i, t in enumerate(texts):
        for p in range(len(t or "") - n + 1):
            where[t[p : p + n]].add(i)
    pairs = {(x, y) for s in where.values() for x in s for y in s if x < y}
    shared = []
    for t in texts:
        marks = np.zeros(len(t or ""), bool)
        for p in range(len(t or "") - n + 1):
            if len(where[t[p : p + n]]) > 1:
                marks[p : p + n] = True
        shared.append(int(marks.sum()))
    return pairs, shared


@pytest.mark.parametrize("chunk, block, hot", [(1_000_000, 1_000, 100_000), (500, 2, 2), (1_000, 2, 0)])
def test_spans(spark, monkeypatch, chunk, block, hot):
    monkeypatch.setattr(p9_spans, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(p9_spans, "HOT_KINDS", hot)
    monkeypatch.setattr(common, "PAIR_BLOCK", block)
    texts = span_texts()
    pairs, shared = brute(texts)
    df = documents(spark, texts).unionByName(spark.createDataFrame([(None, texts[4], 0, "", 0, 0, "")], DOCUMENTS)).repartition(3)
    got = [(r.doc_a, r.doc_b) for r in p9_spans.shared_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs and len(pairs) > 15
    rows = {r.doc_id: (r.n_chars, r.n_shared) for r in p9_spans.shared_characters(df.where("doc_id IS NOT NULL")).collect()}
    assert rows == {i: (len(t or ""), s) for i, (t, s) in enumerate(zip(texts, shared))}


def test_paths_and_spans(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    a, b = word(700), word(300)
    texts = [word(80) + a + word(90), a + word(40), word(20) + a[:400] + word(30) + b, b, word(900)]
    df = documents(spark, texts)
    spans = {(r.doc_id, r.start): r.length for r in p9_spans.shared_spans(df).collect()}
    # neighbours can agree by chance, never the other way round
    for key, least in {(0, 80): 700, (1, 0): 700, (2, 20): 400, (2, 450): 300, (3, 0): 300}.items():
        near = [n for (d, s), n in spans.items() if d == key[0] and key[1] - 5 <= s <= key[1]]
        assert len(near) == 1 and least <= near[0] < least + 10
    # a path of 601 k-mers in two texts, 301 of them in a third: it branches once
    occ = p9_spans.occurrences(df)
    assert p9_spans.first_segments(occ).count() <= 5 < occ.select("path").distinct().count()


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(p9_spans.Hashed, "windows", lambda self, length: np.zeros(len(self.position), np.uint64))
    rng = random.Random(6)
    t = ["".join(rng.choice("ab") for _ in range(120)) for _ in range(3)]
    owner, place, kind = p9_spans.classes(t + [t[1]])
    of = {(o, p): k for o, p, k in zip(owner.tolist(), place.tolist(), kind.tolist())}
    assert all(of[1, p] == of[3, p] for p in range(21)) and len(set(kind.tolist())) == 63


def test_no_spans(spark):
    df = documents(spark, ["a" * 99, "a" * 99, None])
    assert p9_spans.shared_pairs(df).isEmpty() and p9_spans.shared_pairs(df.where("false")).isEmpty()
    assert {r.n_shared for r in p9_spans.shared_characters(df).collect()} == {0}


def test_minimisers_meet():
    rng = random.Random(9)
    shared = "".join(rng.choice("abc") for _ in range(100))
    for _ in range(30):
        x = ["".join(rng.choice("abc") for _ in range(rng.randrange(300))) for _ in range(4)]
        h = p9_spans.Hashed([x[0] + shared + x[1], x[2] + shared + x[3]])
        at, gram = p9_spans.anchors(h)
        first = set(gram[at[at < h.start[1]]].tolist())
        assert first & set(gram[at[at >= h.start[1]]].tolist())
