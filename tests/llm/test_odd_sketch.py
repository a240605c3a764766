"""Near duplicates by odd sketches against all pairs of small corpora."""
from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from barloom.llm import odd_sketch

SCHEMA = "doc_id long, text string, node string, bucket string, n int"


def shingles(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w)


def by_hand(rows, threshold=80):
    sets = sorted({shingles(t) for _, t in rows}, key=lambda s: sorted(map(str, s)))
    ids = {s: [i for i, t in rows if shingles(t) == s and i is not None] for s in sets}
    root = {s: s for s in sets}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for k, a in enumerate(sets):
        for b in sets[:k]:
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                root[find(a)] = find(b)
    low = {}
    for s in sets:
        low.setdefault(find(s), []).extend(ids[s])
    out = Counter()
    for i, t in rows:
        s = shingles(t)
        c = i if not s else min(low[find(s)], default=None)
        out[(i, len(s), c, i == c)] += 1
    return out


def edited(words, rng, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


VOCABULARY = [f"w{k}" for k in range(400)]


def corpus(seed, size=220):
    """Texts with copies and edits of every strength, short ones and odd ones."""
    rng, texts = random.Random(seed), []
    for _ in range(12):
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([3, 8, 30, 120, 400]))]
        for _ in range(size // 12):
            texts.append(" ".join(edited(base, rng, rng.choice([0, 0.01, 0.03, 0.06, 0.09, 0.3]))))
    texts += [None, "", " \t\n", "one", "ONE", "one two", "One  Two", "two one", "é É", "Ä ä", "x" * 5000, "a b " * 3000]
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[5]), (None, "only here without an id"), (rows[0][0], "same id but other words")]


@pytest.mark.parametrize("seed,threshold", [(1, 80), (3, 60)])
def test_all_links(spark, seed, threshold):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "n", "b", 1) for i, t in rows], SCHEMA).repartition(5)
    got = odd_sketch.near_duplicates(docs, threshold).collect()
    assert Counter(map(tuple, got)) == by_hand(rows, threshold)


def test_large_buckets_are_dealt_out(spark, monkeypatch):
    """Blocks of four members and hubs in parts of three give the same components."""
    monkeypatch.setattr(odd_sketch, "BLOCK", 4)
    monkeypatch.setattr(odd_sketch, "PART", 3)
    rows = corpus(9, 150)
    docs = spark.createDataFrame([(i, t, "n", "b", 1) for i, t in rows], SCHEMA).repartition(3)
    assert Counter(map(tuple, odd_sketch.near_duplicates(docs).collect())) == by_hand(rows)


def test_a_chain_of_copies_that_are_near_their_neighbours_only(spark):
    words = [f"c{k}" for k in range(1000)]
    rows = [(k, " ".join(words[9 * k:9 * k + 100])) for k in range(60)]  # neighbours 0.83, next ones 0.69
    docs = spark.createDataFrame([(i, t, "n", "b", 1) for i, t in rows], SCHEMA)
    got = odd_sketch.near_duplicates(docs).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
    assert Counter(map(tuple, got)) == by_hand(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert odd_sketch.near_duplicates(docs).count() == 0
    blank = spark.createDataFrame([(4, None, "n", "b", 1), (5, " ", "n", "b", 1)], SCHEMA)
    assert sorted(map(tuple, odd_sketch.near_duplicates(blank).collect())) == [(4, 0, 4, True), (5, 0, 5, True)]


def test_block_seams():
    words = odd_sketch._Words()
    text = " ".join(VOCABULARY[k * k % 400] for k in range(900)) + "\n"
    for size in (1, 10, 100, 1 << 20):
        assert np.array_equal(odd_sketch.shingle_set(text, words, size), odd_sketch.shingle_set(text, words))
    assert len(odd_sketch.shingle_set(text, words)) == len(shingles(text))


def test_sketches_bound_the_difference():
    """The whole-set sketch never shows more bits than the sets differ in; samples estimate similarity."""
    rng = np.random.default_rng(4)
    for n, differ in [(50, 10), (500, 60), (5000, 500)]:
        pool = rng.integers(0, 1 << 63, n + differ, dtype=np.uint64)
        a, b = np.sort(pool[:n]), np.sort(pool[differ:])
        ma, mb = odd_sketch.marks_of(a), odd_sketch.marks_of(b)
        xor = np.bitwise_count(ma ^ mb)
        assert xor[odd_sketch.SAMPLE_WORDS:].sum() <= 2 * differ
        share = (n - differ) / (n + differ)
        bits = 64 * odd_sketch.SAMPLE_WORDS
        estimate = 1 + bits / (4 * odd_sketch.SAMPLES) * np.log(1 - 2 * xor[:odd_sketch.SAMPLE_WORDS].sum() / bits)
        assert abs(estimate - share) < 0.15
        assert np.array_equal(odd_sketch._unpacked(odd_sketch._packed(a)), a >> np.uint64(16))


def test_forest_spans_and_prefers_light_pairs():
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 60, 900), rng.integers(0, 60, 900)
    weight, part = rng.integers(0, 1000, 900), np.arange(60)
    keep = odd_sketch.forest(a, b, weight, part)
    label = list(range(60))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    total = 0
    for k in np.argsort(weight, kind="stable").tolist():  # Kruskal
        p, q = find(int(a[k])), find(int(b[k]))
        if p != q:
            label[p] = q
            total += int(weight[k])
    assert int(weight[keep].sum()) == total and len(keep) == 59
