"""Ranked search against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrostrat.llm import treaps

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(i, w) for i, text in docs if (w := words(text))]
    n_docs, n_words = len(counted), sum(len(w) for _, w in counted)
    df = Counter(t for _, w in counted for t in set(w))
    out = []
    for item, text in items:
        found = []
        for i, w in counted:
            tf, m = Counter(w), 100 - 50 + 50 * len(w) * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(words(text)) if tf[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def text(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) if rng.random() < 0.7 else "the" for _ in range(n))


VOCABULARY = [f"w{i}" for i in range(60)] + ["Straße", "ÉTÉ", "été", "漢字", "A1b", "x-y", "O'Neil", "\x00nul", "the,end"]


@pytest.mark.parametrize(("k", "shard"), [(5, 2_000_000), (50, 300), (3, 40)])
def test_against_plain_python(spark, k, shard):
    rng = random.Random(k)
    docs = [(i, rng.choice([None, "", "?!", text(rng, rng.randrange(1, 80), VOCABULARY)])) for i in rng.sample(range(-100, 5_000), 300)]
    docs += [(9_000 + i, docs[5][1] or "w1 w2 the") for i in range(40)]
    items = [(i, text(rng, rng.randrange(1, 12), VOCABULARY)) for i in range(12)] + [(20, None), (21, "--"), (22, "nowhere found"), (23, "the THE The")]
    got = treaps.rank(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), k, shard, block_chars=100)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, k)


def test_null_and_repeated_ids_and_repeated_items(spark):
    rng = random.Random(9)
    docs = [(None, text(rng, 9, VOCABULARY)) for _ in range(20)] + [(3, "w1 w2 w3")] * 9 + [(3, text(rng, 30, VOCABULARY)) for _ in range(9)] + [(i, "w1 w2 w3") for i in range(10, 40)]
    items = [(1, "w1 w2"), (1, "w1 w2"), (1, "w3 the"), (None, "w1")]
    got = treaps.rank(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), 15, 30)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 15)


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a b")], []), ([(1, None)], [(1, "a")]), ([(1, "a a b")], [(2, "a c")])])
def test_few_rows(spark, docs, items):
    assert sorted(map(tuple, treaps.rank(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect())) == brute(docs, items, 50)


def test_clashing_columns_and_long_texts(spark):
    rng = random.Random(4)
    docs = [(1, text(rng, 400_000, VOCABULARY)), (2, "w1" * 800_000), (3, "w1 w2")]
    items = [(1, "w1 w5 été")]
    extra = {c: F.lit(1) for c in ("n", "terms", "counts", "q", "score", "rank", "salt", "place", "t", "item", "count")}
    got = treaps.rank(spark.createDataFrame(docs, DOCS).withColumns(extra), spark.createDataFrame(items, ITEMS).withColumns(extra))
    assert sorted(map(tuple, got.collect())) == brute(docs, items, 50)


def test_treaps_keep_both_orders():
    rng = random.Random(1)
    for n in (1, 2, 7, 200):
        key = [rng.randrange(10 * n) for _ in range(n)]
        left, right, root = treaps.treap(key)
        seen, todo = [], [(root, False)]
        while todo:
            i, done = todo.pop()
            if i < 0:
                continue
            if done:
                seen.append(i)
                continue
            assert all(c < 0 or key[c] <= key[i] for c in (left[i], right[i]))
            todo += [(right[i], False), (i, True), (left[i], False)]
        assert seen == list(range(n))


@pytest.mark.parametrize(("leaf", "wide"), [(1, 1), (2, 5), (16, 64)])
def test_traversal_finds_what_sums_find(monkeypatch, leaf, wide):
    monkeypatch.setattr(treaps, "LEAF", leaf)
    monkeypatch.setattr(treaps, "WIDE", wide)
    rng = np.random.default_rng(leaf)
    for _ in range(60):
        n, v = int(rng.integers(1, 400)), int(rng.integers(1, 12))
        held = rng.random((n, v)) < rng.random(v)
        tf = rng.integers(1, 4, (n, v)) * held
        length = rng.integers(1, 300, n)
        docs, words, ids = n, int(length.sum()), rng.permutation(n // 2 + 1)[rng.integers(0, n // 2 + 1, n)]
        void = rng.random(n) < 0.1
        index = treaps.Shard(ids, void, length, held.sum(axis=1), np.nonzero(held)[1], tf[held], docs, words)
        weights, best = rng.integers(0, 9_000, v), treaps.Best(7)
        index.search(np.arange(v), weights, best)
        m = 50 + 50 * length * docs // words
        score = (weights * (10**9 * tf // (1000 * tf + 20 * m[:, None])) * held).sum(axis=1)
        want = sorted((-s, bool(o), i) for s, o, i in zip(score.tolist(), void.tolist(), ids.tolist(), strict=True) if s > 0)[:7]
        assert list(zip((-best.score).tolist(), best.void.tolist(), best.id.tolist(), strict=True)) == want


def test_subtrees_that_cannot_reach_the_best_are_left():
    """With a rare term and many documents that lack it, few stretches are scored."""
    n = 20_000
    sizes = np.where(np.arange(n) % 1_000 == 0, 2, 1)
    term = np.concatenate([[0, 1] if s == 2 else [0] for s in sizes])
    index = treaps.Shard(np.arange(n), np.zeros(n, bool), np.full(n, 100), sizes, term, np.ones(len(term), np.int64), n, 100 * n)
    scored, plain = [], index._score
    index._score = lambda at, w, low, high, best: (scored.append(int((high - low + 1).sum())), plain(at, w, low, high, best))
    best = treaps.Best(10)
    index.search(np.array([0, 1]), np.array([1, 5_000]), best)
    assert best.id.tolist() == [1_000 * i for i in range(10)] and sum(scored) < n / 20
