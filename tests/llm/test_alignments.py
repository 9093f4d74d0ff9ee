"""Alignments many at a time against one at a time, and items that begin alike."""

import random
import time

import numpy as np

from cirrostrat.llm import decontaminate as D


def test_many_alignments_are_those_one_by_one():
    rng = np.random.default_rng(1)
    for _ in range(150):
        m, k, rows = int(rng.integers(1, 30)), int(rng.integers(0, 6)), int(rng.integers(1, 12))
        cases = []
        for _ in range(rows):
            item = rng.integers(0, 3, m).astype(np.uint32)
            text = np.concatenate([rng.integers(0, 3, rng.integers(0, 20)), item, rng.integers(0, 3, rng.integers(0, 20))]).astype(np.uint32)
            for _ in range(int(rng.integers(0, 5))):
                text = np.delete(text, rng.integers(0, len(text))) if len(text) > 1 and rng.random() < 0.5 else np.insert(text, rng.integers(0, len(text) + 1), 2).astype(np.uint32)
            low = int(rng.integers(-5, 12))
            cases.append((item, text, low, int(rng.integers(1, 15))))
        wide = max(c[3] for c in cases)
        for back in (False, True):
            items, texts, size, room = np.empty((rows, m), np.uint32), np.full((rows, wide + m), D._OUTSIDE), np.empty(rows, np.int64), np.empty((rows, 2), np.int64)
            for r, (item, text, low, n) in enumerate(cases):
                if back:
                    item, text, low = item[::-1], text[::-1], len(text) - m - (low + n - 1)
                items[r], size[r], room[r] = item, n, (-low, len(text) - low)
                a, z = max(0, low), min(len(text), low + n + m)
                if z > a:
                    texts[r, a - low : z - low] = text[a:z]
            got = D.align_many(items, texts, size, room, k).tolist()
            assert [e if e <= k else None for e in got] == [D.align(i, t, low, n, k) for i, t, low, n in cases]


def test_items_with_a_common_stem():
    """A document that quotes only what all items begin with holds none of them, and is told so soon."""
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in "nrst"]
    stem = "which of the following statements about the history of "
    items = [(i, stem + " ".join(rng.choice(words) for _ in range(25))) for i in range(1_500)]
    index = D.Index(items, passage=D.PASSAGE)
    texts = [D.normal(f"{' '.join(rng.choice(words) for _ in range(20))} {stem} {' '.join(rng.choice(words) for _ in range(20))}") for _ in range(40)]
    texts[7] = D.normal(f"so {items[300][1]} there")
    texts[9] = D.normal(f"so {items[301][1][:-9]} there")
    start = time.process_time()
    found = index.find(texts)
    assert {(n, i) for n, i, _ in found} == {(7, 300), (9, 301)}
    assert time.process_time() - start < 60
