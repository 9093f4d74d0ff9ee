"""Near copies of the pipeline against brute force over all pairs."""

import random

import corpus_pipeline
from cirrostrat.llm import near_copies


def brute_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_kept(rows):
    """Rows (id, text) that stand for their component of all pairs of similarity 0.8 or more."""
    sets = {t: brute_set(t) for _, t in rows}
    texts, group = list(sets), {t: t for t in sets}
    for i, s in enumerate(texts):
        for t in texts[:i]:
            a, b = sets[s], sets[t]
            if 5 * len(a & b) >= 4 * len(a | b) and group[s] != group[t]:
                old, new = group[s], group[t]
                group = {k: new if g == old else g for k, g in group.items()}
    first = {}
    for d, t in rows:
        first[group[t]] = min(first.get(group[t], (True, 0)), (d is None, d or 0))
    return sorted(first.values())


def texts(rng, words=400):
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(words)]
    line = [rng.choice(vocabulary) for _ in range(12)]
    for g in range(25):
        base = (line if g % 2 else []) + [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 30, 80, 200]))]
        for _ in range(40 if g == 7 else 6):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 30)):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[k], rng.choice(vocabulary)]])
                copy = copy or ["x"]
            yield " ".join(copy)
    yield from (None, "", " \n", "One two", "one TWO")


def test_near_copies_match_brute_force(spark):
    rng = random.Random(5)
    rows = list(enumerate(texts(rng)))
    rng.shuffle(rows)
    rows += [(None, rows[0][1]), (None, "stands alone, without an id, in this table"), rows[3]]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, extra int")
    kept = near_copies.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == brute_kept(rows)
    assert near_copies.representatives(docs.limit(0)).count() == 0


def test_large_cells_match_brute_force(spark, monkeypatch):
    """A group of copies some of which are similar to few others, in cells that count as large, in small blocks."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(90)]
    rows = []
    for d in range(120):
        copy = list(words)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 2, 3, 4])):
            copy[rng.randrange(len(copy))] = f"odd{rng.randrange(40)}"
        rows.append((d, " ".join(copy)))
    monkeypatch.setattr(near_copies, "CELL_SETS", 4)
    monkeypatch.setattr(near_copies, "BLOCK_SETS", 5)
    monkeypatch.setattr(near_copies, "CENTRES", 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((False, r["doc_id"]) for r in near_copies.representatives(docs).collect()) == brute_kept(rows)


def test_stage_drops_copies_of_similarity_08(spark):
    """Two changed words of 100: similarity 86/106; five: below 0.8."""
    words = [f"word{i}" for i in range(100)]
    near, far = list(words), list(words)
    for k in (30, 60):
        near[k] = "other"
    for k in (10, 30, 50, 70, 90):
        far[k] = "distant"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()} == {1, 3}
    assert {r["doc_id"] for r in near_copies.representatives(docs, None).collect()} == {1, 3}
