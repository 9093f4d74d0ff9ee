"""Passages of benchmark items against brute force."""

import random

import corpus_pipeline
from cirrostrat.llm import decontaminate


def fewest_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_parts_of_items_are_found(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    items = [(i, sentence(n)) for i, n in enumerate([66, 40, 30, 16, 8, 1])]
    rows = [(0, items[0][1][:300]), (1, items[0][1][-99:]), (2, sentence(9) + " " + items[1][1][31:131] + sentence(9)), (3, sentence(80)), (4, items[4][1]), (5, None)]
    for d in range(10, 50):
        t = list(items[d % 4][1])
        a = rng.randrange(max(1, len(t) - 90))
        t = t[a : a + rng.randint(60, 140)]
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], ["z"], [t[k], "q"]])
        rows.append((d, " ".join([sentence(5), "".join(t), sentence(5)])))
    w, step = decontaminate.PASSAGE, decontaminate.STEP
    want = {}
    for d, t in rows:
        for i, x in items:
            n, m = decontaminate.normal(t), decontaminate.normal(x)
            if len(m) < decontaminate.Q:
                if f" {m} " in f" {n} ":
                    want[d, i] = 0
                continue
            e = fewest_edits(m, n)
            if e <= decontaminate.budget(len(m)):
                want[d, i] = e
            elif len(m) > w:
                e = min(fewest_edits(m[b : b + w], n) for b in [*range(0, len(m) - w, step), len(m) - w])
                if e <= decontaminate.budget(w):
                    want[d, i] = e
    assert {(0, 0), (1, 0), (2, 1), (4, 4)} <= set(want) and 20 < len(want) < 45
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.op10_decontaminate(spark, str(tmp_path)).collect()} == want
    assert {r["doc_id"] for r in corpus_pipeline.without_benchmark(spark, docs, str(tmp_path)).collect()} == {d for d, _ in rows} - {d for d, _ in want}
