"""The corpus pipeline against plain Python, stage by stage and as a whole: planted toxic documents, near copies, benchmark
passages, nulls, repeated rows and clashing columns; and an empty table."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest

from cirrostrat.llm import decontaminate, tokens

from test_mixing_model import WORD, seats_by_quotients, shares
from test_near_copies import brute_kept

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, toxic int, key long, __size long"


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8))) for _ in range(700)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(30)) for i in range(4)] + [(4, None)]
    docs, toxic, leaks = [], set(), set()

    def add(text, source=None):
        docs.append((len(docs), text, "en", source or rng.choice(["web", "web", "books", None]), len(text or ""), 7, 1, 2))
        return docs[-1][0]

    for _ in range(60):
        add(prose(rng.randint(30, 120)))
    for k in range(12):
        toxic.add(add(f"{prose(20)} you {rng.choice(['idiot', 'm0ron'])}, you {rng.choice(['scum', 'asshole'])} {prose(10)}"))
    for k in range(10):
        base = prose(100).split()
        add(" ".join(base))
        for _ in range(rng.randint(1, 3)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(100)] = rng.choice(vocabulary)
            add(" ".join(copy))
    for k in range(8):
        item = items[k % 4][1]
        leaks.add(add(f"{prose(25)}. {item.upper() if k < 4 else item[:120]} {prose(25)}"))
    add(None)
    add("")
    docs.append(docs[3])
    return docs, toxic, leaks, items


@pytest.fixture(scope="module")
def folder(spark, planted, tmp_path_factory):
    docs, toxic, _, items = planted
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(d, 1, int(d in toxic)) for d in range(72)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage(spark, planted, folder):
    docs, toxic, leaks, _ = planted
    stage, now, left = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{folder}/documents.parquet"), docs

    def step(name, df):
        out = stage[name](spark, df, folder).cache()
        assert name == "tokens" or out.columns == df.columns
        return out, [tuple(r) for r in out.collect()]

    order = lambda rows: sorted(rows, key=repr)
    now, got = step("toxicity", now)
    left = [r for r in left if r[0] not in toxic]
    assert order(got) == order(left)
    now, got = step("near_duplicates", now)
    kept = {d for _, d in brute_kept([(r[0], r[1]) for r in left])}
    left = [r for r in dict.fromkeys(left) if r[0] in kept]
    assert order(got) == order(left) and len(left) < len(docs) - len(toxic) - 10
    now, got = step("decontamination", now)
    left = [r for r in left if r[0] not in leaks]
    assert order(got) == order(left)
    _, got = step("mixing", now)
    size = lambda t: len(WORD.findall(t or ""))
    names = sorted({r[3] for r in left if r[3] is not None}) + [None]
    sizes = [sum(size(r[1]) for r in left if r[3] == x) for x in names]
    aims = shares(sizes, [(1.0, 2.0, 3.0)[i % 3] for i in range(len(names))])
    words = {x: n for x, n in zip(names, seats_by_quotients(aims, round(sum(aims)), [3 * s for s in sizes]), strict=True)}
    whole = {r[0]: r[1] for r in left}
    for x in names:
        assert sum(size(r[1]) for r in got if r[3] == x) == words[x]
    for r in got:
        text = " ".join(WORD.findall(whole[r[0]]))
        assert " ".join(WORD.findall(r[1])) in f"{text} {text}" and r[4] == len(r[1])


def test_run(spark, planted, folder):
    """The rows of run(): the mix's documents as the tokenizer has them, in order of their ids."""
    docs, toxic, leaks, _ = planted
    out = corpus_pipeline.run(spark, folder).collect()
    kept = {r["doc_id"] for r in out}
    near = {d for _, d in brute_kept([(r[0], r[1]) for r in docs if r[0] not in toxic])}
    assert kept <= near - toxic - leaks
    rows = sorted(out, key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    encode, text = tokens.TextEncoder(tokens.default_tokenizer()).tokenizer.encode, {r[0]: r[1] for r in docs}
    whole = {d: zlib.crc32(np.array([*encode(text[d], add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for d in kept}
    copies = [r for r in rows if r["ids_crc32"] == whole[r["doc_id"]]]
    assert len(copies) > 30  # whole passes; the others are parts of their document
    for r in rows:
        assert r["n_tokens"] <= len(encode(text[r["doc_id"]], add_special_tokens=False).ids) + 3


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_budget_of_planted_passages(planted):
    """What is planted above is within what the operator promises: whole items, or 120 characters word for word."""
    *_, items = planted
    assert all(len(decontaminate.normal(t)) > 130 for _, t in items if t) and 120 >= decontaminate.PASSAGE + decontaminate.STEP - 1
