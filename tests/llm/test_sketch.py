"""Scaled sketches and edited texts against plain Python."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from cirrostrat.llm import sketch

SCHEMA = "doc_id long, text string"
PROSE = "the river took old stones down to a quiet bay where boats lay still and gulls cried over nets".split()


def prose(rng, n):
    return " ".join(rng.choice(PROSE) + str(rng.randrange(30)) for _ in range(n))


def shingle(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h >> 1


def hashes(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {shingle(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def lowest(found, scale=sketch.SCALE):
    return sorted(h for h in found if h < 2**63 // scale) or ([min(found)] if found else [])


def contained(a, b):
    return len(set(a) & set(b)) / len(a) if a else float(not b)


def brute(rows):
    key = lambda r: hashlib.sha256(f"{'-' if r[0] is None else r[0]}:{r[1]}".encode()).digest()
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), key(r)))
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 3
        changed = text[: len(text) - cut] + after[:cut]
        a, b, c = (lowest(hashes(t)) for t in (text, changed, after))
        name = lambda s: "".join(f"{h:016x}" for h in s)
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), name(a), name(b), contained(a, b), contained(a, c)))
    return sorted(out, key=str)


def test_against_plain_python(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", " \t\n", "one", "  lead and trail  ", "żółw \U0001f600 漢字 x", prose(rng, rng.randrange(1, 300))])) for i in rng.sample(range(-50, 500), 120)]
    got = sketch.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_null_and_repeated_ids_and_repeated_rows(spark):
    rng = random.Random(2)
    rows = [(None, prose(rng, 30)) for _ in range(6)] + [(4, prose(rng, 50))] * 5 + [(4, prose(rng, 20)), (4, None), (4, None), (9, prose(rng, 40))] + [(None, None)] * 3
    got = sketch.fingerprints(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "alone in the world with some more words")], [(1, None)], [(2, "a b c d e f"), (1, "b c d e f g")]])
def test_few_rows(spark, rows):
    got = sketch.fingerprints(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_long_text_and_clashing_columns(spark):
    rng = random.Random(3)
    rows = [(1, prose(rng, 200_000)), (2, "w" * 500_000), (3, prose(rng, 40))]
    extra = {c: F.lit(7) for c in ("key", "n", "n_chars", "count", "copy", "again", "need", "to", "piece", "sketch", "next_sketch", "edited", "__rank", "__size", "__at", "__h")}
    got = sketch.fingerprints(spark.createDataFrame(rows, SCHEMA).withColumns(extra))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_merged_sketches_are_those_of_all_shingles(spark):
    rng = random.Random(4)
    texts = [(rng.randrange(6), rng.choice(["few words here", prose(rng, rng.randrange(1, 60)), ""])) for _ in range(60)]
    each = spark.createDataFrame(texts, "g int, text string").select("g", sketch.sketch(F.col("text")).alias("sketch"))
    want = {}
    for g, text in texts:
        want.setdefault(g, set()).update(hashes(text))
    assert {r.g: r.sketch for r in sketch.merged(each, ["g"]).collect()} == {g: lowest(s) for g, s in want.items()}


def test_containment_between_unequal_documents(spark):
    rng = random.Random(5)
    part, rest = prose(rng, 3_000), prose(rng, 60_000)
    df = spark.createDataFrame([(part, f"{rest} {part}", prose(rng, 3_000))], "a string, b string, c string").select(*(sketch.sketch(F.col(c)).alias(c) for c in "abc"))
    row = df.select(sketch.containment(F.col("a"), F.col("b")).alias("ab"), sketch.containment(F.col("b"), F.col("a")).alias("ba"), sketch.containment(F.col("a"), F.col("c")).alias("ac"), sketch.resemblance(F.col("a"), F.col("a")).alias("aa"), (sketch.hashes(sketch.fingerprint(F.col("a"))) == F.col("a")).alias("back")).first()
    assert row.ab > 0.99 and abs(row.ba - 1 / 21) < 0.02 and row.ac < 0.05 and row.aa == 1 and row.back


def test_only_dataframe_functions(spark):
    found = sketch.fingerprints(spark.createDataFrame([(1, "a b c d e f"), (2, "g")], SCHEMA))
    plan = found._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapPartitions"))
