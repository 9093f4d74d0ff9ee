"""Manifest trees, proofs and folds against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cirrostrat.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        row = out[-1]
        out.append([h(*row[i : i + 2]) for i in range(0, len(row), 2)])
    return out


def proof(tree, i):
    out = []
    for row in tree[:-1]:
        out.append(row[i ^ 1] if i ^ 1 < len(row) else None)
        i //= 2
    return out


def fold(node, i, siblings):
    for s in siblings:
        node = h(node) if s is None else h(s, node) if i % 2 else h(node, s)
        i //= 2
    return node


def brute(rows):
    made = [(r[0], r[2], h(*map(field, r)), h(*map(field, (*r[:3], None if r[3] is None else r[3] + 1, r[4])))) for r in rows]
    groups = {}
    for id_, lang, leaf, other in made:
        groups.setdefault(lang, []).append((id_ is not None, id_ or 0, leaf, id_, other))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: r[:3])
    trees = {g: levels([r[2] for r in groups[g]]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        above = proof(top, k)
        for i, (_, _, leaf, id_, other) in enumerate(groups[g]):
            path = proof(trees[g], i)
            start = other if id_ is not None and zlib.crc32(str(id_).encode()) % 7 == 0 else leaf
            root = fold(fold(start, i, path), k, above)
            out.append((id_, leaf, trees[g][-1][0], top[-1][0], h(*(s for s in path + above if s)), root, root == top[-1][0]))
    return sorted(out, key=str)


def corpus(n, langs, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["web", None, "böökß"]), rng.choice(langs), rng.choice([None, rng.randrange(10**6)]), rng.choice([None, "", "x" * rng.randrange(40), "zé\U0001f600 line\n"])) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("tier", [1, 8])
def test_against_plain_python(spark, tier):
    rows = corpus(150, ["en", "de", None, "", "\U00010400", "�", "-"]) + [(9_999, "a", "lone", 1, "one leaf")]
    got = merkle.digests(spark.createDataFrame(rows, SCHEMA).repartition(5), tier)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 9])
def test_sizes_of_one_group(spark, n):
    rows = corpus(n, ["en"], n)
    got = merkle.digests(spark.createDataFrame(rows, SCHEMA), 2)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_many_groups_of_one(spark):
    rows = [(i, "s", f"l{i}", i, "t") for i in range(21)]
    assert sorted(map(tuple, merkle.digests(spark.createDataFrame(rows, SCHEMA), 2).collect()), key=str) == brute(rows)


def test_null_and_repeated_ids_repeated_rows_and_long_texts(spark):
    rows = [(None, "s", "en", i, f"t{i}") for i in range(9)] + [(7, "s", "en", 1, "same")] * 6 + [(7, None, "en", 2, "other"), (8, "s", "en", 3, "long " * 400_000)]
    got = merkle.digests(spark.createDataFrame(rows, SCHEMA), 2)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert merkle.digests(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = corpus(12, ["en", "de"])
    extra = {c: F.lit(5) for c in ("id", "group", "place", "n", "node", "level", "row", "root", "subroot", "leaf", "siblings", "__at", "__part", "__rank", "__size", "__n", "block", "top_place", "tampered", "verified")}
    got = merkle.digests(spark.createDataFrame(rows, SCHEMA).withColumns(extra), 2)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_a_changed_value_is_found_by_its_proof_alone(spark):
    """Each leaf folds to the root over its own siblings; another leaf at its place doesn't."""
    docs = spark.createDataFrame(corpus(40, ["en", "de"]), SCHEMA)
    found = merkle.proofs(merkle.manifest(docs, merkle.document_leaf(F.col("n_chars")), tier=2), 2)
    up = lambda start: merkle.folded(merkle.folded(start, F.col("place"), F.col("n"), F.col("siblings")), F.col("top_place"), F.col("top_n"), F.col("top_siblings"))
    row = found.select(F.sum((up(F.col("node")) == F.col("root")).cast("int")).alias("good"), F.sum((up(merkle.digest(F.lit("no"))) == F.col("root")).cast("int")).alias("bad")).first()
    assert (row.good, row.bad) == (40, 0)
