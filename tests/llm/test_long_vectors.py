"""Vectors that a 64-bit code can't hold."""

import random

import pytest

from cirrostrat.llm import search


def test_longer_vectors_are_an_error(spark):
    code = lambda v: spark.createDataFrame([(v,)], "embedding array<float>").select(search.code(search.F.col("embedding"))).first()[0]
    assert code([1.0] * 64) == -1 and code([-1.0, 1.0]) == 2 and code(None) is None and code([1.0, None]) is None
    with pytest.raises(Exception, match="64 bits"):
        code([1.0] * 64 + [-1.0])


def test_codes_of_several_words(spark):
    df = spark.createDataFrame([(1, [1.0] * 65), (2, [-1.0] * 100 + [1.0]), (3, []), (4, None), (5, [1.0, None])], "id long, embedding array<float>")
    assert search.width(df) == 128 and search.width(df.where("id > 2")) == 64
    assert [tuple(r[0]) if r[0] else None for r in df.orderBy("id").select(search.code(search.F.col("embedding"), 128)).collect()] == [(-1, 1), (0, 1 << 36), (0, 0), None, None]
    with pytest.raises(Exception, match="128 bits"):
        df.select(search.code(search.F.concat("embedding", "embedding"), 128)).collect()


@pytest.mark.parametrize("dims", [100, 150])
def test_wide_codes_against_brute_force(spark, dims):
    """Groups of near vectors and some apart, copies among them; 150 dimensions make segments that cross words."""
    rng, rows = random.Random(dims), []
    for group in range(12):
        centre = [rng.choice([-1.0, 1.0]) for _ in range(dims)]
        for _ in range(25):
            rows.append([-v if rng.random() < 0.02 * (group % 3) else v for v in centre])
    rows += [[rng.choice([-1.0, 1.0]) for _ in range(dims - 1)] for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, embedding array<float>")
    codes = df.select("id", search.code(search.F.col("embedding"), search.width(df)).alias("code"))
    asked = [7, 120, 299, 310]
    got = {}
    for r in search.top_k(codes, codes.where(search.F.col("id").isin(asked)).withColumnRenamed("id", "query_id"), 10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["distance"], r["id"])
    signs = [[v > 0 for v in r] + [False] * (dims - len(r)) for r in rows]
    for q in asked:
        want = sorted((sum(a != b for a, b in zip(signs[q], s, strict=True)), i) for i, s in enumerate(signs))[:10]
        assert [got[q][k] for k in range(1, 11)] == want
    parts = search.segments(320, search.width(df))
    assert sum(w for _, w in parts) == search.width(df) and max(w for _, w in parts) <= 32
