"""The mix against a plain model of its steps, with shards, groups of shards and a null source."""

import random
import re

import numpy as np
import pytest

from cirrostrat.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def seats_by_quotients(votes, seats, most):
    given = [0] * len(votes)
    for _ in range(seats):
        best = max(((v / (2 * g + 1), -i) for i, (v, g, m) in enumerate(zip(votes, given, most, strict=True)) if v and g < m), default=None)
        if best is None:
            break
        given[-best[1]] += 1
    return given


def shares(sizes, weights):
    """Targets by many small steps: raise every open source by weight until the words are given out."""
    low, high, total = 0.0, 1e9, sum(sizes)
    for _ in range(200):
        mid = (low + high) / 2
        given = sum(min(mid * w, 3 * s) for s, w in zip(sizes, weights, strict=True))
        low, high = (mid, high) if given < total else (low, mid)
    return [min(high * w, 3 * s) for s, w in zip(sizes, weights, strict=True)]


@pytest.fixture
def rows():
    rng = random.Random(12)
    made = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 30))), rng.choice(["a", "a", "a", "b", "é", None])) for i in range(400)]
    return made + [(None, "no id here", "b"), (7, "again", "a"), (7, "again", "a"), (500, None, "a"), (501, "", "z")]


def test_mix_is_the_model(spark, monkeypatch, rows):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 20)
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    size = lambda t: len(WORD.findall(t or ""))
    sizes = [sum(size(t) for _, t, s in rows if s == x) for x in names]
    aims = shares(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    blocks = seats_by_quotients(aims, round(sum(aims)), [3 * s for s in sizes])
    got = mixing.mix(docs).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "", r["source"] or "") for r in got) == sorted((d or -1, t or "", s or "") for d, t, s in rows)
    for x, n, aim, taken in zip(names, sizes, aims, blocks, strict=True):
        own = [r for r in got if r["source"] == x]
        assert {r["__source_size"] for r in own} == {n} and all(abs(r["__target"] - aim) < 1e-3 for r in own)
        assert sum(r["__taken"] for r in own) == taken and all(0 <= r["__taken"] <= 3 * r["__size"] for r in own)
    assert {(r["doc_id"], r["text"], r["__taken"]) for r in mixing.mix(docs).collect()} == {(r["doc_id"], r["text"], r["__taken"]) for r in got}
    # within a shard every document is taken alike, but for the run of blocks at one place
    marked = {(r["__no"], r["__shard"]): 0 for r in mixing._numbered(docs, mixing.SEED).select("__no", "__shard").distinct().collect()}
    assert len(marked) > 20
    for x in names:
        times = [r["__taken"] / r["__size"] for r in got if r["source"] == x and r["__size"]]
        assert not times or max(times) - min(times) <= 2


def test_groups_share_their_blocks(spark, monkeypatch):
    """Seats of shards by groups: those of a group add up to the group's, and all to the source's."""
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 4)
    rng = np.random.default_rng(2)
    totals = spark.createDataFrame([(k, sh, int(n)) for k in range(3) for sh, n in enumerate(rng.integers(0, 3000, 11))], "__no int, __shard int, n long")
    own = {r[0]: r for r in mixing.source_quotas(totals)}
    plan = mixing.quotas(totals).toPandas()
    assert len(plan) == 33
    for k, part in plan.groupby("__src"):
        words = (part["__passes"] * part["__z"] + part["__rest"]).sum()
        assert words == own[k][3] * own[k][4]
