"""Smoothed heights by slices against one fold."""

import random

from cirrostrat.operators import ground


def history(rng, n):
    kind, level, out = rng.randrange(4), 1.5, []
    for _ in range(n):
        if kind == 0:
            level = rng.uniform(-1, 1)
        elif kind == 1:
            level += rng.uniform(-0.3, 0.3)
        elif kind == 2 and rng.random() < 0.1:
            level += rng.choice([-2.0, -0.5, 0.5, 2.0])
        out.append(None if rng.random() < 0.15 else level + rng.uniform(-0.02, 0.02))
    return out


def test_settled_is_what_any_start_comes_to():
    rng, known = random.Random(1), 0
    for _ in range(4_000):
        values = history(rng, rng.randrange(0, 150))
        sure, end = ground.settled(values)
        known += sure
        if sure:
            starts = [None, 0.0, 1e9, -1e9, *(v + d for v in [next(v for v in values if v is not None)] for d in (-0.5, -0.499999, -0.2, 0.0, 0.3, 0.499999, 0.5))]
            assert {ground.folded(values, s)[-1] for s in starts} == {end}
    assert known > 1_000
    assert ground.settled([]) == (False, None) and ground.settled([1.0]) == (False, None) and ground.settled([1.0, 2.0]) == (True, 2.0)


def test_any_slices_give_the_fold(spark):
    rng = random.Random(2)
    per = {s: history(rng, 150) for s in range(4)}
    df = spark.createDataFrame([(s, f, v, "x") for s, vs in per.items() for f, v in enumerate(vs)], "sensor_id long, frame_id long, detected double, note string")
    want = {(s, f): v for s, vs in per.items() for f, v in enumerate(ground.folded(vs, None))}
    for size in (7, 60):
        assert {(r.sensor_id, r.frame_id): r.smooth for r in ground.smoothed(df, size=size).collect()} == want
    assert ground.smoothed(df).columns == ["sensor_id", "frame_id", "detected", "note", "smooth"]
