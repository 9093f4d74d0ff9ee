"""The frame machine by slices against the machine itself."""

import random

from cirrostrat.operators import machine
from cirrostrat.operators.frames import FrameMachine, assemble_counted


def whole(rows):
    """{order: frame} by the machine, packet by packet."""
    m, out = FrameMachine(), {}
    for o, c, n in rows:
        if done := m.feed(o, c, n):
            out |= dict.fromkeys(done[1], done[0])
    return out


def by_slices(rows, size):
    parts = {}
    for r in rows:
        parts.setdefault(r[0] // size, []).append(r)
    parts = [([c for _, c, _ in p], [n for *_, n in p], [o for o, *_ in p]) for _, p in sorted(parts.items())]
    summaries = [[(w.frames, w.fresh, w.last, w.points, w.head) for w in (machine.walk(c, n, e) for e in range(4))] for c, n, _ in parts]
    plan = machine.compose([c[0] for c, _, _ in parts], summaries)
    return {o: int(f) for (c, n, os), at in zip(parts, plan, strict=True) for o, f in zip(os, machine.members(c, n, *at), strict=True) if f >= 0}


def sequence(rng, n):
    """Counts that fall often, also twice in a row, and packets without points."""
    kind, empty = rng.randrange(3), rng.choice([0.0, 0.3, 0.9])
    count, out, o = 0, [], 0
    for _ in range(n):
        count = rng.randrange(4) if kind == 0 else 0 if rng.random() < 0.25 else count + rng.randrange(2) if kind == 1 else max(0, count + rng.randrange(-2, 3))
        out.append((o, count, 0 if rng.random() < empty else rng.randrange(1, 5)))
        o += rng.randrange(1, 3)
    return out


def test_any_slices_give_the_machine_s_frames():
    rng = random.Random(1)
    for _ in range(3_000):
        rows = sequence(rng, rng.randrange(1, 40))
        assert by_slices(rows, rng.choice([1, 2, 3, 7, 20, 1_000])) == whole(rows)


def test_in_spark(spark):
    rng = random.Random(2)
    per = {s: sequence(rng, 60) for s in ("a", "b")}
    rows = [(s, *r, "extra") for s, rs in per.items() for r in rs] + [(None, 1, 1, 1, "x"), ("a", None, 1, 1, "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "sensor_id string, capture_seq long, pkt_cnt int, n_points int, first string")
    got = {(r.sensor_id, r.capture_seq): r.frame_id for r in assemble_counted(df, exact=True, size=13).collect()}
    assert got == {(s, o): f for s, rs in per.items() for o, f in whole(rs).items()}
    assert assemble_counted(df.limit(0), exact=True).collect() == []
