"""Histories cut into slices give what plain loops over them give, whatever the size of a slice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrostrat.operators import frames, tracks


@pytest.fixture(scope="module")
def history(spark):
    """Two sensors, numbers with gaps, counts that fall at random; and the same rows by sensor, in order."""
    rng = np.random.default_rng(11)
    rows = [(s, int(q), int(rng.integers(0, 6)), int(q) // 9 % 4 + s) for s in (1, 2) for q in np.sort(rng.choice(140, 90, replace=False))]
    shuffled = [rows[i] for i in rng.permutation(len(rows))]
    return spark.createDataFrame(shuffled, "sensor_id long, capture_seq long, pkt_cnt int, header_frame_id int").cache(), [[r for r in rows if r[0] == s] for s in (1, 2)]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_frames(history, size):
    table, sensors = history
    counted, members, numbered, changed = set(), set(), set(), set()
    for own in sensors:
        ordinal, before, marks = 0, None, []
        for s, q, c, _ in own:
            fell = before is not None and c < before
            ordinal += fell
            marks.append((s, q, fell or before is None, ordinal))
            before = c
        counted |= set(marks)
        members |= {(s, q, o) for s, q, b, o in marks if o < ordinal and not (b and o > 0)}
        changed |= {(s, q) for i, (s, q, c, _) in enumerate(own) if i == 0 or own[i - 1][2] != c}
        ordinal, before, marks = 0, 0, []
        for s, q, _, f in own:
            ordinal += f != before
            marks.append((s, q, ordinal, f))
            before = f
        first = {o: f for _, _, o, f in reversed(marks)}
        numbered |= {(s, q, o, f, first.get(o + 1), o + 1 in first) for s, q, o, f in marks}
    got = lambda df: {tuple(r) for r in df.collect()}
    assert got(frames.boundaries(table, size=size).select("sensor_id", "capture_seq", "boundary", "ordinal")) == counted
    assert got(frames.assemble_counted(table, size=size)) == members
    assert got(frames.assemble_numbered(table, size=size)) == numbered
    assert got(tracks.changes(table, "sensor_id", "capture_seq", ("pkt_cnt",), size).select("sensor_id", "capture_seq")) == changed


@pytest.mark.parametrize("size", [3, 10_000])
def test_latest_imu(spark, history, size):
    _, sensors = history
    imu = [(s, q, float(c)) for own in sensors for s, q, c, _ in own[5::7]]
    asked = [(s, t) for s in (1, 2, 3) for t in range(0, 150, 4)]
    want = {(s, t, max(((q, v) for k, q, v in imu if k == s and q <= t), default=(None, None))[1]) for s, t in asked}
    got = tracks.latest_imu(spark.createDataFrame(asked, "sensor_id long, ts_ns long"), spark.createDataFrame(imu, "sensor_id long, ts_ns long, accel_x double"), columns=("accel_x",), size=size)
    assert {tuple(r) for r in got.collect()} == want


def test_empty_and_null(spark, history):
    """No rows give none; rows without sensor or order are in no frame."""
    table, _ = history
    assert frames.assemble_numbered(table.limit(0)).count() == 0 and tracks.changes(table.limit(0), "sensor_id", "capture_seq", ("pkt_cnt",)).count() == 0
    odd = table.union(table.limit(1).withColumn("sensor_id", F.lit(None).cast("long"))).union(table.limit(1).withColumn("capture_seq", F.lit(None).cast("long")))
    assert frames.boundaries(odd).count() == table.count()
