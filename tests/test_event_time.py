"""As-of by event time: every order of arrival within the delay gives the batch join."""

import random

import numpy as np
import pandas as pd
import pytest

from cirrostrat.operators import tracks
from cirrostrat.streaming import eventtime
from cirrostrat.streaming import frames as S
from cirrostrat.streaming.eventtime import latest_imu_by_time

SCHEMA = "sensor_id long, ts_ns long, frame_id long, accel_x double, accel_y double, accel_z double"
SECOND = 1_000_000_000
FLUSH = [(99, 10_000 * SECOND, None, 0.0, 0.0, 0.0)], [(99, 20_000 * SECOND, None, 0.0, 0.0, 0.0)]


def history(rng, n=120):
    rows, t = [], 50 * SECOND
    for k in range(n):
        t += rng.choice([0, 1, 999, 1_000, 999_999, 1_000_000, rng.randrange(SECOND)])
        sensor = rng.randrange(3)
        rows.append((sensor, t, k, None, None, None) if rng.random() < 0.5 else (sensor, t, None, rng.random(), float(k), 1.0))
    return rows


def streamed(spark, folder, parts, grain_ms=1_000):
    for n, rows in enumerate([*parts, *FLUSH]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    name = f"asof_{folder.name}".replace("-", "_")
    query = S.available(latest_imu_by_time(source, "20 seconds", grain_ms).writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "cp")), spark)
    assert query.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def batch(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    found = tracks.latest_imu(df.where("frame_id is not null").select("sensor_id", "ts_ns", "frame_id"), df.where("frame_id is null"))
    return sorted(found.select("sensor_id", "frame_id", "ts_ns", "accel_x", "accel_y", "accel_z").collect(), key=str)


@pytest.mark.parametrize("seed, grain", [(1, 1), (2, 1_000)])
def test_any_arrival_within_the_delay_is_the_batch_join(spark, tmp_path, seed, grain):
    rng = random.Random(seed)
    rows = history(rng)
    # a device's time twice would leave the choice open in the batch join
    seen, own = set(), []
    for r in rows:
        if r[2] is not None or (r[0], r[1]) not in seen:
            own.append(r)
            seen |= {(r[0], r[1])} if r[2] is None else set()
    late = sorted(own, key=lambda r: r[1] + rng.randrange(15 * SECOND))
    cut = [late[i : i + 40] for i in range(0, len(late), 40)]
    assert sorted(streamed(spark, tmp_path, cut, grain), key=str) == [tuple(r) for r in batch(spark, own)]


def test_rows_beyond_the_delay_and_odd_rows(spark, tmp_path):
    first = [(1, 100 * SECOND, 0, None, None, None), (1, 99 * SECOND, None, 1.0, 1.0, 1.0), (1, 99 * SECOND, None, 2.0, 1.0, 1.0), (None, 100 * SECOND, 7, None, None, None), (1, None, 8, None, None, None), (1, 99 * SECOND + 5, None, None, 1.0, 1.0)]
    second = [(1, 300 * SECOND, 1, None, None, None)]
    third = [(1, 301 * SECOND, 2, None, None, None), (1, 301 * SECOND, 2, None, None, None)]
    # the watermark has passed this one
    last = [(1, 200 * SECOND, None, 9.0, 9.0, 9.0), (2, 302 * SECOND, 3, None, None, None)]
    got = streamed(spark, tmp_path, [first, second, third, last])
    assert sorted(got, key=str) == sorted([(1, 0, 100 * SECOND, 2.0, 1.0, 1.0), (1, 1, 300 * SECOND, 2.0, 1.0, 1.0), (1, 2, 301 * SECOND, 2.0, 1.0, 1.0), (1, 2, 301 * SECOND, 2.0, 1.0, 1.0), (2, 3, 302 * SECOND, None, None, None)], key=str)


class Held:
    """A state of the store, in memory, that counts its calls."""

    def __init__(self, calls):
        self.rows, self.calls = {}, calls

    def _call(self, f):
        self.calls.append(f)

    def exists(self):
        return None in self.rows

    def get(self):
        self._call("get")
        return self.rows[None]

    def update(self, row):
        self._call("update")
        self.rows[None] = row

    def clear(self):
        self.rows.clear()

    def containsKey(self, k):
        self._call("containsKey")
        return k in self.rows

    def getValue(self, k):
        self._call("getValue")
        return self.rows[k]

    def updateValue(self, k, row):
        self._call("updateValue")
        self.rows[k] = row

    def removeKey(self, k):
        self._call("removeKey")
        self.rows.pop(k, None)

    def keys(self):
        return iter(list(self.rows))

    def iterator(self):
        return iter(list(self.rows.items()))


class Handle:
    def __init__(self):
        self.calls, self.timers = [], set()
        self.getValueState = self.getMapState = lambda *_: Held(self.calls)
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard
        self.listTimers = lambda: list(self.timers)


class Times:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


@pytest.mark.parametrize("part", [3, 4096])
def test_state_is_read_by_parts(monkeypatch, part):
    """Thousands of rows with a time each, in pieces that overlap: the batch join, with few calls to the state."""
    monkeypatch.setattr(eventtime, "PART", part)
    rng, n = random.Random(part), 6_000
    rows = pd.DataFrame({"due": np.arange(n) // 3 * 1_000, "ts": np.arange(n), "frame": [k if rng.random() < 0.5 else -1 for k in range(n)], **{a: [rng.random() for _ in range(n)] for a in "xyz"}})
    piece = np.array([int(k / n * 3 + rng.random() * 0.2) for k in range(n)]).clip(0, 2)
    handle, machine, out = Handle(), eventtime._AsOf(), []
    machine.init(handle)
    for k in range(3):
        mine = rows[piece == k].sample(frac=1, random_state=k)
        list(machine.handleInputRows((7,), iter([mine[:500], mine[500:]]), None))
        until = (k + 1) * n // 3 * 1_000 // 3 * 4 // 5 if k < 2 else n * 1_000
        while handle.timers and min(handle.timers) <= until:
            at = min(handle.timers)
            handle.timers.discard(at)
            out += list(machine.handleExpiredTimer((7,), Times(until), Times(at)))
    found = pd.concat(out)
    now, want = (None,) * 3, []
    for r in rows.itertuples():
        if r.frame < 0:
            now = (r.x, r.y, r.z)
        else:
            want.append((7, r.frame, r.ts, *now))
    assert [tuple(None if pd.isna(v) else v for v in r) for r in found.itertuples(index=False)] == want
    assert part < 100 or len(handle.calls) < 100
