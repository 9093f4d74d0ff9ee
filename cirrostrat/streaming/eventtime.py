"""As-of values by event time: rows wait for the watermark, so those that come late within the delay still count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cirrostrat.streaming.frames import with_event_time
from cirrostrat.streaming.live import ready

_OUT = "sensor_id long, frame_id long, ts_ns long, accel_x double, accel_y double, accel_z double"
_AXES = ("x", "y", "z")
_KEPT = ("due", "ts", "frame", *_AXES)
#: Rows that a task reads of a sensor's state at a time.
PART = 4096


class _AsOf(StatefulProcessor):
    """A sensor's rows that wait, in parts of up to ``PART`` rows sorted by the time that the watermark must reach, and the last
    value given on. One timer, at the earliest such time. ``parts`` has a row a part; their rows are read when they are due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "x double, y double, z double")
        self.timer = handle.getValueState("timer", "due long")
        self.next = handle.getValueState("next", "part long")
        self.parts = handle.getMapState("parts", "part long", "due long")
        self.waiting = handle.getMapState("waiting", "part long", "due array<long>, ts array<long>, frame array<long>, x array<double>, y array<double>, z array<double>")

    def _put(self, rows: pd.DataFrame) -> None:
        """Keep rows, sorted by due."""
        part = self.next.get()[0] if self.next.exists() else 0
        for start in range(0, len(rows), PART):
            some = rows.iloc[start : start + PART]
            self.waiting.updateValue((part,), tuple(some[c].tolist() for c in _KEPT))
            self.parts.updateValue((part,), (int(some["due"].iat[0]),))
            part += 1
        self.next.update((part,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([r[list(_KEPT)] for r in rows]).sort_values("due", kind="stable")
        self._put(pdf)
        first, known = int(pdf["due"].iat[0]), self.timer.get()[0] if self.timer.exists() else None
        if known is None or first < known:
            if known is not None:
                self.handle.deleteTimer(known)
            self._wake(first)
        return iter(())

    def _wake(self, due: int) -> None:
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        due = sorted((v[0], k[0]) for k, v in list(self.parts.iterator()) if v[0] <= until)
        now = self.last.get() if self.last.exists() else None
        held = pd.DataFrame(columns=list(_KEPT))
        for i, (_, part) in enumerate(due):
            more = pd.DataFrame(dict(zip(_KEPT, self.waiting.getValue((part,)), strict=True)))
            held = pd.concat([held, more]) if len(held) else more
            self.waiting.removeKey((part,))
            self.parts.removeKey((part,))
            # what no later part can precede
            end = due[i + 1][0] if i + 1 < len(due) else until + 1
            ready_ = held["due"] < end
            some, held = held[ready_], held[~ready_]
            if len(some):
                now, out = self._given(key[0], some, now)
                if len(out):
                    yield out
        if len(held):
            self._put(held.sort_values("due", kind="stable"))
        self.timer.clear()
        if rest := [v[0] for _, v in self.parts.iterator()]:
            self._wake(min(rest))
        if now is not None:
            self.last.update(tuple(now))

    @staticmethod
    def _given(sensor, rows: pd.DataFrame, now):
        """(the last value after ``rows``, their frames with the value at or before them)."""
        # of equal times the device's rows (frame -1) come first, and of those the greatest values last
        rows = rows.sort_values(["ts", "frame", *_AXES])
        device = (rows["frame"] < 0).to_numpy()
        seen = np.where(device, np.arange(len(rows)), -1)
        seen = np.maximum.accumulate(seen)
        out = {"sensor_id": sensor, "frame_id": rows["frame"].to_numpy()[~device], "ts_ns": rows["ts"].to_numpy()[~device]}
        at = seen[~device]
        for a, before in zip(_AXES, now or (None, None, None), strict=True):
            v = rows[a].to_numpy(dtype=object)
            found = np.full(len(at), before, dtype=object)
            found[at >= 0] = v[at[at >= 0]]
            out[f"accel_{a}"] = pd.Series(found, dtype="Float64" if pd.isna(found).any() else "float64")
        if seen[-1] >= 0:
            now = tuple(float(rows[a].iat[int(seen[-1])]) for a in _AXES)
        return now, pd.DataFrame(out)

    def close(self) -> None:
        pass


def latest_imu_by_time(rows: DataFrame, delay: str = "10 seconds", grain_ms: int = 1_000) -> DataFrame:
    """Frames with the acceleration at or before their time, whatever the order in which rows come within ``delay``.

    ``rows`` (sensor_id long, ts_ns long, frame_id long from 0 on, accel_x, accel_y, accel_z double) is a stream of device
    rows (frame_id null) and frames. Both wait in the state store until no row before them can come, so the result is that of
    ``tracks.latest_imu`` over all rows. State is the rows of one delay and a value a sensor. Rows are given out by spans of
    ``grain_ms``, and kept in parts of ``PART`` rows, the least that a task reads of a sensor's state.

    Rows later than the delay are dropped (those at or before the Unix epoch always are, as watermarks begin there), as are rows without sensor, time or (device rows) a whole acceleration; repeated
    frames come out as often as they came. Of device rows of one time the greatest acceleration counts. Frames of the
    last ``delay`` come out when later rows have moved the watermark on."""
    ready(rows.sparkSession)
    own = rows.where("sensor_id is not null and ts_ns is not null and (frame_id is not null or (accel_x is not null and accel_y is not null and accel_z is not null))")
    values = [F.coalesce(f"accel_{a}", F.lit(0.0)).alias(a) for a in _AXES]
    own = with_event_time(own, delay=delay).select("sensor_id", "event_time", "ts_ns", F.coalesce("frame_id", F.lit(-1)).cast("long").alias("frame"), F.col("ts_ns").alias("ts"), *values)
    # a row is late once the watermark is at its microsecond; with the watermark at the end of its span no other can come
    grain = 1_000 * grain_ms
    own = own.withColumn("due", F.expr(f"(ts_ns div 1000 + {grain - 1}) div {grain} * {grain_ms}"))
    return own.groupBy("sensor_id").transformWithStateInPandas(_AsOf(), _OUT, "append", "EventTime")
