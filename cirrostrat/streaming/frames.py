"""Stateful streams: frame assembly, smoothed heights, latest values, sinks.

State is keyed by sensor and kept by Spark; within a micro-batch rows are put in capture order. State of a sensor that
falls silent is dropped after ``idle`` (an extension: the reference keeps state for ever).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cirrostrat.operators.frames import FrameMachine
from cirrostrat.operators.ground import smooth_step


def assemble_stream(headers: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """Frame membership of a header stream (sensor_id long, capture_seq long, pkt_cnt int, n_points int): rows
    sensor_id, frame_id, capture_seq of frames as they complete."""
    ms = _ms(idle)

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        at = list(state.get) if state.exists else [0, 65535, True, False, [], 0]
        machine, out = FrameMachine(at[0], at[1], at[2], at[3], list(at[4]), at[5]), []
        for o, c, n in pd.concat(list(batches)).sort_values("capture_seq")[["capture_seq", "pkt_cnt", "n_points"]].itertuples(index=False):
            if done := machine.feed(int(o), int(c), int(n)):
                out += [(key[0], done[0], p) for p in done[1]]
        state.update((machine.frame_id, machine.last, machine.first, machine.fresh, machine.parts, machine.points))
        state.setTimeoutDuration(ms)
        yield pd.DataFrame(out, columns=["sensor_id", "frame_id", "capture_seq"])

    return headers.groupBy("sensor_id").applyInPandasWithState(run, "sensor_id long, frame_id long, capture_seq long", "frame_id long, last int, first boolean, fresh boolean, parts array<long>, points long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def smooth_stream(heights: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """Smoothed ground heights of a stream (sensor_id long, frame_id long, detected double)."""
    ms = _ms(idle)

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        now, out = (state.get[0] if state.exists else None), []
        for f, v in pd.concat(list(batches)).sort_values("frame_id")[["frame_id", "detected"]].itertuples(index=False):
            now = smooth_step(now, None if pd.isna(v) else float(v))
            out.append((key[0], int(f), now))
        if now is not None:
            state.update((now,))
        elif not state.exists:
            state.update((None,))
        state.setTimeoutDuration(ms)
        yield pd.DataFrame(out, columns=["sensor_id", "frame_id", "smooth"])

    return heights.groupBy("sensor_id").applyInPandasWithState(run, "sensor_id long, frame_id long, smooth double", "smooth double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def numbered_stream(headers: DataFrame, idle: str = "10 minutes", initial: int = 0) -> DataFrame:
    """Frames of a header stream (sensor_id long, capture_seq long, header_frame_id int) as they complete: sensor_id,
    ordinal, frame_id, emitted_frame_id, capture_seq. The state is the open run: its packets' places, no pixels."""

    def step(key, at, pdf):
        ordinal, number, parts = (at[0], at[1], list(at[2])) if at else (0, initial, [])
        out = []
        for o, f in pdf[["capture_seq", "header_frame_id"]].itertuples(index=False):
            if f != number:
                out += [(key, ordinal, number, int(f), p) for p in parts]
                ordinal, number, parts = ordinal + 1, int(f), []
            parts.append(int(o))
        return (ordinal, number, parts), out

    return _stateful(headers, "capture_seq", "sensor_id long, ordinal long, frame_id int, emitted_frame_id int, capture_seq long", "ordinal long, number int, parts array<long>", idle, step)


def latest_imu_stream(rows: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """Frames with the acceleration last heard of: ``rows`` (sensor_id long, ts_ns long, frame_id long, accel_x, accel_y,
    accel_z double) holds the device's rows (frame_id null) and the frames' own; frames come out, in order of time. What
    arrives in a later micro-batch is taken as later."""
    names = ["accel_x", "accel_y", "accel_z"]

    def step(key, at, pdf):
        now, out = tuple(at) if at else (None, None, None), []
        # of equal times the device's row comes first
        for t, f, *v in pdf.assign(late=pdf["frame_id"].notna()).sort_values(["ts_ns", "late"])[["ts_ns", "frame_id", *names]].itertuples(index=False):
            if pd.isna(f):
                now = now if any(pd.isna(x) for x in v) else tuple(map(float, v))
            else:
                out.append((key, int(f), int(t), *now))
        return now, out

    return _stateful(rows, "ts_ns", "sensor_id long, frame_id long, ts_ns long, accel_x double, accel_y double, accel_z double", "x double, y double, z double", idle, step)


def changes_stream(rows: DataFrame, columns: tuple[str, ...], idle: str = "10 minutes") -> DataFrame:
    """Places (sensor_id long, capture_seq long) and values (``now``, JSON of ``columns``) of a stream's rows whose columns
    differ from those of the row before of their sensor; its first row included."""
    own = rows.select("sensor_id", "capture_seq", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("now"))

    def step(key, at, pdf):
        before, out = at[0] if at else None, []
        for o, now in pdf[["capture_seq", "now"]].itertuples(index=False):
            if now != before:
                out.append((key, int(o), now))
            before = now
        return (before,), out

    return _stateful(own, "capture_seq", "sensor_id long, capture_seq long, now string", "now string", idle, step)


def _stateful(rows: DataFrame, order: str, out: str, kept: str, idle: str, step: Callable) -> DataFrame:
    """``step(sensor, state or None, rows of a micro-batch in order) -> (state, rows)`` for each sensor."""
    ms, names = _ms(idle), [f.split()[0] for f in out.split(", ")]

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        now, found = step(int(key[0]), state.get if state.exists else None, pd.concat(list(batches)).sort_values(order, kind="stable"))
        state.update(now)
        state.setTimeoutDuration(ms)
        yield pd.DataFrame(found, columns=names)

    return rows.where("sensor_id is not null").groupBy("sensor_id").applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


def _ms(text: str) -> int:
    n, unit = text.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]


def first_seen_stream(packets: DataFrame, key: str = "src_ip") -> DataFrame:
    """The first packet of each sender, ever."""
    return packets.dropDuplicates([key])


def with_event_time(packets: DataFrame, ts: str = "ts_ns", delay: str = "10 seconds") -> DataFrame:
    """``packets`` with event_time and a watermark, for state expiry."""
    return packets.withColumn("event_time", F.timestamp_micros(F.expr(f"{ts} div 1000"))).withWatermark("event_time", delay)


def static_transform_stream(spark: SparkSession, transform: DataFrame) -> DataFrame:
    """The transform once a second."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().join(F.broadcast(transform))


def to_tables(packets: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]], folder: str, checkpoint: str, available_now: bool = True):
    """Write each sink's view of every micro-batch as Parquet under ``folder/name``; a batch that is tried again
    replaces its own part."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for name, view in sinks.items():
            view(batch).write.mode("overwrite").parquet(f"{folder}/{name}/epoch={epoch}")
        batch.unpersist()

    writer = packets.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return available(writer, packets.sparkSession) if available_now else writer.start()


def available(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Start a stream over what is there now. Plans with timeouts ask for another batch without data for ever, so such
    batches are off for this query: it ends, and keeps its state for the next run."""
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)
