"""Packets to packed clouds in one stream.

``whole_frames`` holds a sensor's open packets, payloads included, in Spark's state store and gives them out when their
frame is complete, so that a frame is never cut by a micro-batch. ``run`` then takes the frames of a micro-batch through
the operators of the batch plan: points, ground with the device's gravity, clusters, messages. What ground removal carries
from frame to frame, the smoothed height of each sensor, is a table an epoch in the output folder. So however the packets
are cut into micro-batches, the messages are those of ``plans.clouds`` over all of them.

State of a sensor is its open packets (a frame's at most), the counters of its frame machine, and the device packets that
an open frame may still see: the last one before it and those since. A timer drops the open frame of a sensor that is
silent for ``idle``; frame numbers go on. Packets of a sensor are taken in the order of ``capture_seq`` within a
micro-batch; those of a later one count as later. A sensor's packets of a micro-batch are held by one task: a backlog
should come in pieces (``PIECE`` packets of all sensors, by the source's own limits or as they land).

Spark turns adaptive plans off for a stream with state, and as many tasks as it has shuffle partitions start for each step of
a micro-batch. So a stream has no more of them than three for each core; a checkpoint keeps its number.

Streams need the state store that has timers and maps: ``ready`` sets it for the session.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cirrostrat.config import Settings
from cirrostrat.operators import decode, frames, geometry, pack
from cirrostrat.plans import clouds
from cirrostrat.sinks import log
from cirrostrat.streaming.frames import _ms, available

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What comes out: packets of whole frames; device packets as they come; those of earlier micro-batches that a frame sees.
PACKET, DEVICE, CARRIED = "packet", "device", "carried"
_OUT = "kind string, sensor_id {sensor}, frame_id long, emitted_frame_id int, capture_seq long, ts_ns long, payload binary"
_HELD = "ts_ns long, payload binary"
#: The time of packets without one, as pandas has no nulls among whole numbers.
UNTIMED = -(1 << 63)
#: Packets that are given out at a time, and of a micro-batch that tasks hold with room to spare.
GIVEN, PIECE = 4096, 800_000
PARTITIONS = "spark.sql.shuffle.partitions"


def ready(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class _Frames(StatefulProcessor):
    """A sensor's frames. ``counted`` sensors count packets (the count falls at a boundary), others number frames."""

    def __init__(self, counted: bool, include_noisy: bool, idle_ms: int, initial: int):
        self.counted, self.include_noisy, self.idle, self.initial = counted, include_noisy, idle_ms, initial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kept = "frame_id long, last int, first boolean, fresh boolean, points long, parts array<long>"
        self.machine = handle.getValueState("machine", kept if self.counted else "ordinal long, number int, parts array<long>")
        self.open = handle.getMapState("open", "capture_seq long", _HELD)
        self.devices = handle.getMapState("devices", "capture_seq long", _HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("capture_seq", kind="stable")
        own = pdf[~pdf["device"]]
        held = dict(zip(own["capture_seq"].tolist(), zip(own["ts_ns"].tolist(), own["payload"].tolist(), strict=True), strict=True))
        at = self.machine.get() if self.machine.exists() else None
        stored = set(at[-1]) if at else set()
        done, now, parts = self._counted(at, own) if self.counted else self._numbered(at, own)

        packet = lambda p: held[p] if p in held else self.open.getValue((p,))
        names = ["kind", "sensor_id", "frame_id", "emitted_frame_id", "capture_seq", "ts_ns", "payload"]
        out = [(frame_id, emitted, p) for frame_id, emitted, members in done for p in members]
        for start in range(0, len(out), GIVEN):  # payloads are copied on their way out
            ids, emitted, places = zip(*out[start : start + GIVEN], strict=True)
            times, payloads = zip(*map(packet, places), strict=True)
            yield pd.DataFrame(dict(zip(names, (PACKET, key[0], ids, emitted, places, times, payloads), strict=True)))
        heard = self._heard(key[0], pdf[pdf["device"]], bool(done), [packet(p)[0] for p in parts])

        if not stored <= set(parts):
            self.open.clear()
            stored = set()
        for p in parts:
            if p not in stored:
                self.open.updateValue((p,), held[p])
        self.machine.update(now)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        for start in range(0, len(heard), GIVEN):
            yield pd.DataFrame(heard[start : start + GIVEN], columns=names)

    def _counted(self, at, own: pd.DataFrame):
        machine = frames.FrameMachine(at[0], at[1], at[2], at[3], list(at[5]), at[4]) if at else frames.FrameMachine()
        points, done = decode.count_points(own["payload"].tolist(), self.include_noisy), []
        for o, c, n in zip(own["capture_seq"].tolist(), own["mark"].tolist(), points, strict=True):
            if full := machine.feed(int(o), int(c), n):
                done.append((full[0], None, full[1]))
        parts = [] if machine.fresh else machine.parts  # a frame that was given out isn't open any more
        return done, (machine.frame_id, machine.last, machine.first, machine.fresh, machine.points, parts), parts

    def _numbered(self, at, own: pd.DataFrame):
        ordinal, number, parts = (at[0], at[1], list(at[2])) if at else (0, self.initial, [])
        done = []
        for o, f in zip(own["capture_seq"].tolist(), own["mark"].tolist(), strict=True):
            if f != number:
                if parts:
                    done.append((ordinal, int(f), parts))
                ordinal, number, parts = ordinal + 1, int(f), []
            parts.append(int(o))
        return done, (ordinal, number, parts), parts

    def _heard(self, sensor, fresh: pd.DataFrame, any_done: bool, open_times: list[int]) -> list[tuple]:
        """Device packets to give out; the state keeps those that frames to come may see."""
        new = list(zip(fresh["capture_seq"].tolist(), fresh["ts_ns"].tolist(), fresh["payload"].tolist(), strict=True))
        out = [(DEVICE, sensor, None, None, *d) for d in new]
        old = [(k[0], *v) for k, v in self.devices.iterator()] if any_done or new else []
        if any_done:
            out += [(CARRIED, sensor, None, None, *d) for d in old]
        if any_done or new:
            known = sorted(old + [d for d in new if d[1] != UNTIMED and decode.has_imu(d[2])], key=lambda d: (d[1], d[0]))
            least = min([t for t in open_times if t != UNTIMED], default=None)  # no frame to come ends before this time
            before = [d for d in known if least is None or d[1] <= least]
            keep = {d[0] for d in known[max(0, len(before) - 1) :]}
            for d in old:
                if d[0] not in keep:
                    self.devices.removeKey((d[0],))
            for d in known:
                if d[0] in keep:
                    self.devices.updateValue((d[0],), (d[1], d[2]))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.machine.exists():
            at = self.machine.get()
            self.machine.update((at[0] + bool(at[5]), 65535, True, False, 0, []) if self.counted else (at[0] + 1, self.initial, []))
        self.open.clear()
        self.devices.clear()
        return iter(())

    def close(self) -> None:
        pass


def _marked(packets: DataFrame, settings: Settings, sensor: str) -> DataFrame:
    """The stream's good packets: sensor_id, capture_seq, ts_ns, device, mark (packet count or frame number), payload."""
    own = packets.withColumn("sensor_id", F.col(sensor)).where("sensor_id is not null and capture_seq is not null and payload is not null")
    own = own.withColumn("ts_ns", F.coalesce(F.col("ts_ns"), F.lit(UNTIMED)))
    if settings.target:
        own = own.where(F.col("src_ip") == settings.target)
    on = lambda port: (F.col("src_port") == port) | (F.col("dst_port") == port)
    names = ("sensor_id", "capture_seq", "ts_ns", "device", "mark", "payload")
    if settings.sensor == "ouster":
        return decode.decode_ouster_headers(own).where("error is null").withColumns({"device": F.lit(False), "mark": F.col("header_frame_id")}).select(*names)
    device = on(settings.difop_port)
    marked = own.where(device | on(settings.msop_port)).withColumn("device", device)
    msop = decode.decode_msop_headers(marked)
    return msop.where(F.col("device") | F.col("error").isNull()).withColumn("mark", F.col("pkt_cnt")).select(*names)


def whole_frames(packets: DataFrame, settings: Settings, sensor: str = "src_ip", idle: str = "10 minutes", initial: int = 0) -> DataFrame:
    """Packets (src_ip, src_port, dst_port, capture_seq, ts_ns, payload) of a stream by whole frames: kind, sensor_id,
    frame_id, emitted_frame_id (numbered sensors), capture_seq, ts_ns, payload."""
    ready(packets.sparkSession)
    marked = _marked(packets, settings, sensor)
    processor = _Frames(settings.sensor != "ouster", settings.include_noisy, _ms(idle), initial)
    schema = _OUT.format(sensor=dict(marked.dtypes)["sensor_id"])
    out = marked.groupBy("sensor_id").transformWithStateInPandas(processor, schema, "append", "ProcessingTime")
    return out.withColumn("ts_ns", F.when(F.col("ts_ns") != UNTIMED, F.col("ts_ns")))


def points_of(framed: DataFrame, settings: Settings, calibration: DataFrame | None = None, capacity: int | None = None) -> DataFrame:
    """Points of whole frames' packets (sensor_id, frame_id, capture_seq, ts_ns, payload)."""
    keys = ("sensor_id", "frame_id")
    if settings.sensor != "ouster":
        points = decode.decode_msop_points(framed, keep=(*keys, "capture_seq", "ts_ns"), include_noisy=settings.include_noisy)
        return frames.with_point_index(points, capacity=capacity or clouds.COUNTED_CAPACITY)
    shape = clouds.shape_of(calibration)
    pixels = decode.decode_ouster_pixels(framed, shape["rows"], shape["cols"], shape["columns_per_packet"], keep=(*keys, "capture_seq"))
    points = geometry.project_xyz(frames.scatter(pixels, keys), geometry.beam_lut(calibration), keys)
    stamps = framed.groupBy(*keys).agg(F.max("ts_ns").alias("ts_ns"))
    return frames.with_point_index(points.join(stamps, list(keys)), order=("row", "col"), capacity=capacity or clouds.NUMBERED_CAPACITY)


def views(batch: DataFrame, settings: Settings, calibration: DataFrame | None = None, before: DataFrame | None = None, points: DataFrame | None = None) -> dict[str, DataFrame]:
    """The messages of a micro-batch of ``whole_frames`` by topic, as ``plans.clouds.outputs`` names them, and under
    ``heights`` the smoothed height of each sensor after it (``before``: those before it). ``points``: its points, if they are
    there already."""
    points = points_of(batch.where(F.col("kind") == PACKET), settings, calibration) if points is None else points
    topic = settings.topic
    out = {f"{topic}/points": clouds.clouds(points, settings, clustered=False)}
    if settings.sensor != "ouster":
        device = decode.decode_difop(batch.where(F.col("kind") != PACKET)).where("error is null and accel_x is not null")
        out[f"{topic}/imu"] = pack.imu_messages(device.where(F.col("kind") == DEVICE), settings.frame_id)
    if settings.clustering:
        imu = clouds.frame_imu(points, device) if settings.sensor != "ouster" and settings.ground_filter else None
        found = clouds.labelled(points, settings, imu, before)
        out[f"{topic}/clusters"] = clouds.clouds(found, settings, clustered=True)
        if imu is not None:
            now = found.groupBy("sensor_id").agg(F.max_by("smooth", "frame_id").alias("smooth"))
            out["heights"] = now if before is None else now.unionByName(before.join(now, "sensor_id", "left_anti"))
    return out


def run(packets: DataFrame, settings: Settings, folder: str, checkpoint: str, calibration: DataFrame | None = None, sensor: str = "src_ip", idle: str = "10 minutes", available_now: bool = True, messages: str | None = None) -> StreamingQuery:
    """Start the stream: messages of each topic as Parquet under ``folder/topic/epoch=N``. An epoch that is tried again
    replaces its own part and starts from the heights of the one before, so each message is written once. ``messages`` is a
    folder for a log (``sinks.log``) of the serialized clouds, to which an epoch is added once."""
    spark = packets.sparkSession
    partitions = spark.conf.get(PARTITIONS)

    def each(batch: DataFrame, epoch: int) -> None:
        rows = batch.persist()
        points = points_of(rows.where(F.col("kind") == PACKET), settings, calibration).persist()  # each topic reads them
        smooth = "sensor_id {}, smooth double".format(dict(batch.dtypes)["sensor_id"])
        keeps = bool(settings.clustering and settings.ground_filter and settings.sensor != "ouster")
        before = batch.sparkSession.read.schema(smooth).parquet(f"{folder}/heights/epoch={epoch - 1}") if keeps and epoch else None
        made = views(rows, settings, calibration, before, points)
        put = lambda name: made[name].write.mode("overwrite").parquet(f"{folder}/{name}/epoch={epoch}")
        with ThreadPoolExecutor(len(made)) as pool:  # topics don't wait for each other's short steps
            list(pool.map(put, made))
        for name in [n for n in made if messages and n.endswith(("/points", "/clusters"))]:
            packed = batch.sparkSession.read.schema(made[name].schema).parquet(f"{folder}/{name}/epoch={epoch}").drop("message")
            sent = pack.with_cdr(packed, name.endswith("/clusters"), settings.frame_id)
            log.append(sent.select(F.lit(name).alias("topic"), "ts_ns", F.col("cdr").alias("data")), messages, f"{name}-{epoch}")
        points.unpersist()
        rows.unpersist()

    writer = whole_frames(packets, settings, sensor, idle).writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint)
    spark.conf.set(PARTITIONS, str(min(int(partitions), 3 * spark.sparkContext.defaultParallelism)))
    try:
        return available(writer, spark) if available_now else writer.start()
    finally:
        spark.conf.set(PARTITIONS, partitions)
