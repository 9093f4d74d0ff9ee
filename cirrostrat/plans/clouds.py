"""End-to-end plans: captures to packed clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.config import Settings
from cirrostrat.functions.binary import TIMESTAMP_MODES
from cirrostrat.functions.tables import written
from cirrostrat.operators import cluster as C
from cirrostrat.operators import decode, frames, geometry, ground, pack, tracks

COUNTED_CAPACITY, NUMBERED_CAPACITY = 30_000, 131_072


def counted_points(packets: DataFrame, settings: Settings, sensor: str = "src_ip", capacity: int | None = COUNTED_CAPACITY) -> DataFrame:
    """Points of the frames of counted sensors: sensor_id, frame_id, pt_idx, ts_ns, x, y, z, range, intensity. A frame holds
    ``capacity`` points as the sensor's buffer does (None: all of them)."""
    own = packets.where(F.col("src_ip") == settings.target) if settings.target else packets
    if "dst_port" in own.columns:
        own = own.where((F.col("src_port") == settings.msop_port) | (F.col("dst_port") == settings.msop_port))
    own = own.withColumn("sensor_id", F.col(sensor))
    headers = decode.decode_msop_headers(own).where("error is null")
    headers = written(headers.select("sensor_id", "capture_seq", "pkt_cnt"), "headers")  # read twice, and far smaller than packets
    members = frames.assemble_counted(headers)
    points = decode.decode_msop_points(own.select("sensor_id", "capture_seq", "ts_ns", "payload"), keep=("sensor_id", "capture_seq", "ts_ns"), include_noisy=settings.include_noisy)
    return frames.with_point_index(points.join(members, ["sensor_id", "capture_seq"]), capacity=capacity)


def difop(packets: DataFrame, settings: Settings, sensor: str = "src_ip") -> DataFrame:
    """Device packets of counted sensors, decoded: those of the device port that have no error."""
    own = packets.where((F.col("src_port") == settings.difop_port) | (F.col("dst_port") == settings.difop_port)) if "dst_port" in packets.columns else packets
    return decode.decode_difop(own.withColumn("sensor_id", F.col(sensor)).drop("error")).where("error is null")


def shape_of(calibration: DataFrame):
    """rows, cols and columns_per_packet of a sensor whose profile can be decoded."""
    shape = calibration.select("rows", "cols", "columns_per_packet", "profile").first()
    if shape["profile"] != "RNG15_RFL8_NIR8":
        raise ValueError(f"unsupported profile {shape['profile']}")
    return shape


def numbered_points(packets: DataFrame, calibration: DataFrame, settings: Settings, sensor: str = "src_ip", only_returns: bool = False, capacity: int | None = NUMBERED_CAPACITY) -> DataFrame:
    """Points of the frames of numbered sensors, with the time of the frame's last packet; ``capacity`` as for counted ones."""
    shape = shape_of(calibration)
    own = packets.withColumn("sensor_id", F.col(sensor))
    times = [c for c in ("ts_ns",) if c in own.columns]
    headers = decode.decode_ouster_headers(own).where("error is null")
    headers = written(headers.select("sensor_id", "capture_seq", "header_frame_id", *times), "headers")
    members = frames.assemble_numbered(headers).where("complete")
    pixels = decode.decode_ouster_pixels(own.select("sensor_id", "capture_seq", "payload"), shape["rows"], shape["cols"], shape["columns_per_packet"], keep=("sensor_id", "capture_seq"))
    joined = pixels.join(members.select("sensor_id", "capture_seq", "ordinal"), ["sensor_id", "capture_seq"])
    stamped = members.join(headers.select("sensor_id", "capture_seq", *times), ["sensor_id", "capture_seq"]) if times else members
    ids = stamped.groupBy("sensor_id", "ordinal").agg(F.first("emitted_frame_id").alias("emitted_frame_id"), *[F.max(c).alias(c) for c in times])
    points = geometry.project_xyz(frames.scatter(joined), geometry.beam_lut(calibration), only_returns=only_returns)
    out = points.join(ids, ["sensor_id", "ordinal"]).withColumn("frame_id", F.col("ordinal"))
    return frames.with_point_index(out, order=("row", "col"), capacity=capacity)


def labelled(points: DataFrame, settings: Settings, imu: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """``points`` with valid, ground and the final cluster_id: 0 noise, 1 ground, 2 and up in frames that have an IMU value;
    in others the clusters from 1 on, as nothing is removed from them. ``keep_latest`` takes each sensor's newest frame only.
    ``before`` (sensor_id, smooth) has the ground heights of earlier frames."""
    if settings.keep_latest:
        newest = tracks.latest_frame(points.select("sensor_id", "frame_id"))
        points = points.join(newest, ["sensor_id", "frame_id"], "left_semi")
    marked = points.withColumn("valid", C.valid_mask())
    if settings.ground_filter and imu is not None:
        accelerations = imu.select("sensor_id", "frame_id", *[c.alias(a) for c, a in zip(geometry.imu_axes(F.col("accel_x"), F.col("accel_y"), F.col("accel_z")), ("ax", "ay", "az"), strict=True)])
        marked = ground.ground_filter(marked, accelerations, settings.sensor_height, settings.ground_thickness / 1000, before)
        seen = imu.where("accel_x is not null").select("sensor_id", "frame_id", F.lit(True).alias("__ran")).distinct()
        marked = marked.join(seen, ["sensor_id", "frame_id"], "left").withColumn("__ran", F.coalesce("__ran", F.lit(False)))
    else:
        marked = marked.withColumns({"ground": F.lit(False), "__ran": F.lit(False)})
    keyed = marked.withColumn("valid", F.col("valid") & ~F.col("ground")).withColumn("__frame", F.col("frame_id")).withColumn("frame_id", F.struct("sensor_id", "__frame"))
    found = C.cluster(keyed, settings.clustering or "dbscan", settings.cluster_eps, settings.cluster_minpts, settings.cluster_bridge)
    out = found.withColumn("frame_id", F.col("__frame")).drop("__frame")
    return out.withColumn("cluster_id", C.relabel(F.col("cluster_id"), F.col("ground"), F.col("__ran"))).drop("__ran")


def clouds(points: DataFrame, settings: Settings, clustered: bool) -> DataFrame:
    """Packed messages, one a frame."""
    stamps = points.groupBy("sensor_id", "frame_id").agg(F.max("ts_ns").alias("ts_ns"))
    packed = pack.pack_points(points, clustered, mirror=settings.mirror).join(stamps, ["sensor_id", "frame_id"])
    return pack.cloud_messages(packed, clustered, settings.frame_id)


def frame_imu(points: DataFrame, difop: DataFrame) -> DataFrame:
    """The IMU values that each frame sees: the last at or before its completing time."""
    done = points.groupBy("sensor_id", "frame_id").agg(F.max("ts_ns").alias("ts_ns"))
    return tracks.latest_imu(done, difop.where("accel_x is not null"))


def sensors(packets: DataFrame, settings: Settings) -> DataFrame:
    """The first good device packet of each sender."""
    return tracks.discover_first(difop(packets, settings), key="sensor_id")


def device_request(spark: SparkSession, settings: Settings, destination: str) -> DataFrame:
    """One row with ``body``, the JSON that sets a numbered sensor up: where it sends to, its modes, and its window in
    thousandths of a degree. Nothing is sent; what the sensor answers is read by ``sources.files.read_calibration``."""
    if settings.timestamp_mode not in TIMESTAMP_MODES:
        raise ValueError(f"timestamp_mode: {settings.timestamp_mode}")
    window = F.array(*[F.lit(round(d * 1000)) for d in settings.numbers("azimuth", 2)])
    body = F.struct(F.lit(destination).alias("udp_dest"), F.lit(settings.lidar_mode).alias("lidar_mode"), F.lit(TIMESTAMP_MODES[settings.timestamp_mode]).alias("timestamp_mode"), window.alias("azimuth_window"))
    return spark.range(1).select(F.to_json(body).alias("body"))


def outputs(packets: DataFrame, settings: Settings, calibration: DataFrame | None = None) -> dict[str, DataFrame]:
    """What the settings ask for, by topic: points and, where clustering is on, clusters, one message a frame; the device's
    acceleration (counted sensors); the static transform. With ``discover`` only the sensors that were heard."""
    if settings.discover:
        return {"sensors": sensors(packets, settings)}
    if settings.sensor == "ouster":
        if calibration is None:
            raise ValueError("numbered sensors need their calibration")
        points, device = numbered_points(packets, calibration, settings), None
    else:
        points, device = counted_points(packets, settings), difop(packets, settings)
    topic, spark = settings.topic, packets.sparkSession
    out = {f"{topic}/points": clouds(points, settings, clustered=False)}
    if settings.clustering:
        imu = frame_imu(points, device) if device is not None and settings.ground_filter else None
        out[f"{topic}/clusters"] = clouds(labelled(points, settings, imu), settings, clustered=True)
    if device is not None:
        out[f"{topic}/imu"] = pack.imu_messages(device.where("accel_x is not null"), settings.frame_id)
    out["rt/tf_static"] = pack.static_transform(spark, settings.base_frame_id, settings.frame_id, settings.numbers("tf_vec", 3), settings.numbers("tf_quat", 4))
    return out
