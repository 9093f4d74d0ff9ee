"""Queries over the driver's tables, by name, with their SQL.

Points come from ``lineitem`` (frame = supplier modulo 64) and ``embeddings`` (frame = label); packets and tracks from
``events``. All points are DOUBLE so that both engines compare alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cirrostrat.config import Settings
from cirrostrat.functions import binary as B
from cirrostrat.functions.tables import scratch, written
from cirrostrat.operators import cluster as C
from cirrostrat.operators import blocks, decode, frames, geometry, ground, images, pack, selection, tracks
from cirrostrat.plans import clouds
from cirrostrat.sinks import log
from cirrostrat.sources import capture, files, split
from cirrostrat.streaming import eventtime, live
from cirrostrat.streaming import frames as stream

FLAGSHIP = "voxel_cluster_counts"
CELL, MIN_PTS, EPS = 1.0, 3, 0.6173
#: Files of a piece of packets that lands for the live stream.
LANDED_FILES = 8
_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_POINTS: dict[tuple[str, str], str] = {}


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries' point table: made from lineitem once per application and folder, as clouds come as points."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _POINTS:
        path = scratch(spark, "points")
        _numbered_points(spark, sf_dir).write.parquet(path)
        _POINTS[key] = path
    return spark.read.schema("frame_id long, pt_idx long, x double, y double, z double, intensity int").parquet(_POINTS[key])


def _numbered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = (F.row_number().over(Window.partitionBy("frame_id").orderBy(*_ORDER)) - 1).cast("long")
    return _unnumbered_points(spark, sf_dir, idx.alias("pt_idx"))


def _unnumbered_points(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """The points without pt_idx, which takes a sort of each frame, for queries that don't ask for it."""
    t = _table(spark, sf_dir, "lineitem").withColumn("frame_id", (F.col("l_suppkey") % 64).cast("long"))
    return t.select("frame_id", *more, ((F.col("l_quantity") - 25) * 0.4).alias("x"), (F.col("l_extendedprice") / 5000).alias("y"), (F.col("l_discount") * 20).alias("z"), F.col("l_linenumber").alias("intensity"))


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "embeddings")
    idx = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    xyz = [(F.element_at("embedding", i + 1).cast("double") * 10).alias(c) for i, c in enumerate("xyz")]
    return t.select(F.col("label").cast("long").alias("frame_id"), idx.alias("pt_idx"), *xyz)


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 4).alias("sensor_id"), F.col("event_id").alias("capture_seq"), (F.col("event_id") % 37).cast("int").alias("pkt_cnt"), "value", F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string")).alias("src_ip"))


_LP = f"""lp AS (SELECT (l_suppkey % 64)::BIGINT AS frame_id, row_number() OVER (PARTITION BY l_suppkey % 64 ORDER BY {", ".join(_ORDER)}) - 1 AS pt_idx,
 (l_quantity - 25) * 0.4 AS x, l_extendedprice / 5000 AS y, l_discount * 20 AS z, l_linenumber AS intensity FROM lineitem)"""
_EP = """ep AS (SELECT label::BIGINT AS frame_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pt_idx,
 embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings)"""
_EV = "ev AS (SELECT user_id % 4 AS sensor_id, event_id AS capture_seq, (event_id % 37)::INT AS pkt_cnt, value, '10.0.0.' || (user_id % 50) AS src_ip FROM events)"
_VALID = "NOT (x = 0 AND y = 0 AND z = 0)"
_VOX = f"v AS (SELECT frame_id, floor(x * {1 / CELL})::INT AS vx, floor(y * {1 / CELL})::INT AS vy, floor(z * {1 / CELL})::INT AS vz, pt_idx FROM lp WHERE {_VALID})"
_HIST = "h AS (SELECT frame_id, vx, vy, vz, count(*) AS n, min(pt_idx) AS first FROM v GROUP BY ALL)"
_VOXEL_LABELS = f"""{_LP}, {_VOX}, {_HIST}, d AS (SELECT * FROM h WHERE n >= {MIN_PTS}),
o AS (SELECT a.* FROM (SELECT unnest(range(-1, 2)) AS dx) x, (SELECT unnest(range(-1, 2)) AS dy) y, (SELECT unnest(range(-1, 2)) AS dz) z, LATERAL (SELECT dx, dy, dz) a),
e AS (SELECT a.frame_id, a.first AS p, b.first AS q FROM d a, o JOIN d b ON b.frame_id = a.frame_id AND b.vx = a.vx + dx AND b.vy = a.vy + dy AND b.vz = a.vz + dz),
r AS (SELECT frame_id, first AS root, first AS node FROM d UNION SELECT r.frame_id, r.root, e.q FROM r JOIN e ON e.frame_id = r.frame_id AND e.p = r.node AND e.q > r.root),
m AS (SELECT frame_id, node, min(root) AS root FROM r GROUP BY ALL),
l AS (SELECT frame_id, node, dense_rank() OVER (PARTITION BY frame_id ORDER BY root) AS cluster_id FROM m),
c AS (SELECT lp.frame_id, lp.pt_idx, coalesce(l.cluster_id, 0)::BIGINT AS cluster_id FROM lp LEFT JOIN v USING (frame_id, pt_idx) LEFT JOIN d USING (frame_id, vx, vy, vz) LEFT JOIN l ON l.frame_id = d.frame_id AND l.node = d.first)"""
_EPS2 = f"({EPS!r} * {EPS!r})"
_NEAR = f"pr AS (SELECT a.frame_id, a.pt_idx AS a, b.pt_idx AS b FROM pts a JOIN pts b ON a.frame_id = b.frame_id AND abs(a.x - b.x) <= {EPS} AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {_EPS2})"
_DB = f"""{_EP}, pts AS (SELECT * FROM ep WHERE {_VALID}), {_NEAR},
k AS (SELECT frame_id, a FROM pr GROUP BY ALL HAVING count(*) >= {MIN_PTS}),
e AS (SELECT pr.* FROM pr JOIN k USING (frame_id, a) JOIN k k2 ON k2.frame_id = pr.frame_id AND k2.a = pr.b),
r AS (SELECT frame_id, a AS root, a AS node FROM k UNION SELECT r.frame_id, r.root, e.b FROM r JOIN e ON e.frame_id = r.frame_id AND e.a = r.node AND e.b > r.root),
m AS (SELECT frame_id, node, min(root) AS root FROM r GROUP BY ALL),
l AS (SELECT frame_id, node, dense_rank() OVER (PARTITION BY frame_id ORDER BY root) AS id FROM m),
g AS (SELECT pr.frame_id, pr.b AS pt_idx, min(l.id) AS id FROM pr JOIN l ON l.frame_id = pr.frame_id AND l.node = pr.a GROUP BY ALL)
SELECT ep.frame_id, ep.pt_idx, coalesce(l.id, g.id, 0)::BIGINT AS cluster_id FROM ep LEFT JOIN l ON l.frame_id = ep.frame_id AND l.node = ep.pt_idx LEFT JOIN g ON g.frame_id = ep.frame_id AND g.pt_idx = ep.pt_idx"""

# The ground queries stand on a fixed tilted gravity; the frame's axes come out the same in both engines.
_G = (0.0, -0.6, -0.8)
_H0 = (-0.6 / math.hypot(0.6), 0.0, 0.0)  # seed (0, 0, 1) x g, normalized
_SEEDS = f"""{_LP}, hh AS (SELECT *, x * {_G[0]} + y * ({_G[1]}) + z * ({_G[2]}) AS height, x * 1.0 AS u, y * (-0.8) + z * 0.6 AS v FROM lp WHERE {_VALID}),
pp AS (SELECT *, sqrt(u * u + v * v) AS flat FROM hh), qq AS (SELECT *, (least(floor((atan2(v, u) + pi()) / (2 * pi() / 16)), 15) * 8 + least(floor(flat / 3.75), 7))::INT AS patch FROM pp WHERE flat >= 0.01 AND flat < 30 AND sqrt(x * x + y * y + z * z) >= 0.5),
ss AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, patch ORDER BY height DESC, pt_idx) AS seed FROM qq) WHERE seed <= 20)"""


def _heights(points: DataFrame) -> DataFrame:
    p = points.withColumns({"valid": C.valid_mask(), "range": F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)})
    g = [F.lit(v).alias(k) for k, v in zip(("gx", "gy", "gz", "h0x", "h0y", "h0z", "h1x", "h1y", "h1z"), (*_G, 1.0, 0.0, 0.0, 0.0, -0.8, 0.6), strict=True)]
    return geometry.height(p.select("*", *g)).where("valid")


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.seeds(ground.polar_patches(_heights(lineitem_points(spark, sf_dir))))


def _packets(spark: SparkSession, sf_dir: str, headers: DataFrame | None = None) -> DataFrame:
    """Packets of the counted family, built from events: one block each, the rest empty."""
    e = _headers(spark, sf_dir) if headers is None else headers
    be = lambda c, n: F.unhex(F.lpad(F.hex(c), 2 * n, "0"))
    radius, head = (F.col("capture_seq") % 6000 + 1).cast("long"), F.lit(decode.MSOP_SYNC)
    header = F.concat(head, be(F.col("pkt_cnt").cast("long"), 2), F.lit(b"\0\0"), be((F.col("capture_seq") % 8).cast("long"), 1), F.lit(b"\0"), be(F.col("capture_seq"), 6), be(F.col("sensor_id"), 4), F.lit(b"\0" * 11), be((F.col("capture_seq") % 200).cast("long"), 1))
    block = F.concat(F.lit(b"\0\0"), be(radius, 2), F.lit(bytes.fromhex("400040005a82")), be((F.col("capture_seq") % 256).cast("long"), 1), be((F.col("capture_seq") % 3).cast("long"), 1))
    return e.select("sensor_id", "capture_seq", F.concat(header, block, F.lit(bytes(1200 - 44))).alias("payload"))


def _calibration(spark: SparkSession) -> DataFrame:
    raw = spark.createDataFrame([('{"lidar_mode": "512x10", "data_format": {"pixels_per_column": 16, "pixel_shift_by_row": [' + ", ".join(str(i % 4 * 3 - 4) for i in range(16)) + "]}}",)], "j string").select(F.from_json("j", files.CALIBRATION).alias("c")).select("c.*")
    return files.with_defaults(raw)


_LUT = """px AS (SELECT r AS row, c AS col, (r % 4) * 3 - 4 AS s FROM (SELECT unnest(range(16)) AS r), (SELECT unnest(range(5, 507)) AS c)),
lut AS (SELECT row, col, s, greatest(0, least(col - s, 510)) AS src_col, 2 * pi() * (1 - (col + greatest(-s, 0)) / 512) AS enc, 2 * pi() * (((row - 31.5) * 0.7)::FLOAT)::DOUBLE / 360 AS alt, 27.67::FLOAT::DOUBLE AS t FROM px)"""


def _r(c, n: int = 6):
    return F.round(c, n) + F.lit(0.0)


def _q_voxel_counts(s, d):
    return C.voxel_cluster_sizes(lineitem_points(s, d), CELL, MIN_PTS)


def _q_relabel(s, d):
    p = lineitem_points(s, d).withColumn("ground", F.col("z") < 0.5).withColumn("valid", C.valid_mask() & ~F.col("ground"))
    return C.voxel_cluster(p, CELL, MIN_PTS).select("frame_id", "pt_idx", C.relabel(F.col("cluster_id"), F.col("ground")).alias("cluster_id"))


def _floor(s, d):
    """Most points of each frame as a floor 1.5 below the sensor, the rest above it."""
    p = lineitem_points(s, d).withColumn("z", F.when(F.col("intensity") <= 5, F.col("z") * 0.02 - 1.5).otherwise(F.col("z") * 0.5))
    return p.withColumns({"sensor_id": F.lit(0).cast("long"), "valid": C.valid_mask(), "range": F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)})


def _q_ground_heights(s, d):
    down = [F.lit(v).alias(k) for k, v in zip(("gx", "gy", "gz", "h0x", "h0y", "h0z", "h1x", "h1y", "h1z"), (0.0, 0.0, -1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0), strict=True)]
    seeded = ground.seeds(ground.polar_patches(geometry.height(_floor(s, d).select("*", *down))))
    accepted = ground.ground_patches(ground.plane_fit(ground.patch_statistics(seeded)))
    return ground.ground_heights(seeded, accepted).select("frame_id", _r(F.col("detected")).alias("detected"))


def _q_ema(s, d):
    h = _headers(s, d).select("sensor_id", F.col("capture_seq").alias("frame_id"), F.col("value").alias("detected"))
    return ground.smoothed(h).select("sensor_id", "frame_id", _r(F.col("smooth"), 4).alias("smooth"))


def _q_asof(s, d):
    e = _headers(s, d)
    imu = e.where("capture_seq % 7 = 0").select("sensor_id", F.col("capture_seq").alias("ts_ns"), *[(F.col("value") + i).alias(f"accel_{a}") for i, a in enumerate("xyz")])
    return tracks.latest_imu(e.where("capture_seq % 7 = 3").select("sensor_id", F.col("capture_seq").alias("ts_ns")), imu)


def _event_pixels(s, d):
    e = _table(s, d, "events")
    return e.select((F.col("event_id") % 3).alias("sensor_id"), F.lit(0).alias("ordinal"), (F.col("event_id") % 16).cast("int").alias("row"), (F.expr("event_id div 16") % 512).cast("int").alias("col"), F.lit(0).alias("col_in_packet"), F.col("event_id").alias("capture_seq"), (F.col("user_id") % 4000).cast("int").alias("depth"), F.lit(7).cast("smallint").alias("reflect"))


def _q_asof_stream(s, d):
    """Device rows and frames that land out of order, up to 500 seconds late, in three pieces, each taken by a run of the
    stream that goes on from the one before; two later rows move the watermark past the end."""
    e, second = _headers(s, d).where("capture_seq % 7 in (0, 3)"), 1_000_000_000
    rows = e.select("sensor_id", ((F.col("capture_seq") + 1) * second).alias("ts_ns"), F.when(F.col("capture_seq") % 7 == 3, F.col("capture_seq")).alias("frame_id"), *[F.when(F.col("capture_seq") % 7 == 0, F.col("value") + i).alias(f"accel_{a}") for i, a in enumerate("xyz")])
    last = rows.agg(F.max("ts_ns")).first()[0]
    folder, out = scratch(s, "asof"), "sensor_id long, frame_id long, ts_ns long, accel_x double, accel_y double, accel_z double"
    if last is None:
        return s.createDataFrame([], out).select("sensor_id", "ts_ns", "accel_x", "accel_y", "accel_z")
    end = last // second + 501
    place = F.expr(f"(ts_ns div {second} + pmod(hash(ts_ns), 500)) * 3 div {end}")
    later = [s.createDataFrame([(-1, last + k * 10_000 * second, None, 0.0, 0.0, 0.0)], rows.schema) for k in (1, 2)]
    for piece in [*(rows.where(place == k) for k in range(3)), *later]:
        piece.write.mode("append").parquet(f"{folder}/landed")
        source = s.readStream.schema(rows.schema).parquet(f"{folder}/landed")
        writer = eventtime.latest_imu_by_time(source, "600 seconds").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        stream.available(writer, s).awaitTermination()
    return s.read.schema(out).parquet(f"{folder}/out").select("sensor_id", F.col("frame_id").alias("ts_ns"), "accel_x", "accel_y", "accel_z")


def _q_project(s, d):
    out = geometry.project_xyz(frames.scatter(_event_pixels(s, d)), geometry.beam_lut(_calibration(s)))
    return out.select("sensor_id", "row", "col", *[_r(F.col(c).cast("double"), 2).alias(c) for c in ("x", "y", "z")])


def _q_images(s, d):
    """The images' pixels again, by their place in the arrays."""
    made = images.range_images(frames.scatter(_event_pixels(s, d)), 16, 512)
    each = made.select("sensor_id", F.posexplode(F.arrays_zip("depth", "reflect")).alias("at", "p"))
    return each.select("sensor_id", F.expr("at div 512").cast("int").alias("row"), (F.col("at") % 512).cast("int").alias("col"), "p.depth", F.col("p.reflect").cast("int").alias("reflect"))


def _q_decode(s, d):
    p = decode.decode_msop_points(_packets(s, d), keep=("sensor_id", "capture_seq"))
    return p.select("sensor_id", "capture_seq", "block", *[_r(F.col(c).cast("double"), 4).alias(c) for c in ("x", "y", "z", "range")], F.col("intensity").cast("int").alias("intensity"), F.col("attribute").cast("int").alias("attribute"))


def _q_ground_filter(s, d):
    p = _floor(s, d)
    imu = p.select("sensor_id", "frame_id").distinct().select("*", F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(-9.81).alias("az"))
    return ground.ground_filter(p, imu).groupBy("frame_id").agg(F.count("*").alias("n_points"), tracks.ground_removed(F.col("valid"), F.col("valid") & ~F.col("ground")), _r(F.max("smooth"), 4).alias("smooth"))


def _q_pack(s, d):
    p = C.voxel_cluster(lineitem_points(s, d), CELL, MIN_PTS).withColumn("sensor_id", F.lit(0).cast("long"))
    return pack.cloud_messages(pack.pack_points(p, clustered=True, mirror="horizontal").withColumn("ts_ns", F.col("frame_id") * 100_000_000), clustered=True).select("frame_id", "n_points", F.octet_length("data").cast("long").alias("n_bytes"), F.col("message.row_step").cast("long").alias("row_step"))


def _q_packed(s, d):
    """Packed records read back: the points of the clouds' bytes."""
    p = C.voxel_cluster(lineitem_points(s, d), CELL, MIN_PTS).withColumn("sensor_id", F.lit(0).cast("long"))
    found = pack.unpacked(pack.pack_points(p, clustered=True, mirror="both"), clustered=True)
    return found.select("frame_id", "pt_idx", *[_r(F.col(c).cast("double"), 3).alias(c) for c in "xyz"], "cluster_id", F.col("reflect").cast("int").alias("reflect"))


def _q_device_text(s, d):
    stamp = B.ros_time("ns")
    return _headers(s, d).withColumn("ns", F.col("capture_seq") * 1234567891).select(
        "capture_seq",
        B.shot_limiting(F.col("pkt_cnt") % 12, F.lit(5)).alias("limiting"), B.shutdown_status(F.col("pkt_cnt") % 4, F.lit(9)).alias("shutdown"),
        B.alert_flags((F.col("capture_seq") % 256).cast("int")).alias("alert"), B.return_mode(F.col("pkt_cnt") % 8).alias("return_mode"),
        B.serial_hex(F.col("capture_seq")).alias("serial"), stamp["sec"].cast("long").alias("sec"), stamp["nanosec"].cast("long").alias("nanosec"),
    )


def _bytes(c, n: int):
    """``n`` big-endian bytes of an integer column."""
    return B.be_bytes(c, n)


def _turned(c, n: int):
    """``n`` little-endian bytes of an integer column."""
    return B.le_bytes(c, n)


def _bad_packets(s, d):
    """Packets of _packets, some cut short and some with another sync."""
    broken = F.when(F.col("capture_seq") % 5 == 1, F.expr("substring(payload, 1, 900)")).when(F.col("capture_seq") % 5 == 3, F.concat(F.lit(b"\0"), F.expr("substring(payload, 2, 1199)")))
    return _packets(s, d).withColumn("payload", F.coalesce(broken, "payload"))


def _difop_packets(s, d):
    e, seq = _headers(s, d), F.col("capture_seq")
    zero = lambda n: F.lit(bytes(n))
    head = [F.lit(decode.DIFOP_SYNC), zero(8), _bytes(seq % 7, 1), F.lit(b"\2"), _bytes(F.col("pkt_cnt"), 1), zero(1), _bytes(seq, 6), zero(18), F.lit(b"\x0a\0"), _bytes(F.col("pkt_cnt"), 1), _bytes(seq % 250, 1)]
    ports = [zero(14), _bytes(seq % 60_000, 2), zero(6), _bytes(seq % 50_000 + 1, 2), zero(29), _bytes(seq % 5, 1), _bytes(seq % 2, 1), zero(105)]
    # six floats: 2 ** (k % 4), negative for odd k, and an infinity now and then
    value = lambda k: F.when(seq % 11 == k, F.lit(b"\x7f\x80\0\0")).otherwise(F.concat(_bytes(F.when((seq + k) % 2 == 1, 0xBF80).otherwise(0x3F80) + (seq + k) % 4 * 128, 2), zero(2)))
    raw = F.concat(*head, *ports, *[value(k) for k in range(6)], zero(24))
    broken = F.when(seq % 13 == 2, F.expr("substring(raw, 1, 100)")).when(seq % 13 == 4, F.concat(F.lit(b"\1"), F.expr("substring(raw, 2, 255)")))
    return e.withColumn("raw", raw).select("sensor_id", "capture_seq", F.coalesce(broken, "raw").alias("payload"))


def _q_difop(s, d):
    out = decode.decode_difop(_difop_packets(s, d))
    return out.select("capture_seq", "version", "serial", "lidar_ip", "msop_port", "difop_port", "sync_mode", "sync_status", *[F.col(c).cast("double").alias(c) for c in ("accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z")], "error")


def _ouster_packets(s, d):
    """Packets of two columns of two rows, of two kinds."""
    e, seq = _headers(s, d), F.col("capture_seq")
    head = F.concat(_turned(F.when(seq % 9 == 4, 2).otherwise(1), 2), _turned(seq % 3000, 2), _turned(seq, 3), _turned(seq, 5), _turned(seq % 256, 1), F.lit(bytes(3)), _turned(seq % 30, 1), _turned(seq % 20, 1), _turned(seq % 3 * 16, 1), _turned(seq % 13 * 16, 1), F.lit(bytes(12)))
    column = lambda k: F.concat(_turned(seq * 10 + k, 8), _turned((seq * 2 + k) % 20, 2), _turned((seq + k) % 3, 1), F.lit(b"\0"), *[F.concat(_turned((seq * 7 + r) % 65_536, 2), _turned((seq + r) % 256, 1), F.lit(b"\7")) for r in range(2)])
    return e.select("sensor_id", "capture_seq", F.concat(head, column(0), column(1)).alias("payload"))


def _q_ouster_headers(s, d):
    return decode.decode_ouster_headers(_ouster_packets(s, d)).select("capture_seq", "header_frame_id", "init_id", F.col("serial").alias("serial_no"), "alert", "shot_limiting", "shutdown", "error")


def _q_ouster_pixels(s, d):
    px = decode.decode_ouster_pixels(_ouster_packets(s, d), 2, 16, 2)
    return px.select("capture_seq", "col_in_packet", "column_ts", "row", "col", "depth", F.col("reflect").cast("int").alias("reflect"))


def _q_fragments(s, d):
    """Datagrams of 40 bytes and more in fragments of 16 bytes of IP payload, some out of order and some incomplete, whose
    identifications come again; those of one port."""
    e, seq = _headers(s, d), F.col("capture_seq")
    payload = F.expr("repeat(lpad(hex(capture_seq), 8, '0'), cast(4 + capture_seq % 5 as int))")
    body = F.concat(_bytes(6000 + seq % 3, 2), _bytes(F.lit(12_345), 2), _bytes(8 + F.octet_length(payload), 2), F.lit(b"\0\0"), F.encode(payload, "utf-8"))
    whole = e.select("sensor_id", "capture_seq", body.alias("body")).withColumn("last", F.expr("cast((octet_length(body) - 1) div 16 as int)"))
    parts = whole.select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("k")).where(~((seq % 10 == 6) & (F.col("k") == 1)))
    place = F.when(seq % 2 == 1, F.col("last") - F.col("k")).otherwise(F.col("k"))
    rows = parts.select(
        F.lit("c").alias("capture"), (seq * 16 + place).alias("capture_seq"), (seq * 1_000_000_000_000 + place).alias("ts_ns"), F.concat(F.lit("10.0.0."), F.col("sensor_id").cast("string")).alias("src"), F.lit("10.0.0.9").alias("dst"),
        F.lit(17).alias("proto"), (seq % 8).cast("int").alias("ident"), (F.col("k") * 16).alias("offset"), (F.col("k") < F.col("last")).alias("more"), F.expr("substring(body, k * 16 + 1, 16)").alias("data"), F.lit(None).cast("string").alias("error"),
    )
    found = capture.udp(capture.reassembled(rows), 6001)
    return found.select(F.expr("capture_seq div 16").alias("datagram"), "src_ip", "src_port", F.when(F.col("error").isNull(), F.decode("payload", "utf-8")).alias("payload"), "error")


def _q_gravity_frame(s, d):
    seq = F.col("capture_seq")
    imu = _headers(s, d).select("capture_seq", ((seq % 21 - 10) / 4.0).alias("accel_x"), ((seq % 13 - 6) / 2.0).alias("accel_y"), ((seq % 5 - 2) * 1.0).alias("accel_z"))
    axes = [c.alias(a) for c, a in zip(geometry.imu_axes(F.col("accel_x"), F.col("accel_y"), F.col("accel_z")), ("ax", "ay", "az"), strict=True)]
    out = geometry.gravity_frame(imu.select("capture_seq", *axes))
    return out.select("capture_seq", *[_r(F.col(c)).alias(c) for c in ("gx", "gy", "gz", "h0x", "h0y", "h0z", "h1x", "h1y", "h1z")])


def _q_capacity(s, d):
    p = lineitem_points(s, d).drop("pt_idx").withColumn("sensor_id", F.lit(1).cast("long"))
    kept = frames.with_point_index(p, order=("y", "x", "z", "intensity"), capacity=500)
    return kept.groupBy("frame_id").agg(F.count("*").alias("n"), F.max("pt_idx").cast("long").alias("last"), F.max("y").alias("top"))


def _q_offsets(s, d):
    counts = lineitem_points(s, d).groupBy("frame_id", F.col("intensity").alias("ring")).agg(F.count("*").alias("n"))
    return tracks.prefix_offsets(counts, ("frame_id",), ("ring",)).select("frame_id", "ring", "n", "offset")


def _q_pca(s, d):
    """Plane fits; the normal where the smallest eigenvalue stands apart, as elsewhere it hangs on the last bits."""
    fit, c = ground.plane_fit(ground.patch_statistics(_seeded(s, d))), F.col
    minors = c("chh") * c("cuu") - c("chu") ** 2 + c("chh") * c("cvv") - c("chv") ** 2 + c("cuu") * c("cvv") - c("cuv") ** 2
    apart = minors - 2 * c("eig_min") * (c("eig_sum") - c("eig_min")) + c("eig_min") ** 2
    return fit.select("frame_id", "patch", _r(c("eig_sum"), 4).alias("eig_sum"), _r(c("eig_min"), 4).alias("eig_min"), F.when(apart >= 1e-3 * c("eig_sum") ** 2, _r(c("normal_h"), 3)).alias("normal_h"))


def _q_dispatch(s, d):
    return C.cluster(embedding_points(s, d), "dbscan", round(EPS * 1000), MIN_PTS).groupBy("frame_id", "cluster_id").agg(F.count("*").alias("n"))


def _q_clouds(s, d):
    """Packets to labelled clouds: packets with a port, frames, points, clusters, packed messages, by frame."""
    packets = _packets(s, d).withColumns({"src_ip": F.concat(F.lit("10.0.0."), F.col("sensor_id").cast("string")), "src_port": F.lit(6699), "dst_port": F.lit(6699), "ts_ns": F.col("capture_seq") * 1_000_000})
    settings = Settings(clustering="voxel", cluster_eps=1000, cluster_minpts=2, mirror="horizontal")
    points = clouds.counted_points(packets, settings, sensor="sensor_id", capacity=None)
    labelled = clouds.labelled(points, settings)
    found = clouds.clouds(labelled, settings, clustered=True)
    return found.select("sensor_id", "frame_id", "n_points", F.col("message.row_step").cast("long").alias("row_step"), F.col("message.header.stamp.nanosec").cast("long").alias("nanosec"))


def _landed(s, d, headers: DataFrame, folder: str) -> DataFrame:
    """Packets of ``headers``, made after those are given out to files, in a folder of their own."""
    packets = _packets(s, d, headers.repartition(LANDED_FILES)).withColumns({"src_ip": F.concat(F.lit("10.0.0."), F.col("sensor_id").cast("string")), "src_port": F.lit(6699), "dst_port": F.lit(6699), "ts_ns": F.col("capture_seq") * 1_000_000})
    packets.write.parquet(folder)
    return s.read.schema(packets.schema).parquet(folder)


def _q_live(s, d):
    """Packets that land three times, each time taken by a run of the live stream that goes on from the one before; the
    points of the packed clouds' bytes. What lands lies in pieces of 800,000 packets or less, each a micro-batch."""
    line = Window.partitionBy("sensor_id").orderBy("capture_seq")
    headers = written(_headers(s, d).withColumn("pkt_cnt", (F.row_number().over(line) - 1) % 12), "headers")
    first, last, count = headers.agg(F.min("capture_seq"), F.max("capture_seq"), F.count("*")).first()
    folder, settings = scratch(s, "live"), Settings(sensor="robosense", clustering="voxel", cluster_eps=1000, cluster_minpts=MIN_PTS, topic="t")
    pieces = max(3, -(-count // live.PIECE))
    for k in range(pieces if first is not None else 0):
        low, high = (first + (last - first + 1) * i // pieces for i in (k, k + 1))
        piece = _landed(s, d, headers.where((F.col("capture_seq") >= low) & (F.col("capture_seq") < high)), f"{folder}/landed/{k:06d}")
        # a run takes LANDED_FILES files at a time, the oldest first: a piece of fewer files is the last of a run
        if (k + 1) * 3 // pieces > k * 3 // pieces or len(piece.inputFiles()) < LANDED_FILES:
            source = s.readStream.schema(piece.schema).option("maxFilesPerTrigger", LANDED_FILES).parquet(f"{folder}/landed/*")
            live.run(source, settings, f"{folder}/out", f"{folder}/checkpoint", sensor="sensor_id").awaitTermination()
    kinds = "sensor_id long, frame_id long, data binary"
    packed = s.read.schema(kinds).parquet(f"{folder}/out/t/clusters") if first is not None else s.createDataFrame([], kinds)
    found = pack.unpacked(packed, clustered=True)
    return found.select("sensor_id", "frame_id", "pt_idx", *[_r(F.col(c).cast("double"), 3).alias(c) for c in "xyz"], "cluster_id", F.col("reflect").cast("int").alias("reflect"))


_TEXT_SQL = f"""WITH {_EV} SELECT capture_seq,
CASE pkt_cnt % 12 WHEN 0 THEN 'normal' WHEN 1 THEN 'imminent(5s)' WHEN 2 THEN 'reduced(3%)' WHEN 3 THEN 'reduced(6%)' WHEN 4 THEN 'reduced(9%)' WHEN 5 THEN 'reduced(12%)' WHEN 6 THEN 'reduced(16%)' WHEN 7 THEN 'reduced(21%)' WHEN 8 THEN 'reduced(25%)' WHEN 9 THEN 'reduced(27%)' ELSE 'invalid(' || (pkt_cnt % 12) || ')' END AS limiting,
CASE pkt_cnt % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'imminent(9s)' ELSE 'invalid(' || (pkt_cnt % 4) || ')' END AS shutdown,
CASE WHEN (capture_seq & 64) <> 0 THEN 'overflow(' || (capture_seq & 63) || ')' WHEN (capture_seq & 128) <> 0 THEN 'active(' || (capture_seq & 63) || ')' ELSE 'normal' END AS alert,
CASE pkt_cnt % 8 WHEN 0 THEN 'Dual' WHEN 5 THEN 'Last' WHEN 6 THEN 'Nearest' ELSE 'Strongest' END AS return_mode,
printf('%X', capture_seq) AS serial, capture_seq * 1234567891 // 1000000000 AS sec, capture_seq * 1234567891 % 1000000000 AS nanosec FROM ev"""

_FLOAT = lambda k: f"CASE WHEN fine THEN (CASE WHEN (capture_seq + {k}) % 2 = 1 THEN -1 ELSE 1 END) * 2.0 ** ((capture_seq + {k}) % 4) END::DOUBLE"
_DIFOP_SQL = f"""WITH {_EV}, f AS (SELECT *, capture_seq % 13 NOT IN (2, 4) AS ok, capture_seq % 13 NOT IN (2, 4) AND capture_seq % 11 > 5 AS fine FROM ev)
SELECT capture_seq, CASE WHEN ok THEN (capture_seq % 7) || '.2.' || pkt_cnt END AS version, CASE WHEN ok THEN lpad(printf('%X', capture_seq), 12, '0') END AS serial, CASE WHEN ok THEN '10.0.' || pkt_cnt || '.' || (capture_seq % 250) END AS lidar_ip,
CASE WHEN ok THEN (capture_seq % 60000)::INT END AS msop_port, CASE WHEN ok THEN (capture_seq % 50000 + 1)::INT END AS difop_port,
CASE WHEN ok THEN CASE capture_seq % 5 WHEN 1 THEN 'Gps' WHEN 2 THEN 'Ptp' WHEN 3 THEN 'Gptp' ELSE 'Internal' END END AS sync_mode, CASE WHEN ok THEN CASE capture_seq % 2 WHEN 1 THEN 'Success' ELSE 'Failed' END END AS sync_status,
{", ".join(f"{_FLOAT(k)} AS {n}" for k, n in enumerate(("accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z")))},
CASE capture_seq % 13 WHEN 2 THEN 'short packet' WHEN 4 THEN 'bad sync' END AS error FROM f"""
_OUSTER_SQL = f"""WITH {_EV}, f AS (SELECT *, capture_seq % 9 <> 4 AS ok, capture_seq % 13 AS lim, capture_seq % 3 AS shut, capture_seq % 256 AS fl FROM ev)
SELECT capture_seq, CASE WHEN ok THEN (capture_seq % 3000)::INT END AS header_frame_id, CASE WHEN ok THEN capture_seq % 16777216 END AS init_id, CASE WHEN ok THEN capture_seq END AS serial_no,
CASE WHEN ok THEN CASE WHEN (fl & 64) <> 0 THEN 'overflow(' || (fl & 63) || ')' WHEN (fl & 128) <> 0 THEN 'active(' || (fl & 63) || ')' ELSE 'normal' END END AS alert,
CASE WHEN ok THEN CASE WHEN lim = 0 THEN 'normal' WHEN lim = 1 THEN 'imminent(' || (capture_seq % 20) || 's)' WHEN lim BETWEEN 2 AND 9 THEN 'reduced(' || ([3, 6, 9, 12, 16, 21, 25, 27])[lim - 1] || '%)' ELSE 'invalid(' || lim || ')' END END AS shot_limiting,
CASE WHEN ok THEN CASE shut WHEN 0 THEN 'normal' WHEN 1 THEN 'imminent(' || (capture_seq % 30) || 's)' ELSE 'invalid(' || shut || ')' END END AS shutdown, CASE WHEN NOT ok THEN 'not a lidar packet' END AS error FROM f"""
# frames of counted sensors: whole ones, without the packets that show a boundary
_FRAMES = f"""{_EV}, b AS (SELECT *, coalesce(pkt_cnt < lag(pkt_cnt) OVER w, false) AS fell FROM ev WINDOW w AS (PARTITION BY sensor_id ORDER BY capture_seq)),
o AS (SELECT *, sum(fell::INT) OVER (PARTITION BY sensor_id ORDER BY capture_seq)::BIGINT AS frame_id FROM b),
m AS (SELECT sensor_id, capture_seq, frame_id FROM (SELECT *, max(frame_id) OVER (PARTITION BY sensor_id) AS final FROM o) WHERE frame_id < final AND NOT fell)"""
# plane fit of each patch's seeds: the smallest eigenvalue in closed form, and its vector by the longest cross product
_PCA = """st AS (SELECT frame_id, patch, count(*) AS n, avg(height) AS centroid, var_pop(height) AS a, var_pop(u) AS b, var_pop(v) AS c, covar_pop(height, u) AS d, covar_pop(height, v) AS e, covar_pop(u, v) AS f FROM ss GROUP BY ALL),
s1 AS (SELECT *, a + b + c AS eig_sum, (a + b + c) / 3 AS q, d * d + e * e + f * f AS ofs FROM st), s2 AS (SELECT *, sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * ofs) / 6) AS p FROM s1),
s3 AS (SELECT *, CASE WHEN p > 0 THEN ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (p * p * p) END AS det FROM s2),
s4 AS (SELECT *, CASE WHEN ofs < 1e-30 THEN least(a, b, c) ELSE q + 2 * p * cos(acos(greatest(-1, least(1, det / 2))) / 3 + 2 * pi() / 3) END AS eig_min FROM s3),
s5 AS (SELECT *, a - eig_min AS x, b - eig_min AS y, c - eig_min AS z FROM s4),
s6 AS (SELECT *, d * f - e * y AS h1, (d * f - e * y) ** 2 + (e * d - x * f) ** 2 + (x * y - d * d) ** 2 AS l1, d * z - e * f AS h2, (d * z - e * f) ** 2 + (e * e - x * z) ** 2 + (x * f - d * e) ** 2 AS l2,
 y * z - f * f AS h3, (y * z - f * f) ** 2 + (f * e - d * z) ** 2 + (d * f - y * e) ** 2 AS l3 FROM s5),
fit AS (SELECT *, CASE WHEN greatest(l1, l2, l3) < 1e-30 THEN 1.0 WHEN l1 >= l2 AND l1 >= l3 THEN abs(h1) / sqrt(l1) WHEN l2 >= l3 THEN abs(h2) / sqrt(l2) ELSE abs(h3) / sqrt(l3) END AS normal_h FROM s6)"""
# the floor scene's points with the height along gravity (0, 0, -1), their patches and seeds, and each frame's height
_GROUND = f"""{_LP}, zz AS (SELECT frame_id, pt_idx, x, y, CASE WHEN intensity <= 5 THEN z * 0.02 - 1.5 ELSE z * 0.5 END AS z FROM lp),
fl AS (SELECT *, {_VALID} AS valid, sqrt(x * x + y * y + z * z) AS rg, -z AS height, y AS u, x AS v FROM zz), pp AS (SELECT *, sqrt(u * u + v * v) AS flat FROM fl WHERE valid),
qq AS (SELECT *, (least(floor((atan2(v, u) + pi()) / (2 * pi() / 16)), 15) * 8 + least(floor(flat / 3.75), 7))::INT AS patch FROM pp WHERE flat >= 0.01 AND flat < 30 AND rg >= 0.5),
ss AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, patch ORDER BY height DESC, pt_idx) AS seed FROM qq) WHERE seed <= 20), {_PCA},
ok AS (SELECT frame_id, patch, centroid FROM fit WHERE n >= 5 AND abs(normal_h) >= 0.85 AND eig_sum >= 1e-12 AND eig_min / eig_sum <= 0.03),
lv AS (SELECT *, abs(centroid - max(centroid) OVER (PARTITION BY frame_id)) <= 1 AS level FROM ok), ac AS (SELECT frame_id, patch FROM (SELECT *, count(*) OVER (PARTITION BY frame_id) AS k FROM lv WHERE level) WHERE k >= 3),
detected AS (SELECT frame_id, l[(len(l) // 2 + 1)::INT] AS detected FROM (SELECT frame_id, list_sort(list(height)) AS l FROM ss SEMI JOIN ac USING (frame_id, patch) GROUP BY 1))"""

# the live stream's points: frames of twelve packets, without those that show a boundary and the frame open at the end
_LIVE_POINTS = f"""{_EV}, n AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY capture_seq) - 1 AS rn, count(*) OVER (PARTITION BY sensor_id) AS all_rows FROM ev),
lf AS (SELECT sensor_id, rn // 12 AS frame_no, capture_seq, (capture_seq % 6000 + 1)::FLOAT * 0.005::FLOAT AS r FROM n WHERE (rn % 12 <> 0 OR rn = 0) AND (rn // 12 + 1) * 12 < all_rows AND capture_seq % 3 <> 2),
lp AS (SELECT sensor_id * 1000000000 + frame_no AS frame_id, row_number() OVER (PARTITION BY sensor_id, frame_no ORDER BY capture_seq) - 1 AS pt_idx, sensor_id, frame_no,
 r * 0.5::FLOAT AS x, r * 0.5::FLOAT AS y, r * (23170 / 32768)::FLOAT AS z, (capture_seq % 256)::INT AS reflect FROM lf)"""
_LIVE_SQL = f"""WITH RECURSIVE {_VOXEL_LABELS.replace(_LP, _LIVE_POINTS)}
SELECT sensor_id, frame_no AS frame_id, pt_idx, round(x::DOUBLE, 3) AS x, round(y::DOUBLE, 3) AS y, round(z::DOUBLE, 3) AS z, cluster_id, reflect FROM lp JOIN c USING (frame_id, pt_idx)"""


def _q_split_captures(s, d):
    """Packets written as captures, and read back by ranges of 1 MB: what their headers say."""
    packets = _packets(s, d, split.in_files(_headers(s, d))).withColumns({"src_ip": F.concat(F.lit("10.0.0."), F.col("sensor_id").cast("string")), "dst_ip": F.lit("10.0.1.1"), "src_port": F.lit(6699), "dst_port": 6699 + F.col("sensor_id").cast("int") % 2, "ts_ns": F.col("capture_seq") * 1_000_000})
    folder = scratch(s, "captures")
    split.export(packets, folder)
    found = split.read_split_packets(s, f"{folder}/*.pcap", 6700, split_bytes=1 << 20)
    seconds = B.u_be("payload", 10, 6)
    return decode.decode_msop_headers(found).select(seconds.alias("capture_seq"), "src_ip", "dst_port", "pkt_cnt", F.expr("ts_ns div 1000000").alias("ms"), F.octet_length("payload").alias("n_bytes"))


def _q_message_log(s, d):
    """Packed clouds as serialized messages, written to a log and read back: their stamps and sizes."""
    p = C.voxel_cluster(lineitem_points(s, d), CELL, MIN_PTS).withColumn("sensor_id", F.lit(0).cast("long"))
    packed = pack.with_cdr(pack.pack_points(p, clustered=True).withColumn("ts_ns", F.col("frame_id") * 1_100_000_000), clustered=True)
    folder = scratch(s, "messages")
    log.append(packed.select(F.concat(F.lit("t/"), (F.col("frame_id") % 3).cast("string")).alias("topic"), "ts_ns", F.col("cdr").alias("data")), folder)
    return log.read(s, folder).select("topic", "ts_ns", B.u_le("data", 4, 4).alias("sec"), B.u_le("data", 8, 4).alias("nanosec"), F.octet_length("data").cast("long").alias("n_bytes"))


_CDR_BYTES = len(pack.cloud_cdr(0, 0, "lidar", 0, pack.XYZCI, b""))


def _machine_headers(s, d):
    """Headers whose counts fall often, also twice in a row, some of them without points."""
    seq = F.col("capture_seq")
    return _headers(s, d).select("sensor_id", "capture_seq", (seq * 7 % 5).cast("int").alias("pkt_cnt"), F.when(seq % 4 < 2, 0).otherwise(2).alias("n_points"))


_MACHINE_SQL = f"""WITH RECURSIVE {_EV}, n AS (SELECT sensor_id, capture_seq, (capture_seq * 7) % 5 AS c, capture_seq % 4 >= 2 AS filled, row_number() OVER (PARTITION BY sensor_id ORDER BY capture_seq) AS rn FROM ev),
r AS (SELECT sensor_id, rn, capture_seq, 0 AS frame, 0 AS gen, c, filled AS pts, false AS fresh, true AS member, -1 AS ended FROM n WHERE rn = 1
UNION ALL SELECT n.sensor_id, n.rn, n.capture_seq, CASE WHEN NOT fresh AND n.c < r.c AND pts THEN frame + 1 ELSE frame END, CASE WHEN fresh OR n.c < r.c THEN gen + 1 ELSE gen END, n.c,
 CASE WHEN fresh THEN filled WHEN n.c < r.c THEN NOT pts AND filled ELSE pts OR filled END, NOT fresh AND n.c < r.c AND pts, fresh OR n.c >= r.c OR NOT pts, CASE WHEN NOT fresh AND n.c < r.c AND pts THEN gen ELSE -1 END
 FROM r JOIN n ON n.sensor_id = r.sensor_id AND n.rn = r.rn + 1)
SELECT a.sensor_id, a.capture_seq, a.frame::BIGINT AS frame_id FROM r a JOIN r b ON b.sensor_id = a.sensor_id AND b.ended = a.gen WHERE a.member"""


def _q_setting_names(s, d):
    """Sensors and timestamp modes, from settings to names and back; unknown ones are null."""
    e, at = _table(s, d, "events"), lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % len(v) + 1).cast("int"))
    rows = e.select(F.col("event_id").alias("capture_seq"), at("internal", "SYNC_PULSE_IN", "ptp1588", "noon").alias("mode"), at("Ouster", " robosense", "radar").alias("kind"))
    rows = rows.withColumn("mode_name", B.timestamp_mode("mode"))
    return rows.select("capture_seq", "mode_name", B.timestamp_setting("mode_name").alias("setting"), B.sensor_type("kind").alias("sensor"))


def _q_waves(s, d):
    return files.waves(s, 5000, frames=3).select("frame_id", "pt_idx", *[_r(F.col(c).cast("double"), 3).alias(c) for c in "xyz"], F.col("intensity").cast("int").alias("intensity"))


def _q_imu_messages(s, d):
    axes = ("accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z")
    rows = _headers(s, d).select("capture_seq", (F.col("capture_seq") * 1_500_000_000).alias("ts_ns"), *[(F.col("pkt_cnt") + i).cast("double").alias(c) for i, c in enumerate(axes)])
    m = lambda path: F.col("message." + path)
    return pack.imu_messages(rows).select("capture_seq", m("header.stamp.sec").alias("sec"), m("header.stamp.nanosec").alias("nanosec"), m("orientation.w").alias("w"), m("linear_acceleration.z").alias("accel_z"), m("angular_velocity.y").alias("gyro_y"), F.aggregate(m("orientation_covariance"), F.lit(0.0), lambda a, x: a + x).alias("covariance"))


def _q_static_transform(s, d):
    settings = Settings(tf_vec="0.5 -1 2", tf_quat="0 0 1 0")
    t = pack.static_transform(s, settings.base_frame_id, settings.frame_id, settings.numbers("tf_vec", 3), settings.numbers("tf_quat", 4))
    return t.select("frame_id", "child_frame_id", F.col("translation.y").alias("ty"), F.col("translation.z").alias("tz"), F.col("rotation.z").alias("qz"), F.col("rotation.w").alias("qw"))


QUERIES = {
    "split_captures": _q_split_captures,
    "message_log": _q_message_log,
    "frame_machine": lambda s, d: frames.assemble_counted(_machine_headers(s, d), exact=True, size=500).select("sensor_id", "capture_seq", "frame_id"),
    "live_clouds": _q_live,
    "voxel_cluster_counts": _q_voxel_counts,
    "voxel_cluster": lambda s, d: C.voxel_cluster(lineitem_points(s, d), CELL, MIN_PTS).select("frame_id", "pt_idx", "cluster_id"),
    "voxel_cluster_bridge": lambda s, d: C.voxel_cluster(lineitem_points(s, d), CELL, MIN_PTS, 5).select("frame_id", "pt_idx", "cluster_id"),
    "dbscan_cluster": lambda s, d: C.dbscan(embedding_points(s, d), EPS, MIN_PTS).select("frame_id", "pt_idx", "cluster_id"),
    "dbscan_by_blocks": lambda s, d: blocks.dbscan_by_blocks(embedding_points(s, d), EPS, MIN_PTS, 8).select("frame_id", "pt_idx", "cluster_id"),
    "dbscan_by_joins": lambda s, d: C.dbscan_by_joins(embedding_points(s, d), EPS, MIN_PTS).select("frame_id", "pt_idx", "cluster_id"),
    "dbscan_lineitem": lambda s, d: C.dbscan(lineitem_points(s, d), EPS, 4, 6).select("frame_id", "pt_idx", "cluster_id"),
    "valid_mask": lambda s, d: lineitem_points(s, d).select("frame_id", "pt_idx", C.valid_mask().alias("valid")),
    "range_gate": lambda s, d: lineitem_points(s, d).where(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) >= 12.5).groupBy("frame_id").agg(F.count("*").alias("n")),
    "mirror_points": lambda s, d: lineitem_points(s, d).select("frame_id", "pt_idx", *[_r(c).alias(n) for c, n in zip(geometry.mirrored(F.col("y"), F.col("z"), "both"), "yz", strict=True)]),
    "voxel_histogram": lambda s, d: C.voxel_histogram(lineitem_points(s, d), CELL),
    "neighbor_count": lambda s, d: blocks.neighbor_counts(lineitem_points(s, d), EPS),
    "core_points": lambda s, d: blocks.neighbor_counts(lineitem_points(s, d), EPS).where("neighbors >= 4").groupBy("frame_id").agg(F.count("*").alias("cores")),
    "relabel_ground": _q_relabel,
    "gravity_height": lambda s, d: _heights(lineitem_points(s, d)).select("frame_id", "pt_idx", *[_r(F.col(c)).alias(c) for c in ("height", "u", "v")]),
    "polar_patch": lambda s, d: ground.polar_patches(_heights(lineitem_points(s, d))).groupBy("frame_id", "patch").agg(F.count("*").alias("n")),
    "patch_topk": lambda s, d: _seeded(s, d).select("frame_id", "patch", "pt_idx", F.col("seed").cast("long").alias("seed")),
    "patch_covariance": lambda s, d: ground.patch_statistics(_seeded(s, d)).select("frame_id", "patch", "n", *[_r(F.col(c), 4).alias(c) for c in ("centroid", "chh", "cuu", "cvv", "chu", "chv", "cuv")]),
    "patch_pca": _q_pca,
    "ground_height": _q_ground_heights,
    "ground_filter": _q_ground_filter,
    "ema_height": _q_ema,
    "frame_boundaries": lambda s, d: frames.boundaries(_headers(s, d)).select("sensor_id", "capture_seq", "boundary", "ordinal"),
    "frame_members": lambda s, d: frames.assemble_counted(_headers(s, d)),
    "frame_summary": lambda s, d: frames.frame_summary(frames.assemble_counted(_headers(s, d))),
    "numbered_frames": lambda s, d: frames.assemble_numbered(_headers(s, d).withColumn("header_frame_id", F.expr("cast(capture_seq div 50 as int)"))).select("sensor_id", "capture_seq", "ordinal", "frame_id", "emitted_frame_id"),
    "asof_imu": _q_asof,
    "asof_imu_stream": _q_asof_stream,
    "discover_first": lambda s, d: tracks.discover_first(_headers(s, d)).select("src_ip", "capture_seq", "sensor_id"),
    "device_changes": lambda s, d: tracks.changes(_headers(s, d).withColumn("kind", F.expr("pkt_cnt div 9")), "sensor_id", "capture_seq", ("kind",)).select("sensor_id", "capture_seq", "kind"),
    "latest_frame": lambda s, d: tracks.latest_frame(_headers(s, d).withColumnRenamed("capture_seq", "frame_id")).select("sensor_id", "frame_id", "pkt_cnt"),
    "stage_window_avg": lambda s, d: tracks.stage_window_averages(_table(s, d, "events").select((F.col("event_id") - F.lit(0)).alias("frame_ordinal"), "value"), ("value",)).select("window_no", "frames", _r(F.col("avg_value"), 4).alias("avg_value")),
    "range_percentiles": lambda s, d: selection.percentiles(_unnumbered_points(s, d), ("frame_id",), "y"),
    "height_percentiles": lambda s, d: selection.percentiles(_heights(_unnumbered_points(s, d)).withColumn("height", _r(F.col("height"))), ("frame_id",), "height"),
    "project_images": lambda s, d: images.project(frames.scatter(_event_pixels(s, d)), geometry.beam_lut(_calibration(s))).select("sensor_id", "row", "col", *[_r(F.col(c).cast("double"), 2).alias(c) for c in ("x", "y", "z")]),
    "range_images": _q_images,
    "beam_lut": lambda s, d: geometry.beam_lut(_calibration(s)).select("row", "col", "src_col", *[_r(F.col(c).cast("double"), 4).alias(c) for c in ("xc", "yc", "zc")]),
    "project_xyz": _q_project,
    "device_text": _q_device_text,
    "decode_headers": lambda s, d: decode.decode_msop_headers(_packets(s, d)).select("capture_seq", "pkt_cnt", "return_mode", "header_ns", F.col("temperature").cast("int").alias("temperature"), "error"),
    "decode_points": _q_decode,
    "pack_points": _q_pack,
    "packed_bytes": _q_packed,
    "decode_bad_headers": lambda s, d: decode.decode_msop_headers(_bad_packets(s, d)).select("capture_seq", "pkt_cnt", "error"),
    "decode_difop": _q_difop,
    "ouster_headers": _q_ouster_headers,
    "ouster_pixels": _q_ouster_pixels,
    "udp_fragments": _q_fragments,
    "gravity_frame": _q_gravity_frame,
    "frame_capacity": _q_capacity,
    "prefix_offsets": _q_offsets,
    "cluster_dispatch": _q_dispatch,
    "clouds": _q_clouds,
    "setting_names": _q_setting_names,
    "wave_scene": _q_waves,
    "imu_messages": _q_imu_messages,
    "static_transform": _q_static_transform,
    "generated_scene": lambda s, d: C.voxel_cluster(files.scene(s, 5000, 40, 100, frames=4), 0.256, 4).groupBy("frame_id", "cluster_id").agg(F.count("*").alias("n")),
}

ORACLE_SQL = {
    "split_captures": f"WITH {_EV} SELECT capture_seq, '10.0.0.' || sensor_id AS src_ip, 6700 AS dst_port, pkt_cnt, capture_seq AS ms, 1200 AS n_bytes FROM ev WHERE sensor_id % 2 = 1",
    "message_log": f"WITH {_LP} SELECT 't/' || (frame_id % 3) AS topic, frame_id * 1100000000 AS ts_ns, frame_id * 1100000000 // 1000000000 AS sec, frame_id * 1100000000 % 1000000000 AS nanosec, {_CDR_BYTES} + 17 * count(*) AS n_bytes FROM lp GROUP BY frame_id",
    "frame_machine": _MACHINE_SQL,
    "live_clouds": _LIVE_SQL,
    "voxel_cluster_counts": f"WITH RECURSIVE {_VOXEL_LABELS} SELECT frame_id, cluster_id, count(*) AS n_points FROM c GROUP BY ALL",
    "voxel_cluster": f"WITH RECURSIVE {_VOXEL_LABELS} SELECT * FROM c",
    "dbscan_cluster": f"WITH RECURSIVE {_DB}",
    "dbscan_by_blocks": f"WITH RECURSIVE {_DB}",
    "dbscan_by_joins": f"WITH RECURSIVE {_DB}",
    "valid_mask": f"WITH {_LP} SELECT frame_id, pt_idx, {_VALID} AS valid FROM lp",
    "range_gate": f"WITH {_LP} SELECT frame_id, count(*) AS n FROM lp WHERE sqrt(x * x + y * y + z * z) >= 12.5 GROUP BY 1",
    "mirror_points": f"WITH {_LP} SELECT frame_id, pt_idx, round(-y, 6) + 0.0 AS y, round(-z, 6) + 0.0 AS z FROM lp",
    "voxel_histogram": f"WITH {_LP}, {_VOX}, {_HIST} SELECT * FROM h",
    "neighbor_count": f"WITH {_LP}, pts AS (SELECT * FROM lp WHERE {_VALID}), {_NEAR} SELECT frame_id, a AS pt_idx, count(*) AS neighbors FROM pr GROUP BY ALL",
    "core_points": f"WITH {_LP}, pts AS (SELECT * FROM lp WHERE {_VALID}), {_NEAR}, k AS (SELECT frame_id, a FROM pr GROUP BY ALL HAVING count(*) >= 4) SELECT frame_id, count(*) AS cores FROM k GROUP BY 1",
    "relabel_ground": "WITH RECURSIVE " + _VOXEL_LABELS.replace(f"WHERE {_VALID})", f"WHERE {_VALID} AND z >= 0.5)") + " SELECT frame_id, pt_idx, CASE WHEN lp.z < 0.5 THEN 1 WHEN c.cluster_id > 0 THEN c.cluster_id + 1 ELSE 0 END::BIGINT AS cluster_id FROM c JOIN lp USING (frame_id, pt_idx)",
    "gravity_height": f"WITH {_SEEDS} SELECT frame_id, pt_idx, round(height, 6) + 0.0 AS height, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v FROM hh",
    "polar_patch": f"WITH {_SEEDS} SELECT frame_id, patch, count(*) AS n FROM qq GROUP BY ALL",
    "patch_topk": f"WITH {_SEEDS} SELECT frame_id, patch, pt_idx, seed FROM ss",
    "patch_covariance": f"WITH {_SEEDS} SELECT frame_id, patch, count(*) AS n, round(avg(height), 4) + 0.0 AS centroid, round(var_pop(height), 4) + 0.0 AS chh, round(var_pop(u), 4) + 0.0 AS cuu, round(var_pop(v), 4) + 0.0 AS cvv, round(covar_pop(height, u), 4) + 0.0 AS chu, round(covar_pop(height, v), 4) + 0.0 AS chv, round(covar_pop(u, v), 4) + 0.0 AS cuv FROM ss GROUP BY ALL",
    "ema_height": f"""WITH {_EV}, l AS (SELECT sensor_id, capture_seq, list(value) OVER (PARTITION BY sensor_id ORDER BY capture_seq ROWS BETWEEN 48 PRECEDING AND CURRENT ROW) AS w FROM ev)
SELECT sensor_id, capture_seq AS frame_id, round(list_reduce(w, lambda a, b: CASE WHEN abs(a - b) < 0.5 THEN 0.5 * a + 0.5 * b ELSE b END), 4) + 0.0 AS smooth FROM l""",
    "frame_boundaries": f"WITH {_EV}, b AS (SELECT *, lag(pkt_cnt) OVER w AS p FROM ev WINDOW w AS (PARTITION BY sensor_id ORDER BY capture_seq)) SELECT sensor_id, capture_seq, p IS NULL OR pkt_cnt < p AS boundary, sum((p IS NOT NULL AND pkt_cnt < p)::INT) OVER (PARTITION BY sensor_id ORDER BY capture_seq)::BIGINT AS ordinal FROM b",
    "asof_imu": f"""WITH {_EV}, i AS (SELECT sensor_id, capture_seq AS ts_ns, value FROM ev WHERE capture_seq % 7 = 0)
SELECT f.sensor_id, f.capture_seq AS ts_ns, i.value AS accel_x, i.value + 1 AS accel_y, i.value + 2 AS accel_z FROM (SELECT * FROM ev WHERE capture_seq % 7 = 3) f ASOF LEFT JOIN i ON f.sensor_id = i.sensor_id AND f.capture_seq >= i.ts_ns""",
    "discover_first": f"WITH {_EV} SELECT src_ip, capture_seq, sensor_id FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY capture_seq) AS n FROM ev) WHERE n = 1",
    "device_changes": f"WITH {_EV}, k AS (SELECT sensor_id, capture_seq, (pkt_cnt // 9)::BIGINT AS kind, lag(pkt_cnt // 9) OVER (PARTITION BY sensor_id ORDER BY capture_seq) AS p FROM ev) SELECT sensor_id, capture_seq, kind FROM k WHERE p IS DISTINCT FROM kind",
    "latest_frame": f"WITH {_EV} SELECT sensor_id, max(capture_seq) AS frame_id, arg_max(pkt_cnt, capture_seq) AS pkt_cnt FROM ev GROUP BY 1",
    "stage_window_avg": "SELECT * FROM (SELECT floor((event_id - 1) / 100)::BIGINT AS window_no, count(*) AS frames, round(avg(value), 4) + 0.0 AS avg_value FROM events GROUP BY 1) WHERE frames = 100",
    "range_percentiles": f'WITH {_LP}, s AS (SELECT frame_id, list_sort(list(y)) AS l, count(*) AS n FROM lp GROUP BY 1) SELECT frame_id, l[1] AS min, l[n * 10 // 100 + 1] AS p10, l[n * 50 // 100 + 1] AS p50, l[n * 90 // 100 + 1] AS p90, l[n] AS max FROM s',
    "height_percentiles": f"WITH {_SEEDS}, s AS (SELECT frame_id, list_sort(list(round(height, 6) + 0.0)) AS l, count(*) AS n FROM hh GROUP BY 1) SELECT frame_id, l[1] AS min, l[n * 10 // 100 + 1] AS p10, l[n * 50 // 100 + 1] AS p50, l[n * 90 // 100 + 1] AS p90, l[n] AS max FROM s",
    "range_images": """WITH p AS (SELECT event_id % 3 AS sensor_id, event_id % 16 AS row, event_id // 16 % 512 AS col, arg_max(user_id % 4000, event_id) AS depth FROM events GROUP BY ALL)
SELECT s.sensor_id, r::INT AS row, c::INT AS col, coalesce(p.depth, 0)::INT AS depth, CASE WHEN p.depth IS NULL THEN 0 ELSE 7 END AS reflect
FROM (SELECT DISTINCT sensor_id FROM p) s, range(16) a(r), range(512) b(c) LEFT JOIN p ON p.sensor_id = s.sensor_id AND p.row = r AND p.col = c""",
    "beam_lut": f"WITH {_LUT} SELECT row::INT AS row, col::INT AS col, src_col::INT AS src_col, round((cos(enc) * cos(alt))::FLOAT::DOUBLE, 4) + 0.0 AS xc, round((sin(enc) * cos(alt))::FLOAT::DOUBLE, 4) + 0.0 AS yc, round(sin(alt)::FLOAT::DOUBLE, 4) + 0.0 AS zc FROM lut",
    "device_text": _TEXT_SQL,
    "decode_headers": f"WITH {_EV} SELECT capture_seq, pkt_cnt, CASE capture_seq % 8 WHEN 0 THEN 'Dual' WHEN 5 THEN 'Last' WHEN 6 THEN 'Nearest' ELSE 'Strongest' END AS return_mode, capture_seq * 1000000000 + sensor_id * 1000 AS header_ns, (((capture_seq % 200 - 80 + 128) % 256) - 128)::INT AS temperature, NULL::VARCHAR AS error FROM ev",
    "decode_points": f"WITH {_EV}, r AS (SELECT *, (capture_seq % 6000 + 1)::FLOAT * 0.005::FLOAT AS rg FROM ev WHERE capture_seq % 3 <> 2) SELECT sensor_id, capture_seq, 0 AS block, round((0.5::FLOAT * rg)::DOUBLE, 4) AS x, round((0.5::FLOAT * rg)::DOUBLE, 4) AS y, round((rg * (23170 / 32768.0)::FLOAT)::DOUBLE, 4) AS z, round(rg::FLOAT::DOUBLE, 4) AS range, (capture_seq % 256)::INT AS intensity, (capture_seq % 3)::INT AS attribute FROM r",
    "pack_points": f"WITH {_LP} SELECT frame_id, count(*) AS n_points, count(*) * 17 AS n_bytes, count(*) * 17 AS row_step FROM lp GROUP BY 1",
    "packed_bytes": f"WITH RECURSIVE {_VOXEL_LABELS} SELECT frame_id, pt_idx::INT AS pt_idx, round(lp.x::FLOAT::DOUBLE, 3) + 0.0 AS x, round(-lp.y::FLOAT::DOUBLE, 3) + 0.0 AS y, round(-lp.z::FLOAT::DOUBLE, 3) + 0.0 AS z, c.cluster_id, lp.intensity::INT AS reflect FROM c JOIN lp USING (frame_id, pt_idx)",
    "decode_bad_headers": f"WITH {_EV} SELECT capture_seq, CASE WHEN capture_seq % 5 NOT IN (1, 3) THEN pkt_cnt END AS pkt_cnt, CASE capture_seq % 5 WHEN 1 THEN 'short packet' WHEN 3 THEN 'bad sync' END AS error FROM ev",
    "decode_difop": _DIFOP_SQL,
    "ouster_headers": _OUSTER_SQL,
    "ouster_pixels": f"""WITH {_EV}, k AS (SELECT *, unnest(range(2)) AS k FROM ev WHERE capture_seq % 9 <> 4), p AS (SELECT *, unnest(range(2)) AS r FROM k)
SELECT capture_seq, k::INT AS col_in_packet, capture_seq * 10 + k AS column_ts, r::INT AS row, ((capture_seq * 2 + k) % 20)::INT AS col, ((capture_seq * 7 + r) % 32768)::INT AS depth, ((capture_seq + r) % 256)::INT AS reflect
FROM p WHERE (capture_seq + k) % 3 = 1 AND (capture_seq * 2 + k) % 20 < 16""",
    "udp_fragments": f"""WITH {_EV} SELECT capture_seq AS datagram, '10.0.0.' || sensor_id AS src_ip, 6001 AS src_port,
CASE WHEN capture_seq % 10 <> 6 THEN repeat(lpad(printf('%X', capture_seq), 8, '0'), (4 + capture_seq % 5)::INT) END AS payload, CASE WHEN capture_seq % 10 = 6 THEN 'fragments missing' END AS error
FROM ev WHERE capture_seq % 3 = 1""",
    "gravity_frame": f"""WITH {_EV}, a AS (SELECT capture_seq, (capture_seq % 5 - 2) * 1.0::DOUBLE AS x, -((capture_seq % 21 - 10) / 4.0::DOUBLE) AS y, -((capture_seq % 13 - 6) / 2.0::DOUBLE) AS z FROM ev),
m AS (SELECT *, sqrt(x * x + y * y + z * z) AS m FROM a), g AS (SELECT capture_seq, CASE WHEN m >= 1e-6 THEN x / m END AS gx, CASE WHEN m >= 1e-6 THEN y / m END AS gy, CASE WHEN m >= 1e-6 THEN z / m END AS gz FROM m),
c AS (SELECT *, CASE WHEN abs(gz) < 0.9 THEN -gy ELSE 0 END AS cx, CASE WHEN abs(gz) < 0.9 THEN gx ELSE -gz END AS cy, CASE WHEN abs(gz) < 0.9 THEN 0 ELSE gy END AS cz FROM g),
h AS (SELECT *, cx / sqrt(cx * cx + cy * cy + cz * cz) AS h0x, cy / sqrt(cx * cx + cy * cy + cz * cz) AS h0y, cz / sqrt(cx * cx + cy * cy + cz * cz) AS h0z FROM c WHERE gx IS NOT NULL)
SELECT capture_seq, round(gx, 6) + 0.0 AS gx, round(gy, 6) + 0.0 AS gy, round(gz, 6) + 0.0 AS gz, round(h0x, 6) + 0.0 AS h0x, round(h0y, 6) + 0.0 AS h0y, round(h0z, 6) + 0.0 AS h0z,
round(gy * h0z - gz * h0y, 6) + 0.0 AS h1x, round(gz * h0x - gx * h0z, 6) + 0.0 AS h1y, round(gx * h0y - gy * h0x, 6) + 0.0 AS h1z FROM h
UNION ALL SELECT capture_seq, gx, gy, gz, NULL, NULL, NULL, NULL, NULL, NULL FROM g WHERE gx IS NULL""",
    "frame_capacity": f"WITH {_LP}, k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY y, x, z, intensity) - 1 AS i FROM lp) SELECT frame_id, count(*) AS n, max(i) AS last, max(y) AS top FROM k WHERE i < 500 GROUP BY 1",
    "setting_names": """SELECT event_id AS capture_seq, ['TIME_FROM_INTERNAL_OSC', 'TIME_FROM_SYNC_PULSE_IN', 'TIME_FROM_PTP_1588', NULL][event_id % 4 + 1] AS mode_name,
 ['internal', 'sync_pulse_in', 'ptp1588', NULL][event_id % 4 + 1] AS setting, ['ouster', 'robosense', NULL][event_id % 3 + 1] AS sensor FROM events""",
    "wave_scene": """SELECT i // 5000 AS frame_id, (i % 5000)::INT AS pt_idx, round((sin(2 * pi() * 40 / 5000 * (i % 5000)) * 8)::FLOAT::DOUBLE, 3) AS x, round((cos(2 * (2 * pi() * 40 / 5000 * (i % 5000))) * 8)::FLOAT::DOUBLE, 3) AS y,
 round((i % 5000 * 0.0008)::FLOAT::DOUBLE, 3) AS z, (i % 5000 % 256)::INT AS intensity FROM range(15000) t(i)""",
    "imu_messages": "SELECT event_id AS capture_seq, (event_id * 1500000000 // 1000000000)::INT AS sec, (event_id * 1500000000 % 1000000000)::INT AS nanosec, 1.0::DOUBLE AS w, (event_id % 37 + 2)::DOUBLE AS accel_z, (event_id % 37 + 4)::DOUBLE AS gyro_y, 0.0::DOUBLE AS covariance FROM events",
    "static_transform": "SELECT 'base_link' AS frame_id, 'lidar' AS child_frame_id, -1.0::DOUBLE AS ty, 2.0::DOUBLE AS tz, 1.0::DOUBLE AS qz, 0.0::DOUBLE AS qw",
    "prefix_offsets": f'WITH {_LP}, k AS (SELECT frame_id, intensity AS ring, count(*) AS n FROM lp GROUP BY ALL) SELECT frame_id, ring, n, coalesce(sum(n) OVER (PARTITION BY frame_id ORDER BY ring ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM k',
    "cluster_dispatch": "WITH RECURSIVE " + _DB.replace(f"{EPS!r}", f"{round(EPS * 1000) / 1000!r}").replace("SELECT ep.frame_id, ep.pt_idx, coalesce", ", z AS (SELECT ep.frame_id, ep.pt_idx, coalesce") + ") SELECT frame_id, cluster_id, count(*) AS n FROM z GROUP BY ALL",
    "clouds": f"""WITH {_FRAMES}, p AS (SELECT m.* FROM m JOIN ev USING (sensor_id, capture_seq) WHERE capture_seq % 3 <> 2)
SELECT sensor_id, frame_id, count(*) AS n_points, count(*) * 17 AS row_step, max(capture_seq) * 1000000 % 1000000000 AS nanosec FROM p GROUP BY ALL""",
    "frame_members": f"WITH {_FRAMES} SELECT * FROM m",
    "frame_summary": f"WITH {_FRAMES}, k AS (SELECT sensor_id, frame_id, count(*) AS n_points FROM m GROUP BY ALL) SELECT *, sum(n_points) OVER (PARTITION BY sensor_id ORDER BY frame_id)::BIGINT AS total_points FROM k",
    "numbered_frames": f"""WITH {_EV}, h AS (SELECT sensor_id, capture_seq, (capture_seq // 50)::INT AS no FROM ev), c AS (SELECT *, (no <> lag(no, 1, 0) OVER w)::INT AS change FROM h WINDOW w AS (PARTITION BY sensor_id ORDER BY capture_seq)),
o AS (SELECT *, sum(change) OVER (PARTITION BY sensor_id ORDER BY capture_seq)::BIGINT AS ordinal FROM c), f AS (SELECT sensor_id, ordinal, min(no) AS frame_id FROM o GROUP BY ALL),
e AS (SELECT *, lead(frame_id) OVER (PARTITION BY sensor_id ORDER BY ordinal) AS emitted_frame_id FROM f) SELECT sensor_id, capture_seq, ordinal, e.frame_id, e.emitted_frame_id FROM o JOIN e USING (sensor_id, ordinal)""",
    "project_xyz": f"""WITH {_LUT}, w AS (SELECT row, col, src_col, enc, alt, t, (cos(enc) * cos(alt))::FLOAT AS xc, (sin(enc) * cos(alt))::FLOAT AS yc, sin(alt)::FLOAT AS zc, (t * cos(enc))::FLOAT AS xo, (t * sin(enc))::FLOAT AS yo, t::FLOAT AS d FROM lut),
p AS (SELECT event_id % 3 AS sensor_id, event_id % 16 AS row, event_id // 16 % 512 AS src_col, arg_max(user_id % 4000, event_id) AS depth FROM events GROUP BY ALL),
f AS (SELECT s.sensor_id, w.*, coalesce(p.depth, 0) AS depth FROM (SELECT DISTINCT sensor_id FROM p) s, w LEFT JOIN p ON p.sensor_id = s.sensor_id AND p.row = w.row AND p.src_col = w.src_col),
r AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (depth * 8)::FLOAT - d END::FLOAT AS r FROM f)
SELECT sensor_id, row::INT AS row, col::INT AS col, round((((r * xc)::FLOAT + xo)::FLOAT * 0.001::FLOAT)::DOUBLE, 2) + 0.0 AS x, round((((r * yc)::FLOAT + yo)::FLOAT * 0.001::FLOAT)::DOUBLE, 2) + 0.0 AS y, round((r * zc * 0.001::FLOAT)::DOUBLE, 2) + 0.0 AS z FROM r""",
    "ground_height": f"WITH {_GROUND} SELECT frame_id, round(detected, 6) + 0.0 AS detected FROM detected",
    "ground_filter": f"""WITH {_GROUND}, l AS (SELECT frame_id, list(detected) OVER (ORDER BY frame_id) AS w FROM detected),
e AS (SELECT frame_id, list_reduce(w, lambda a, b: CASE WHEN abs(a - b) < 0.5 THEN 0.5 * a + 0.5 * b ELSE b END) AS smooth FROM l)
SELECT frame_id, count(*) AS n_points, sum((valid AND height >= smooth - 0.15)::INT)::BIGINT AS ground_removed, round(max(smooth), 4) + 0.0 AS smooth FROM fl JOIN e USING (frame_id) GROUP BY 1""",
    "patch_pca": f"WITH {_SEEDS}, {_PCA} SELECT frame_id, patch, round(eig_sum, 4) + 0.0 AS eig_sum, round(eig_min, 4) + 0.0 AS eig_min, CASE WHEN a * b - d * d + a * c - e * e + b * c - f * f - 2 * eig_min * (eig_sum - eig_min) + eig_min * eig_min >= 1e-3 * eig_sum * eig_sum THEN round(normal_h, 3) + 0.0 END AS normal_h FROM fit",
}
ORACLE_SQL["project_images"] = ORACLE_SQL["project_xyz"]
ORACLE_SQL["asof_imu_stream"] = ORACLE_SQL["asof_imu"]
