"""Outliers, reused identifications, frames without IMU, and the plans from captures to clouds."""

import struct

import numpy as np
from pyspark.sql import functions as F

from cirrostrat.config import Settings
from cirrostrat.functions import tables
from cirrostrat.operators import cluster as C
from cirrostrat.operators import decode, geometry, pack
from cirrostrat.plans import clouds
from cirrostrat.sources import capture, files


def cloud(spark, xyz):
    return spark.createDataFrame([(0, i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(xyz)], "frame_id long, pt_idx int, x double, y double, z double")


def ids(df):
    return [r[0] for r in df.orderBy("pt_idx").select("cluster_id").collect()]


def test_outliers_saturate(spark):
    """Far points, infinities and NaN neither fail nor change the clusters of near ones."""
    inf, nan = float("inf"), float("nan")
    near = [(0.3, 0.4, 0.2), (0.6, 0.4, 0.2), (1.2, 0.4, 0.2), (1.4, 0.5, 0.1)]
    far = [(1e12, 3, 3), (-1e12, 3, 3), (inf, 1, 1), (1, -inf, 1), (nan, 7, 7), (3e9, -3e9, 3e9), (2_147_483_647.5, 0, 0), (-2_147_483_648.0, 0, 0)]
    for algorithm in (lambda p: C.voxel_cluster(p, 1.0, 2), lambda p: C.dbscan(p, 0.9, 2), lambda p: C.dbscan(p, 0.9, 2, 3), lambda p: C.dbscan_by_joins(p, 0.9, 2)):
        assert ids(algorithm(cloud(spark, near + far)))[:4] == [1] * 4
    got = C.voxel_histogram(cloud(spark, far[:1]).withColumns({c: F.col(c).cast("float") for c in "xyz"}), 0.001).first()
    assert got["vx"] == 2_147_483_647


def test_lookup_at_large_spans():
    """The product of three spans is far above 64 bits."""
    big = 2**31 - 2
    vox = np.array([(0, 0, 0), (1, 0, 0), (big, -big, big), (-big, big, -big), (big, big, 1 - big)], dtype=np.int64)
    n, first = np.full(5, 4), np.arange(5, dtype=np.int64)
    assert C.voxel_labels(vox, n, first, 2, 2).tolist() == [1, 1, 2, 3, 4]
    rng = np.random.default_rng(1)
    cells = np.unique(rng.integers(-3, 3, (40, 3)) * [10**15, 1, 7 * 10**14], axis=0)
    wanted = np.vstack([cells[::3], cells + 1, cells[:2]])
    index = {tuple(c): i for i, c in enumerate(cells.tolist())}
    assert C._lookup(cells, wanted).tolist() == [index.get(tuple(w), -1) for w in wanted.tolist()]


def test_cluster_sizes_are_the_labels_counts(spark):
    xyz = np.vstack([np.random.default_rng(7).uniform(0.1, 6, (300, 3)), np.zeros((4, 3))])
    p = cloud(spark, xyz)
    for bridge in (0, 4):
        want = {tuple(r) for r in C.voxel_cluster(p, 1.0, 3, bridge).groupBy("cluster_id").count().collect()}
        assert {(r["cluster_id"], r["n_points"]) for r in C.voxel_cluster_sizes(p, 1.0, 3, bridge).collect()} == want


def test_identifications_come_again(spark, tmp_path):
    """Three datagrams with one identification: two in a row, one after a pause, and one of them without its end."""
    bodies = [bytes([k]) * 900 for k in range(4)]
    parts = [capture.ethernet_udp(b, ident=5, mtu=400) for b in bodies]
    times = [0, 1, 2, 3, 4, 5, 100, 101, 200, 201, 202]
    links = parts[0] + parts[1] + parts[2][:2] + parts[3][::-1]
    (tmp_path / "a.pcap").write_bytes(capture.write_pcap([(t * 1_000_000_000, x) for t, x in zip(times, links, strict=True)]))
    rows = capture.read_packets(spark, str(tmp_path)).orderBy("capture_seq").collect()
    assert [bytes(r["payload"]) for r in rows if r["error"] is None] == [bodies[0], bodies[1], bodies[3]]
    assert [r["error"] for r in rows] == [None, None, "fragments missing", None]


def test_frames_without_imu_keep_their_ids(spark):
    """Two frames alike; only the one with an IMU value is relabelled."""
    rng = np.random.default_rng(3)
    floor, box = np.column_stack([rng.uniform(2, 18, 500), rng.uniform(-7, 7, 500), rng.normal(-1.4, 0.01, 500)]), rng.uniform(0, 0.3, (60, 3)) + [6, 2, 0.2]
    xyz = np.vstack([floor, box])
    rows = [(1, f, i, *map(float, p), float(np.linalg.norm(p)), 9) for f in (0, 1) for i, p in enumerate(xyz)]
    points = spark.createDataFrame(rows, "sensor_id long, frame_id long, pt_idx int, x double, y double, z double, range double, intensity int")
    imu = spark.createDataFrame([(1, 0, 0.0, 0.0, -9.8), (1, 1, None, None, None)], "sensor_id long, frame_id long, accel_x double, accel_y double, accel_z double")
    # the filter takes the remapped axes (z, -x, -y), so gravity that points along the filter's z comes from accel_y
    imu = imu.select("sensor_id", "frame_id", F.lit(0.0).alias("accel_x") if False else (F.col("accel_x") * 0).alias("accel_x"), (-F.col("accel_z")).alias("accel_y"), (F.col("accel_z") * 0).alias("accel_z"))
    settings = Settings(clustering="voxel", cluster_eps=500, ground_filter=True)
    out = clouds.labelled(points, settings, imu)
    kinds = {(r["frame_id"], r["cluster_id"]): r["n"] for r in out.where("pt_idx >= 500").groupBy("frame_id", "cluster_id").agg(F.count("*").alias("n")).collect()}
    assert kinds[0, 2] > 50 and not any(c == 1 for f, c in kinds if f == 0)
    removed = {r["frame_id"]: r["n"] for r in out.where("pt_idx < 500 and cluster_id = 1 and ground").groupBy("frame_id").agg(F.count("*").alias("n")).collect()}
    assert removed[0] > 375 and 1 not in removed
    assert out.where("frame_id = 1").agg(F.max("cluster_id")).first()[0] >= 1


def msop(count, second, radii):
    body = b"".join(struct.pack(">HHhhhBB", 0, r, 16384, -16384, 23170, 40 + k, 0) for k, r in enumerate(radii)).ljust(96 * 12, b"\0")
    return decode.MSOP_SYNC + struct.pack(">H", count) + b"\0\0\x05\0" + second.to_bytes(6, "big") + struct.pack(">I", 7) + b"\0" * 11 + bytes([90]) + body + b"\0" * 16


def difop(accel):
    raw = bytearray(256)
    raw[:8], raw[208:232] = decode.DIFOP_SYNC, struct.pack(">6f", *accel, 0, 0, 0)
    return bytes(raw)


def test_counted_capture_to_clouds(spark, tmp_path):
    """A capture of three frames and device packets: two whole frames without the packets that show a boundary."""
    counts = [3, 4, 5, 0, 1, 2, 0, 1]
    links = []
    for n, c in enumerate(counts):
        links += capture.ethernet_udp(msop(c, 100 + n, [200 + 10 * n + k for k in range(4)]), src="10.0.0.9", src_port=6699)
        links += capture.ethernet_udp(difop((0.0, 9.8, 0.1 * n)), src="10.0.0.9", src_port=7788, dst_port=7788)
    links += capture.ethernet_udp(msop(9, 1, [1]), src="10.0.0.9", src_port=4444, dst_port=4444)
    (tmp_path / "e.pcap").write_bytes(capture.write_pcap([(n * 1_000_000_000, x) for n, x in enumerate(links)]))
    packets, settings = capture.read_packets(spark, str(tmp_path)), Settings(clustering="voxel", cluster_eps=1000, cluster_minpts=2)
    points = clouds.counted_points(packets, settings)
    assert {(r["frame_id"], r["n"]) for r in points.groupBy("frame_id").agg(F.count("*").alias("n")).collect()} == {(0, 12), (1, 8)}
    assert clouds.counted_points(packets, settings, capacity=5).count() == 10
    assert clouds.counted_points(packets, settings, capacity=None).count() == 20
    first = points.orderBy("frame_id", "pt_idx").first()
    assert np.allclose([first[c] for c in ("x", "y", "z", "range")], [0.5, -0.5, 23170 / 32768, 1.0], atol=1e-4) and first["intensity"] == 40
    imu = clouds.frame_imu(points, clouds.difop(packets, settings))
    # a frame sees the last device packet at or before its last point: packets alternate, so that of the point before
    assert {(r["frame_id"], round(r["accel_z"], 3)) for r in imu.collect()} == {(0, 0.1), (1, 0.4)}
    labels = clouds.labelled(points, settings)
    message = clouds.clouds(labels, settings, True).orderBy("frame_id").first()
    back = np.frombuffer(bytes(message["message"]["data"]), dtype=pack.XYZCI)
    want = labels.where("frame_id = 0").orderBy("pt_idx").toPandas()
    assert message["message"]["width"] == 12 and message["message"]["row_step"] == 12 * 17
    assert np.allclose(back["x"], want["x"]) and back["cluster_id"].tolist() == want["cluster_id"].tolist() and back["reflect"].tolist() == want["intensity"].tolist()
    assert message["message"]["header"]["stamp"]["sec"] == 4


def ouster(frame, columns, rows=2):
    head = struct.pack("<HH", 1, frame).ljust(32, b"\0")
    return head + b"".join(struct.pack("<QHBB", 5, m, 1, 0) + b"".join(struct.pack("<HBB", 500 + m, 10 + r, 0) for r in range(rows)) for m in columns)


def test_numbered_capture_to_points(spark, tmp_path):
    """Frames 7 and 8 of a two-row sensor, fragmented; the run open at the end isn't a frame."""
    links = []
    for n, (frame, columns) in enumerate([(7, (0, 1)), (7, (2, 3)), (8, (0, 1)), (8, (2, 3)), (9, (0, 1))]):
        links += capture.ethernet_udp(ouster(frame, columns), src="10.0.0.3", src_port=7502, ident=n, mtu=40)
    (tmp_path / "o.pcap").write_bytes(capture.write_pcap([(n * 1_000_000, x) for n, x in enumerate(links)]))
    raw = spark.createDataFrame([('{"data_format": {"pixels_per_column": 2, "columns_per_frame": 4, "columns_per_packet": 2}, "lidar_mode": "512x10"}',)], "j string").select(F.from_json("j", files.CALIBRATION).alias("c")).select("c.*")
    calibration = files.with_defaults(raw)
    points = clouds.numbered_points(capture.read_packets(spark, str(tmp_path)), calibration, Settings())
    window = geometry.beam_lut(calibration).count()
    assert {(r["emitted_frame_id"], r["n"]) for r in points.groupBy("emitted_frame_id").agg(F.count("*").alias("n")).collect()} == {(8, window), (9, window)}
    p = points.where("row = 1 and col = 1").first()
    assert abs(p["range"] - (501 * 8 - 27.67) / 1000) < 1e-4 and p["intensity"] == 11


def test_scratch_tables_are_removed(spark, tmp_path):
    df = tables.written(spark.range(3), "some")
    assert df.count() == 3 and tables.clear(spark) >= 1 and tables.clear(spark) == 0
