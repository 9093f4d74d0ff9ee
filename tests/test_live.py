"""The live stream against the batch plan, in several cuts of micro-batches and over restarts."""

import random
import types

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cirrostrat.config import Settings
from cirrostrat.operators import ground, pack
from cirrostrat.plans import clouds
from cirrostrat.sinks import log
from cirrostrat.sources import files
from cirrostrat.streaming import live
from tests.test_engine_cases import difop, msop, ouster
from tests.test_event_time import Handle

SCHEMA = "src_ip string, src_port int, dst_port int, capture_seq long, ts_ns long, payload binary"


def counted_packets(sensors=2, n=36, seed=1):
    """Frames of three or four packets and device packets between them, of several sensors one after another."""
    rng, rows, seq = random.Random(seed), [], 0
    count = {s: rng.randrange(3) for s in range(sensors)}
    for k in range(n):
        s = k % sensors
        ip = f"10.0.0.{s}"
        if rng.random() < 0.3:
            rows.append((ip, 7788, 7788, seq, seq * 1_000, difop((9.8, rng.random(), rng.random()) if rng.random() < 0.8 else (float("nan"), 0.0, 0.0))))
            seq += 1
        rows.append((ip, 6699, 6699, seq, seq * 1_000, msop(count[s], 50 + k, [200 + 3 * k % 40, 210, 220 + k % 7])))
        seq += 1
        count[s] = 0 if count[s] >= 3 else count[s] + 1
    return rows


def landed(spark, folder, parts):
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def cut(rows, size):
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def messages(df):
    return sorted((r.sensor_id, r.frame_id, r.n_points, bytes(r.data), r.ts_ns, str(r.message.header)) for r in df.collect())


@pytest.mark.parametrize("size", [1_000, 16])
def test_counted_stream_is_the_batch_plan(spark, tmp_path, size):
    rows = counted_packets()
    settings = Settings(sensor="robosense", clustering="voxel", cluster_eps=1_000, cluster_minpts=2, topic="t", ground_filter=True, sensor_height=1.0, mirror="both")
    landed(spark, tmp_path, cut(rows, size))
    query = live.run(stream(spark, tmp_path), settings, str(tmp_path / "out"), str(tmp_path / "cp"), messages=str(tmp_path / "log"))
    assert query.awaitTermination(300)
    want = clouds.outputs(spark.createDataFrame(rows, SCHEMA), settings)
    sent = {(r.topic, bytes(r.data)) for r in log.read(spark, str(tmp_path / "log")).collect()}
    assert sent == {(t, bytes(r.cdr)) for t in ("t/points", "t/clusters") for r in pack.with_cdr(want[t].drop("message"), t == "t/clusters", settings.frame_id).collect()}
    for topic in ("t/points", "t/clusters"):
        found = spark.read.parquet(str(tmp_path / "out" / topic))
        assert messages(found) == messages(want[topic]) and found.count() > 3
    imu = spark.read.parquet(str(tmp_path / "out" / "t/imu"))
    assert sorted(str(r.message) for r in imu.collect()) == sorted(str(r.message) for r in want["t/imu"].collect())


def test_restart_from_the_checkpoint(spark, tmp_path):
    rows = counted_packets(1, 24, 4)
    settings = Settings(sensor="robosense", clustering="dbscan", cluster_eps=900, cluster_minpts=2, topic="t", ground_filter=True, sensor_height=1.5)
    for part in cut(rows, 12):  # each part is a run of its own
        landed(spark, tmp_path, [part])
        query = live.run(stream(spark, tmp_path), settings, str(tmp_path / "out"), str(tmp_path / "cp"))
        assert query.awaitTermination(300)
    want = clouds.outputs(spark.createDataFrame(rows, SCHEMA), settings)["t/clusters"]
    assert messages(spark.read.parquet(str(tmp_path / "out" / "t/clusters"))) == messages(want)


def test_numbered_stream_is_the_batch_plan(spark, tmp_path):
    raw = '{"data_format": {"pixels_per_column": 2, "columns_per_frame": 4, "columns_per_packet": 2}, "lidar_mode": "512x10"}'
    calibration, rows = files.with_defaults(spark.createDataFrame([(raw,)], "j string").select(F.from_json("j", files.CALIBRATION).alias("c")).select("c.*")), []
    for seq, (frame, column) in enumerate([(4, 0), (4, 2), (5, 0), (5, 2), (5, 0), (6, 2), (9, 0), (9, 2), (2, 0)]):
        rows.append(("10.0.0.7", 7502, 7502, seq, None if seq in (1, 3) else seq * 10 + 2**60, ouster(frame, (column, column + 1))))
    settings = Settings(topic="t")
    landed(spark, tmp_path, cut(rows, 2))
    query = live.run(stream(spark, tmp_path), settings, str(tmp_path / "out"), str(tmp_path / "cp"), calibration)
    assert query.awaitTermination(300)
    want = clouds.outputs(spark.createDataFrame(rows, SCHEMA), settings, calibration)["t/points"]
    assert messages(spark.read.parquet(str(tmp_path / "out" / "t/points"))) == messages(want)


def test_smoothed_heights_go_on_from_those_before(spark):
    rng = random.Random(3)
    rows = [(s, f, rng.choice([None, rng.uniform(0, 2)])) for s in range(3) for f in range(20)]
    df = spark.createDataFrame(rows, "sensor_id long, frame_id long, detected double")
    whole = {(r.sensor_id, r.frame_id): r.smooth for r in ground.smoothed(df).collect()}
    first = ground.smoothed(df.where("frame_id < 8"))
    before = first.groupBy("sensor_id").agg(F.max_by("smooth", "frame_id").alias("smooth"))
    rest = ground.smoothed(df.where("frame_id >= 8"), before=before)
    assert {(r.sensor_id, r.frame_id): r.smooth for r in first.union(rest).collect()} == whole


def test_packets_come_out_in_pieces():
    """A sensor's packets of one micro-batch: no table with the payloads of all of them is made."""
    n = 10_000
    processor, handle = live._Frames(True, False, 1_000, 0), Handle()
    processor.init(handle)
    rows = pd.DataFrame({"capture_seq": range(n), "ts_ns": 5, "device": False, "mark": [k % 12 for k in range(n)], "payload": [bytes(32) + b"\0\0\0\1" + bytes(1_164)] * n})
    given = list(processor.handleInputRows(("s",), iter([rows]), types.SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0)))
    assert max(map(len, given)) <= live.GIVEN
    found = pd.concat(given)
    assert found["capture_seq"].tolist() == [k for k in range(n // 12 * 12) if k % 12 or not k] and set(found["kind"]) == {live.PACKET}
