"""Settings to outputs, device requests, and streams that keep state from one micro-batch to the next."""

import json

import pytest

from cirrostrat.config import Settings
from cirrostrat.functions import binary
from cirrostrat.plans import clouds
from cirrostrat.sources import capture, files
from cirrostrat.streaming import frames as S
from tests.test_engine_cases import difop, msop


def streamed(spark, tmp_path, parts, schema, plan):
    """Rows that the plan gives for a stream with a micro-batch a part."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    name = f"out_{tmp_path.name}".replace("-", "_")
    query = S.available(plan(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")), spark)
    assert query.awaitTermination(60)
    return {tuple(r) for r in spark.table(name).collect()}


def test_numbered_stream(spark, tmp_path):
    got = streamed(spark, tmp_path, [[(1, 0, 4), (1, 1, 4), (2, 9, 0)], [(1, 3, 5), (1, 2, 4), (1, 4, 6)]], "sensor_id long, capture_seq long, header_frame_id int", S.numbered_stream)
    assert got == {(1, 1, 4, 5, 0), (1, 1, 4, 5, 1), (1, 1, 4, 5, 2), (1, 2, 5, 6, 3)}


def test_latest_imu_stream(spark, tmp_path):
    first = [(1, 5, 0, None, None, None), (1, 6, None, 1.0, 2.0, 3.0), (1, 6, 1, None, None, None)]
    second = [(1, 8, None, None, 1.0, 1.0), (1, 9, 2, None, None, None), (1, 11, 3, None, None, None), (1, 10, None, 4.0, 5.0, 6.0)]
    got = streamed(spark, tmp_path, [first, second], "sensor_id long, ts_ns long, frame_id long, accel_x double, accel_y double, accel_z double", S.latest_imu_stream)
    assert got == {(1, 0, 5, None, None, None), (1, 1, 6, 1.0, 2.0, 3.0), (1, 2, 9, 1.0, 2.0, 3.0), (1, 3, 11, 4.0, 5.0, 6.0)}


def test_changes_stream(spark, tmp_path):
    got = streamed(spark, tmp_path, [[(1, 0, 7, "a"), (1, 1, 7, "a")], [(1, 2, 7, "a"), (1, 3, 7, None), (1, 4, 8, None)]], "sensor_id long, capture_seq long, port int, mode string", lambda s: S.changes_stream(s, ("port", "mode")))
    assert {(s, o) for s, o, _ in got} == {(1, 0), (1, 3), (1, 4)}


def test_settings_to_outputs(spark, tmp_path):
    links = []
    for n, c in enumerate([3, 4, 0, 1, 2, 0]):
        links += capture.ethernet_udp(msop(c, 50 + n, [200, 210, 220]), src="10.0.0.9")
        links += capture.ethernet_udp(difop((0.0, 9.8, 0.0)), src="10.0.0.9", src_port=7788, dst_port=7788)
    (tmp_path / "e.pcap").write_bytes(capture.write_pcap([(n * 1_000_000_000, x) for n, x in enumerate(links)]))
    packets = capture.read_packets(spark, str(tmp_path))
    settings = Settings.read({"sensor": "robosense", "clustering": "voxel", "topic": "t", "tf_vec": "1,2 3", "base_frame_id": "car"}, {})
    out = clouds.outputs(packets, settings)
    assert set(out) == {"t/points", "t/clusters", "t/imu", "rt/tf_static"}
    assert {r["frame_id"]: r["message"]["width"] for r in out["t/points"].collect()} == {0: 6, 1: 6}
    assert out["t/imu"].count() == 6 and out["t/imu"].first()["message"]["linear_acceleration"]["y"] == pytest.approx(9.8, abs=1e-5)
    place = out["rt/tf_static"].first()
    assert place["frame_id"] == "car" and tuple(place["translation"]) == (1.0, 2.0, 3.0) and place["rotation"]["w"] == 1.0
    newest = clouds.outputs(packets, Settings(sensor="robosense", clustering="voxel", keep_latest=True))
    assert [r["frame_id"] for r in newest["rt/lidar/clusters"].collect()] == [1] and newest["rt/lidar/points"].count() == 2
    found = clouds.outputs(packets, Settings(sensor="robosense", discover=True))
    assert [r["sensor_id"] for r in found["sensors"].collect()] == ["10.0.0.9"]
    with pytest.raises(ValueError, match="calibration"):
        clouds.outputs(packets, Settings())


def test_device_requests_and_names(spark):
    body = json.loads(clouds.device_request(spark, Settings(azimuth="30 330", timestamp_mode="ptp1588"), "10.0.0.1").first()["body"])
    assert body == {"udp_dest": "10.0.0.1", "lidar_mode": "1024x10", "timestamp_mode": "TIME_FROM_PTP_1588", "azimuth_window": [30_000, 330_000]}
    for bad in ({"azimuth": "1"}, {"timestamp_mode": "noon"}):
        with pytest.raises(ValueError):
            clouds.device_request(spark, Settings(**bad), "x")
    with pytest.raises(ValueError):
        Settings.read({"sensor": "radar"}, {})
    names = spark.createDataFrame([("Ouster", "TIME_FROM_SYNC_PULSE_IN"), (" robosense", "internal"), ("radar", None)], "s string, m string")
    assert [tuple(r) for r in names.select(binary.sensor_type("s"), binary.timestamp_setting("m")).collect()] == [("ouster", "sync_pulse_in"), ("robosense", None), (None, None)]
    scene = files.waves(spark, 100, 2)
    assert scene.count() == 200 and scene.where("abs(x) <= 8 and abs(y) <= 8 and z between 0 and 4").count() == 200 and files.waves(spark, 0).count() == 0
