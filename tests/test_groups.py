"""Groups over Arrow batches: frames that are cut by batches, and many frames in one."""

import io

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cirrostrat.functions import binary as B
from cirrostrat.operators import cluster as C
from cirrostrat.operators import groups, pack
from cirrostrat.sinks import log


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)


def sized(spark):
    sizes = [1, 7, 6, 14, 1, 30, 3]
    rows = [(f % 2 if f else None, f, i, 0.5 * i, 1.0 * f, -1.0, i % 256, f + i) for f, n in enumerate(sizes) for i in range(n)]
    return sizes, spark.createDataFrame(rows[::-1], "sensor_id long, frame_id long, pt_idx int, x float, y float, z float, intensity smallint, cluster_id long")


@pytest.mark.parametrize("clustered", [False, True])
def test_frames_are_packed_over_batches(spark, small_batches, clustered, capfd):
    sizes, points = sized(spark)
    packed = pack.pack_points(points, clustered)
    for r in (found := packed.collect()):
        i = np.arange(sizes[r.frame_id])
        columns = {"x": 0.5 * i, "y": i * 0 + r.frame_id, "z": i * 0 - 1, "intensity": i % 256, "cluster_id": r.frame_id + i}
        assert r.n_points == len(i) and bytes(r.data) == pack.pack_array(columns, clustered)
    assert sorted(r.frame_id for r in found) == list(range(len(sizes)))
    packed.explain()
    assert "FlatMapGroups" not in capfd.readouterr().out  # no call for each frame


def test_messages_as_columns(spark):
    times = [0, -1, 1_500_000_001, -1_500_000_000, 2_147_483_647_999_999_999]
    rows = spark.createDataFrame([(t, k, bytes(17 * k)) for k, t in enumerate(times)], "ts_ns long, n_points long, data binary")
    for frame in ("lidar", "a", "longer name"):
        for r in pack.with_cdr(rows, True, frame).collect():
            assert bytes(r.cdr) == pack.cloud_cdr(r.ts_ns // 10**9, r.ts_ns % 10**9, frame, r.n_points, pack.XYZCI, bytes(r.data))


def test_a_log_is_read_in_pieces(monkeypatch):
    monkeypatch.setattr(log, "HELD", 100)
    data = [(k, bytes([k]) * size) for k, size in enumerate([10, 80, 30, 500, 0, 0, 90, 20])]
    content = log._SIZE.pack(1) + b"t" + b"".join(log._RECORD.pack(k, len(m)) + m for k, m in data)
    found = list(log._records(io.BytesIO(content)))
    assert [b.num_rows for b in found] == [2, 1, 1, 3, 1]
    assert [(r["ts_ns"], r["data"]) for b in found for r in b.to_pylist()] == data
    with pytest.raises(ValueError, match="cut short"):
        list(log._records(io.BytesIO(content[:-1])))


def test_whole_groups(monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(200):
        key = np.sort(rng.integers(0, 6, int(rng.integers(0, 30))))
        rows = pa.table({"k": pa.StructArray.from_arrays([pa.array([None if v == 2 else "a" for v in key], pa.string()), pa.array(key)], ["a", "b"]), "v": pa.array(np.arange(len(key)))})
        found = list(groups.whole(iter(rows.combine_chunks().to_batches(max_chunksize=int(rng.integers(1, 9)))), "k"))
        assert [v for t in found for v in t.column("v").to_pylist()] == list(range(len(key)))
        seen = [set(t.column("k").combine_chunks().field(1).to_pylist()) for t in found]
        assert all(not a & b for i, a in enumerate(seen) for b in seen[:i])


@pytest.mark.parametrize("bridge", [2, 5])
def test_voxels_of_many_frames_at_once(bridge):
    rng = np.random.default_rng(bridge)
    frames = [np.unique(rng.integers(0, 6, (int(rng.integers(1, 40)), 3)) * [1, 1, 0], axis=0) for _ in range(60)]
    n, first = [rng.integers(1, 8, len(f)) for f in frames], [rng.permutation(len(f)) for f in frames]
    want = np.concatenate([C.voxel_labels(*each, 2, bridge) for each in zip(frames, n, first, strict=True)])
    of = np.repeat(np.arange(len(frames)), [len(f) for f in frames])
    assert C.voxel_labels(np.concatenate(frames), np.concatenate(n), np.concatenate(first), 2, bridge, of).tolist() == want.tolist()


def test_voxel_frames_over_batches(spark, small_batches, capfd):
    _, points = sized(spark)
    keyed = points.withColumn("frame_id", F.struct("sensor_id", F.col("frame_id").alias("f")))
    out = C.voxel_cluster(keyed, 1.0, 2)
    assert {r[0].f: r[1] for r in out.groupBy("frame_id").agg(F.max("cluster_id")).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 1, 6: 1}
    out.explain()
    assert "FlatMapGroups" not in capfd.readouterr().out


def test_numbers_as_bytes(spark):
    values = [0, 1, 255, 256, 65_537, (1 << 40) + 7, (1 << 63) - 1, -1, -258]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for n in (1, 2, 3, 4, 5, 6, 8):
        for v, le, be in rows.select("v", B.le_bytes(F.col("v"), n), B.be_bytes(F.col("v"), n)).collect():
            raw = (v % (1 << 8 * n)).to_bytes(n, "little")
            assert (bytes(le), bytes(be)) == (raw, raw[::-1])
