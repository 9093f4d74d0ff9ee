import numpy as np
import pytest

from cirrostrat.operators import ground
from cirrostrat.operators.ground import smooth_step
from cirrostrat.streaming import frames as S


def scene(spark, floor, objects, tilt=False):
    rng = np.random.default_rng(1)
    f = np.column_stack([rng.uniform(2, 20, 400), rng.uniform(-8, 8, 400), floor + rng.normal(0, 0.01, 400)])
    o = np.column_stack([rng.uniform(2, 20, 100), rng.uniform(-8, 8, 100), objects + rng.normal(0, 0.05, 100)])
    p = np.vstack([f, o])
    if tilt:
        c = 2**-0.5
        p = p @ np.array([[1, 0, 0], [0, c, c], [0, -c, c]])
    rows = [(1, 0, i, *map(float, x), float(np.linalg.norm(x)), True) for i, x in enumerate(p)]
    return spark.createDataFrame(rows, "sensor_id long, frame_id long, pt_idx int, x double, y double, z double, range double, valid boolean")


def removed(df):
    rows = df.collect()
    return sum(r["ground"] for r in rows if r["pt_idx"] < 400) / 400, sum(r["ground"] for r in rows if r["pt_idx"] >= 400) / 100


@pytest.mark.parametrize(("g", "tilt"), [((0.0, 0.0, -9.81), False), ((0.0, 6.94, -6.94), True)])
def test_floor_goes_objects_stay(spark, g, tilt):
    imu = spark.createDataFrame([(1, 0, *g)], "sensor_id long, frame_id long, ax double, ay double, az double")
    floor, objects = removed(ground.ground_filter(scene(spark, -1.5, 0.0, tilt), imu, thickness=0.1))
    assert floor > 0.75 and objects < 0.25


def test_known_height_and_no_imu(spark):
    p = scene(spark, -1.2, 0.0)
    imu = spark.createDataFrame([(1, 0, 0.0, 0.0, -9.81)], "sensor_id long, frame_id long, ax double, ay double, az double")
    assert removed(ground.ground_filter(p, imu, sensor_height=1.2))[0] > 0.9
    assert removed(ground.ground_filter(p, imu.selectExpr("sensor_id", "frame_id", "0.0D ax", "0.0D ay", "0.0D az"))) == (0, 0)


def test_smoothing(spark):
    assert [smooth_step(None, 1.0), smooth_step(1.0, 1.2), smooth_step(1.0, 2.0), smooth_step(1.0, None)] == [1.0, 1.1, 2.0, 1.0]


def test_plane_fit_matches_numpy(spark):
    rng, rows, expected = np.random.default_rng(2), [], []
    for i in range(20):
        m = np.cov(rng.normal(size=(3, 9)) * [[0.1], [1], [2]], bias=True)
        w, v = np.linalg.eigh(m)
        rows.append((i, 9, 0.0, *map(float, (m[0, 0], m[1, 1], m[2, 2], m[0, 1], m[0, 2], m[1, 2]))))
        expected.append((w[0], abs(v[0, 0])))
    df = spark.createDataFrame(rows, "patch int, n int, centroid double, chh double, cuu double, cvv double, chu double, chv double, cuv double")
    got = [(r["eig_min"], r["normal_h"]) for r in ground.plane_fit(df).orderBy("patch").collect()]
    assert np.allclose(got, expected, atol=1e-6)


def test_streaming_assembly(spark, tmp_path):
    schema = "sensor_id long, capture_seq long, pkt_cnt int, n_points int"
    for part, counts in enumerate([[5, 6, 0], [1, 2, 0, 1]]):
        spark.createDataFrame([(1, part * 10 + i, c, 1) for i, c in enumerate(counts)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.available(S.assemble_stream(src).writeStream.format("memory").queryName("frames_out").option("checkpointLocation", str(tmp_path / "cp")), spark)
    assert q.awaitTermination(60)
    got = {tuple(r) for r in spark.table("frames_out").collect()}
    assert (1, 0, 0) in got and (1, 0, 1) in got and (1, 1, 11) in got
