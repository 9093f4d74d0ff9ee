"""Extra columns whose names the operators use themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrostrat.operators import blocks, ground
from cirrostrat.operators import cluster as C

TAKEN = ("label", "vx", "vy", "vz", "n", "first", "__valid", "__label", "__id", "__at", "__node", "a", "b", "u", "v", "gx", "h0x", "ax", "flat", "patch", "seed", "detected", "neighbors", "own")


def scene(spark):
    xyz = np.random.default_rng(5).uniform(-2, 2, (60, 3))
    return spark.createDataFrame([(i % 2, i, *map(float, p)) for i, p in enumerate(xyz)], "frame_id long, pt_idx int, x double, y double, z double")


@pytest.mark.parametrize("name", ["voxel", "dbscan", "joins", "blocks"])
def test_clusters(spark, name):
    run = {"voxel": lambda p: C.voxel_cluster(p, 1.0, 2), "dbscan": lambda p: C.dbscan(p, 0.8, 3), "joins": lambda p: C.dbscan_by_joins(p, 0.8, 3), "blocks": lambda p: blocks.dbscan_by_blocks(p, 0.8, 3)}[name]
    plain = scene(spark)
    taken = plain.withColumns({c: F.lit(77) for c in (*TAKEN, "cluster_id")})
    out = run(taken)
    assert out.columns == [*plain.columns, *TAKEN, "cluster_id"]
    rows = out.collect()
    assert all(r[c] == 77 for r in rows for c in TAKEN)
    assert {(r.pt_idx, r.cluster_id) for r in rows} == {(r.pt_idx, r.cluster_id) for r in run(plain).collect()}


def test_ground(spark):
    points = scene(spark).withColumns({"sensor_id": F.lit(1).cast("long"), "range": F.lit(3.0), "valid": F.lit(True)})
    imu = points.select("sensor_id", "frame_id").distinct().select("*", F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(-9.81).alias("az"))
    taken = points.withColumns({c: F.lit(77) for c in (*TAKEN, "height", "smooth", "ground")})
    out = ground.ground_filter(taken, imu, 1.0)
    assert out.columns == [*points.columns, *TAKEN, "height", "smooth", "ground"]
    rows = out.collect()
    assert all(r[c] == 77 for r in rows for c in TAKEN)
    assert {(r.pt_idx, r.ground, r.smooth) for r in rows} == {(r.pt_idx, r.ground, r.smooth) for r in ground.ground_filter(points, imu, 1.0).collect()}
