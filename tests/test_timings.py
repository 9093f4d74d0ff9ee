"""Stage timings and shedding of a live stream."""

import time

import pytest
from pyspark.sql import functions as F

from cirrostrat.operators import cluster as C
from cirrostrat.streaming import timings

SCHEMA = "sensor_id long, frame_id long, pt_idx long, x double, y double, z double"


def test_averages_are_reported_every_so_many_frames():
    found = []
    averages = timings.Averages(found.append, 10)
    for k in range(7):
        averages.add(3, {"valid": 0.3, "cluster": 0.6 + k}, 50)
    averages.add(0, {"valid": 1.0})
    assert [r["frames"] for r in found] == [12] and found[0]["points"] == 200
    assert found[0]["seconds"] == pytest.approx({"valid": 1.2 / 12, "cluster": (2.4 + 6) / 12, "total": 9.6 / 12})
    assert averages.frames == 9 and averages.sums["valid"] == pytest.approx(1.9)


def landed(spark, folder, frame_id):
    rows = [(s, frame_id, i, float(i), float(s), 1.0) for s in range(2) for i in range(4)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))


STAGES = [("valid", lambda df: df.withColumn("valid", C.valid_mask())), ("mark", lambda df: df.where("valid").withColumn("kept", F.lit(1)))]


def test_reports_agree_with_sparks_own_progress(spark, tmp_path):
    for f in range(4):
        landed(spark, tmp_path, f)
    own, spark_told, out = [], [], []
    name = f"timed_{tmp_path.name}".replace("-", "_")
    listener = timings.Progress(timings.Averages(spark_told.append, 4), name)
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = timings.run_stages(source, STAGES, lambda df, e: out.append((e, df.count())), str(tmp_path / "cp"), own.append, size=4, name=name)
        assert query.awaitTermination(120)
        end = time.time() + 20
        while len(spark_told) < 2 and time.time() < end:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert out == [(e, 8) for e in range(4)]
    assert [(r["frames"], r["points"], r["shed"]) for r in own] == [(4, 16, 0)] * 2
    assert [(r["frames"], r["points"]) for r in spark_told] == [(4, 16)] * 2
    told = [p for p in query.recentProgress if p.observedMetrics]
    for k, (mine, theirs) in enumerate(zip(own, spark_told, strict=True)):
        assert set(mine["seconds"]) == {"valid", "mark", "publish", "total"}
        assert theirs["seconds"]["addBatch"] == pytest.approx(sum(p.durationMs["addBatch"] for p in told[2 * k : 2 * k + 2]) / 4000)
        assert 0 < mine["seconds"]["total"] <= theirs["seconds"]["addBatch"]


def test_a_slow_sink_sheds_all_but_the_newest_frames(spark, tmp_path):
    """Frames that land while the sink is busy come as one micro-batch, of which each sensor's newest frame goes on."""
    landed(spark, tmp_path, 0)
    seen, told = [], []

    def slow(df, epoch):
        seen.append(sorted({(r.sensor_id, r.frame_id) for r in df.collect()}))
        if len(seen) == 1:
            for f in (1, 2, 3):
                landed(spark, tmp_path, f)

    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = timings.run_stages(source, STAGES, slow, str(tmp_path / "cp"), told.append, keep_latest=True, size=2, available_now=False)
    end = time.time() + 90
    while len(told) < 2 and time.time() < end and query.isActive:
        time.sleep(0.1)
    query.stop()
    assert seen == [[(0, 0), (1, 0)], [(0, 3), (1, 3)]]
    assert [(r["frames"], r["shed"]) for r in told] == [(2, 0), (2, 4)]


def test_frames_without_a_number_and_no_frames(spark):
    df = spark.createDataFrame([(1, None, 0, 1.0, 1.0, 1.0), (1, 2, 0, 1.0, 1.0, 1.0), (None, 3, 0, 1.0, 1.0, 1.0)], SCHEMA)
    assert [(r.sensor_id, r.frame_id) for r in timings.newest(df).collect()] == [(1, 2)]
    assert timings.newest(df.where("x < 0")).count() == 0
