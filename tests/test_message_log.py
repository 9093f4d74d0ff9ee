"""Logs of messages: read back, all or nothing, once for each name."""

import os

import pytest
from pyspark.sql import functions as F

from cirrostrat.operators import pack
from cirrostrat.sinks import log


def held(folder):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names)


def rows(df):
    return sorted((r.topic, r.ts_ns, bytes(r.data)) for r in df.collect())


def test_messages_come_back(spark, tmp_path):
    folder = str(tmp_path / "log")
    data = [(f"rt/lidar/points {k % 3}%", k, bytes([k % 256]) * (k % 40)) for k in range(200)]
    df = spark.createDataFrame(data, log.SCHEMA).repartition(5)
    assert log.read(spark, folder).collect() == []
    log.append(df, folder)
    log.append(df.limit(0), folder)
    log.append(df.where("ts_ns < 10"), folder, "again")
    log.append(df.where("ts_ns < 10"), folder, "again")  # in the log already
    assert rows(log.read(spark, folder)) == sorted(data + data[:10])
    assert os.listdir(f"{folder}/staging") == []


def test_clouds_as_bytes(spark, tmp_path):
    points = spark.createDataFrame([(1, f, i, 1.0 * i, 2.0, 3.0, 7) for f in range(3) for i in range(4)], "sensor_id long, frame_id long, pt_idx int, x float, y float, z float, intensity smallint")
    packed = pack.with_cdr(pack.pack_points(points).withColumn("ts_ns", F.col("frame_id") * 1_500_000_000))
    log.append(packed.select(F.lit("t/points").alias("topic"), "ts_ns", F.col("cdr").alias("data")), str(tmp_path / "log"))
    assert rows(log.read(spark, str(tmp_path / "log"))) == sorted(("t/points", r.ts_ns, bytes(r.cdr)) for r in packed.collect())


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "log")
    bad = spark.range(50).repartition(4).select(F.lit("t").alias("topic"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("ts_ns"), F.lit(b"x").alias("data"))
    with pytest.raises(Exception, match="broken"):
        log.append(bad, folder)
    assert held(folder) == [] and log.read(spark, folder).collect() == []


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    spark.dataSource.register(log.MessageLog)
    folder = str(tmp_path / "log")
    for k in range(2):
        spark.createDataFrame([("t", 10 * k + i, bytes([i])) for i in range(5)], log.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(log.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for checkpoint in ("cp", "cp", "other"):  # the last one runs the same micro-batches again
        query = source.writeStream.format("message_log").option("path", folder).option("commit", "s").option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert [t for _, t, _ in rows(log.read(spark, folder))] == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]
    assert os.listdir(f"{folder}/staging") == []
