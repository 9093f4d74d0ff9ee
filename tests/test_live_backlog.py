"""A backlog of the live stream: how often it starts, and how many tasks its steps have."""

import json

import duckdb
import numpy as np

from cirrostrat.config import Settings
from cirrostrat.operators import pack
from cirrostrat.plans import registry
from cirrostrat.streaming import live
from tests.test_live import counted_packets, landed, stream

SF = "/root/testdata/sf0.001"


def test_many_pieces_take_three_runs(spark, monkeypatch):
    """Five pieces, each a micro-batch: the stream starts three times, and rows are those of the SQL."""
    runs, run = [], live.run
    monkeypatch.setattr(live, "PIECE", 200)
    monkeypatch.setattr(live, "run", lambda *a, **k: runs.append(run(*a, **k)) or runs[-1])
    found = sorted(tuple(r) for r in registry.QUERIES["live_clouds"](spark, SF).collect())
    batches = [sum(p["numInputRows"] > 0 for p in q.recentProgress) for q in runs]
    assert len(runs) == 3 and sum(batches) == 5
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{SF}/events.parquet'")
    assert found == sorted(db.sql(registry.ORACLE_SQL["live_clouds"]).fetchall())


def test_steps_of_a_stream_have_few_tasks(spark, tmp_path):
    """The session's many shuffle partitions aren't those of a stream with a handful of sensors, and stay the session's."""
    before = spark.conf.get(live.PARTITIONS)
    spark.conf.set(live.PARTITIONS, "150")
    try:
        landed(spark, tmp_path, [counted_packets(1, 8)])
        query = live.run(stream(spark, tmp_path), Settings(sensor="robosense", topic="t"), str(tmp_path / "out"), str(tmp_path / "cp"))
        assert query.awaitTermination(300) and spark.conf.get(live.PARTITIONS) == "150"
    finally:
        spark.conf.set(live.PARTITIONS, before)
    kept = json.loads((tmp_path / "cp/offsets/0").read_text().splitlines()[1])["conf"]
    assert int(kept[live.PARTITIONS]) <= 3 * spark.sparkContext.defaultParallelism


def test_clouds_of_all_sizes_are_read_back(spark):
    rng, sizes = np.random.default_rng(1), [0, 3, 0, pack.UNPACKED + 5, 1, 2, 40_000, 70_000, 0]
    records = [np.frombuffer(rng.integers(0, 100, n * pack.XYZI.itemsize, dtype=np.uint8).tobytes(), pack.XYZI) for n in sizes]
    packed = spark.createDataFrame([(1, k, bytearray(r.tobytes())) for k, r in enumerate(records)], "sensor_id long, frame_id long, data binary").coalesce(1)
    found = pack.unpacked(packed).orderBy("frame_id", "pt_idx").toPandas()
    assert found["frame_id"].tolist() == np.repeat(np.arange(len(sizes)), sizes).tolist()
    assert found["pt_idx"].tolist() == [i for n in sizes for i in range(n)]
    for name in pack.XYZI.names:
        assert (found[name].to_numpy() == np.concatenate([r[name] for r in records])).all()
