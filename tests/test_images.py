"""Range images by arrays against the joins."""

import random

import pytest

from cirrostrat.operators import frames, geometry, images
from cirrostrat.sources import files

PIXELS = "sensor_id long, ordinal long, row int, col int, col_in_packet int, capture_seq long, depth int, reflect smallint, note string"


def pixels(spark, seed=5):
    rng, rows = random.Random(seed), []
    for sensor, ordinal, n in ((0, 0, 900), (0, 1, 1), (1, 0, 2_000), (None, 3, 50)):
        rows += [(sensor, ordinal, rng.randrange(16), rng.randrange(512), k % 16, k // 16, rng.choice([0, rng.randrange(1, 30_000), 524_287]), rng.randrange(256), "x") for k in range(n)]
    return spark.createDataFrame(rows, PIXELS)


def table(spark):
    shifts = ", ".join(str(i % 4 * 3 - 4) for i in range(16))
    raw = spark.createDataFrame([('{"lidar_mode": "512x10", "data_format": {"pixels_per_column": 16, "pixel_shift_by_row": [' + shifts + "]}}",)], "j string")
    from pyspark.sql import functions as F

    return geometry.beam_lut(files.with_defaults(raw.select(F.from_json("j", files.CALIBRATION).alias("c")).select("c.*")))


@pytest.mark.parametrize("only_returns", [False, True])
def test_projection_is_that_of_the_joins(spark, only_returns):
    px, lut = frames.scatter(pixels(spark)).where("sensor_id is not null"), table(spark)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = geometry.project_xyz(px, lut, only_returns=only_returns)
    got = images.project(px, lut, only_returns=only_returns)
    assert got.dtypes == want.dtypes
    assert rows(got) == rows(want)


def test_images_hold_each_pixel_at_its_place(spark):
    px = frames.scatter(pixels(spark))
    want = {(r.sensor_id, r.ordinal, r.row, r.col): (r.depth, r.reflect) for r in px.collect()}
    got = images.range_images(px, 16, 512).collect()
    assert {(r.sensor_id, r.ordinal) for r in got} == {k[:2] for k in want} and len(got) == 4
    for r in got:
        assert len(r.depth) == len(r.reflect) == 16 * 512
        for at, pair in enumerate(zip(r.depth, r.reflect, strict=True)):
            assert pair == want.get((r.sensor_id, r.ordinal, at // 512, at % 512), (0, 0))


def test_pixels_without_depth_or_place_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, 0, 5, None, 9), (1, 0, 0, 60, 40, None), (1, 0, None, 6, 40, 1), (1, 0, 99, 6, 40, 1)], "sensor_id long, ordinal long, row int, col int, depth int, reflect smallint")
    assert sum(images.range_images(df, 16, 512).first().depth) == 40
    assert images.project(df, table(spark), only_returns=True).count() == 1
    assert images.project(df.where("row = 7"), table(spark)).count() == images.range_images(df.where("row = 7"), 16, 512).count() == 0


def test_a_table_too_large_to_send_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(images, "MOST_BEAMS", 100)
    with pytest.raises(ValueError):
        images.project(pixels(spark), table(spark))
