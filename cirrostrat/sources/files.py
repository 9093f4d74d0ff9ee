"""Point files, calibration documents and generated scenes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT_13 = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("intensity", "u1")])


def _pcd(batches):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at = content.find(b"DATA binary\n")
            body = content[at + 12 :] if at >= 0 else b""
            if at < 0 or len(body) % POINT_13.itemsize:
                continue  # not a file of this kind
            p = np.frombuffer(body, dtype=POINT_13)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(p)), pa.array(np.arange(len(p), dtype=np.int32)), *[pa.array(np.ascontiguousarray(p[c])) for c in "xyz"]], names=["file", "pt_idx", "x", "y", "z"])


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    """Points of binary PCD files: file, pt_idx, x, y, z."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_pcd, "file string, pt_idx int, x float, y float, z float")


CALIBRATION = (
    "lidar_mode string, prod_sn string, prod_line string, data_format struct<columns_per_frame: int, pixels_per_column: int, columns_per_packet: int, column_window: array<int>, pixel_shift_by_row: array<smallint>, udp_profile_lidar: string>,"
    " beam_altitude_angles array<float>, beam_azimuth_angles array<float>, lidar_origin_to_beam_origin_mm float, beam_to_lidar_transform array<float>"
)
PROFILE = "RNG15_RFL8_NIR8"
_IDENTITY = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Calibration JSON documents with every missing field defaulted: rows, cols, columns_per_packet, window, shifts,
    altitudes, azimuths, transform."""
    return with_defaults(spark.read.schema(CALIBRATION).option("multiLine", True).json(path))


def with_defaults(raw: DataFrame) -> DataFrame:
    mode_cols = F.regexp_extract(F.coalesce("lidar_mode", F.lit("1024x10")), r"^(\d+)x", 1).cast("int")
    rows = F.coalesce("data_format.pixels_per_column", F.lit(64))
    cols = F.coalesce("data_format.columns_per_frame", mode_cols)
    numbered = lambda f: F.transform(F.sequence(F.lit(0), rows - 1), f)
    origin = F.coalesce("lidar_origin_to_beam_origin_mm", F.lit(27.67).cast("float")).cast("double")
    default = F.array(*[origin if i == 3 else F.lit(v) for i, v in enumerate(_IDENTITY)]).cast("array<float>")
    return raw.select(
        rows.alias("rows"),
        cols.alias("cols"),
        F.coalesce("data_format.columns_per_packet", F.lit(16)).alias("columns_per_packet"),
        F.coalesce("data_format.column_window", F.array(F.lit(0), cols - 1)).alias("window"),
        F.coalesce(F.col("data_format.pixel_shift_by_row").cast("array<int>"), numbered(lambda i: F.lit(0))).alias("shifts"),
        F.coalesce("beam_altitude_angles", numbered(lambda i: ((i.cast("double") - 31.5) * 0.7).cast("float"))).alias("altitudes"),
        F.coalesce("beam_azimuth_angles", numbered(lambda i: F.lit(0.0).cast("float"))).alias("azimuths"),
        F.coalesce("beam_to_lidar_transform", default).alias("transform"),
        F.coalesce("data_format.udp_profile_lidar", F.lit(PROFILE)).alias("profile"),
    )


def scene(spark: SparkSession, total: int, clusters: int, per_cluster: int, frames: int = 1) -> DataFrame:
    """Points in golden-angle clusters and scattered ones between, by formula."""
    golden, n = math.pi * (3 - math.sqrt(5)), F.col("pt_idx")
    which, inside = F.expr(f"pt_idx div {per_cluster}").cast("double"), n % per_cluster
    placed = n < clusters * per_cluster
    radius = F.when(placed, 2 + which * 0.5).otherwise(40 + n * 0.01)
    angle = F.when(placed, which).otherwise(n.cast("double")) * golden
    wobble = lambda f: F.when(placed, f(inside * golden) * 0.1).otherwise(0.0)
    base = spark.range(frames * total).select(F.expr(f"id div {total}").alias("frame_id"), (F.col("id") % total).cast("int").alias("pt_idx"))
    return base.select("frame_id", "pt_idx", (radius * F.cos(angle) + wobble(F.cos)).cast("float").alias("x"), (radius * F.sin(angle) + wobble(F.sin)).cast("float").alias("y"), F.when(placed, (inside % 10) * 0.02).otherwise((n % 7) * 0.5).cast("float").alias("z"), (n % 256).cast("smallint").alias("intensity"))


def waves(spark: SparkSession, total: int, frames: int = 1, reach: float = 8.0, turns: int = 40) -> DataFrame:
    """Points along a curve of sines that winds ``turns`` times within ``reach`` metres, by formula: frame_id, pt_idx, x, y,
    z, intensity. A test scene without clusters."""
    t = F.col("pt_idx") * (2 * math.pi * turns / max(1, total))
    base = spark.range(frames * total).select(F.expr(f"id div {max(1, total)}").alias("frame_id"), (F.col("id") % max(1, total)).cast("int").alias("pt_idx"))
    return base.select("frame_id", "pt_idx", (F.sin(t) * reach).cast("float").alias("x"), (F.cos(2 * t) * reach).cast("float").alias("y"), (F.col("pt_idx") * (4.0 / max(1, total))).cast("float").alias("z"), (F.col("pt_idx") % 256).cast("smallint").alias("intensity"))
