"""Geometry: beam tables, range images to points, mirrors and the gravity frame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_f = lambda v: F.lit(float(v)).cast("float")
MM = 0.001


def beam_lut(calibration: DataFrame) -> DataFrame:
    """One row per pixel of a sensor's cropped window, from a one-row calibration: row, col, src_col, xc, yc, zc, xo, yo,
    range_delta, beam_z. A dimension table of rows x cols entries."""
    w0, w1 = F.element_at("window", 1), F.element_at("window", 2)
    width = w1 - w0
    left = F.array_max("shifts")
    right = width - F.abs(F.array_min("shifts"))
    base = calibration.select("*", w0.alias("w0"), width.alias("width"), left.alias("left"), right.alias("right"))
    rows = base.select("*", F.posexplode(F.arrays_zip("altitudes", "azimuths", "shifts")).alias("row", "beam"))
    pixels = rows.select("*", F.explode(F.sequence(F.col("left"), F.col("right") - 1)).alias("col"))
    shift, col = F.col("beam.shifts"), F.col("col")
    src = F.greatest(F.lit(0), F.least(col - shift, F.col("width") - 1)) + F.col("w0")
    lookup = col + F.greatest(F.col("w0") - shift, F.lit(0))
    enc = F.lit(2 * math.pi) * (1 - lookup / F.col("cols"))
    az, alt = F.lit(-2 * math.pi) * F.col("beam.azimuths") / 360, F.lit(2 * math.pi) * F.col("beam.altitudes") / 360
    t03, t23 = F.element_at("transform", 4), F.element_at("transform", 12)
    flat = {
        "xc": F.cos(enc + az) * F.cos(alt), "yc": F.sin(enc + az) * F.cos(alt), "zc": F.sin(alt),
        "xo": t03 * F.cos(enc), "yo": t03 * F.sin(enc),
        "range_delta": F.sqrt(t03 * t03 + t23 * t23), "beam_z": t23,
    }
    return pixels.select("row", "col", src.alias("src_col"), *[v.cast("float").alias(k) for k, v in flat.items()])


def project_xyz(pixels: DataFrame, lut: DataFrame, keys: tuple[str, ...] = ("sensor_id", "ordinal"), only_returns: bool = False) -> DataFrame:
    """Points of every table pixel of every frame. Missing pixels have depth 0; such points lie beside the origin, on the
    beam offset, unless ``only_returns`` drops them. The table is of fixed size and broadcast."""
    frames = pixels.select(*keys).distinct()
    wanted = frames.join(F.broadcast(lut))
    found = pixels.select(*keys, F.col("row"), F.col("col").alias("src_col"), "depth", "reflect")
    full = wanted.join(found, [*keys, "row", "src_col"], "left").withColumns({"depth": F.coalesce("depth", F.lit(0)), "reflect": F.coalesce("reflect", F.lit(0).cast("smallint"))})
    r = F.when(F.col("depth") == 0, _f(0)).otherwise((F.col("depth") * 8).cast("float") - F.col("range_delta"))
    out = full.withColumn("r", r)
    axis = lambda c, o: ((F.col("r") * F.col(c) + F.col(o)) * _f(MM)).cast("float")
    points = out.select(*keys, "row", "col", axis("xc", "xo").alias("x"), axis("yc", "yo").alias("y"), axis("zc", "beam_z").alias("z"), (F.col("r") * _f(MM)).alias("range"), F.col("reflect").alias("intensity"), "depth")
    return (points.where("depth > 0") if only_returns else points).drop("depth")


def mirrored(y: Column, z: Column, mode: str = "off") -> tuple[Column, Column]:
    """y negated for horizontal or both, z for vertical or both; for packing only."""
    if mode not in ("off", "", "horizontal", "vertical", "both"):
        raise ValueError(mode)
    return (-y if mode in ("horizontal", "both") else y), (-z if mode in ("vertical", "both") else z)


def imu_axes(ax: Column, ay: Column, az: Column) -> tuple[Column, Column, Column]:
    """Accelerometer axes as the ground filter takes them."""
    return az, -ax, -ay


def gravity_frame(df: DataFrame, ax: str = "ax", ay: str = "ay", az: str = "az") -> DataFrame:
    """``df`` with the unit gravity g and the horizontal axes h0, h1 (null where gravity is below 1e-6)."""
    m = F.sqrt(sum((F.col(c) * F.col(c) for c in (ay, az)), F.col(ax) * F.col(ax)))
    out = df.withColumn("__m", m)
    for k, c in zip("xyz", (ax, ay, az), strict=True):
        out = out.withColumn(f"g{k}", F.when(F.col("__m") >= 1e-6, F.col(c) / F.col("__m")))
    up = F.abs("gz") < 0.9  # the seed axis: z unless gravity is close to it, then x
    sx, sz = F.when(up, 0.0).otherwise(1.0), F.when(up, 1.0).otherwise(0.0)
    cross = {"h0x": -sz * F.col("gy"), "h0y": sz * F.col("gx") - sx * F.col("gz"), "h0z": sx * F.col("gy")}
    out = out.withColumns(cross)
    n = F.sqrt(F.col("h0x") ** 2 + F.col("h0y") ** 2 + F.col("h0z") ** 2)
    out = out.withColumns({c: F.col(c) / n for c in cross})
    g, h = lambda c: F.col("g" + c), lambda c: F.col("h0" + c)
    return out.withColumns({"h1x": g("y") * h("z") - g("z") * h("y"), "h1y": g("z") * h("x") - g("x") * h("z"), "h1z": g("x") * h("y") - g("y") * h("x")}).drop("__m")


def height(df: DataFrame) -> DataFrame:
    """``df`` (x, y, z and a gravity frame) with height (growing downward) and the horizontal coordinates u, v."""
    dot = lambda p: F.col("x") * F.col(f"{p}x") + F.col("y") * F.col(f"{p}y") + F.col("z") * F.col(f"{p}z")
    return df.withColumns({"height": dot("g"), "u": dot("h0"), "v": dot("h1")})
