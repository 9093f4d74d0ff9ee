"""Ground removal: polar patches, planarity tests and a smoothed ground height per frame."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrostrat.functions.tables import written
from cirrostrat.operators.columns import hidden, shown
from cirrostrat.operators.geometry import gravity_frame, height
from cirrostrat.operators.slices import SLICE, sliced

# The detector's grid and thresholds.
SECTORS, RINGS, MAX_RANGE, MIN_RANGE, MIN_FLAT = 16, 8, 30.0, 0.5, 0.01
SEEDS, MIN_POINTS, UPRIGHT, PLANAR, LEVEL, MIN_PATCHES = 20, 5, 0.85, 0.03, 1.0, 3
SMOOTH_GATE, SMOOTH_SHARE = 0.5, 0.5
#: Frames whose rows (some hundred bytes each) are broadcast to the points at most.
MOST_BROADCAST = 200_000


def polar_patches(points: DataFrame) -> DataFrame:
    """``points`` (valid, range, height, u, v) that take part in detection, with their patch number."""
    flat = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    gated = points.withColumn("flat", flat).where(F.col("valid") & (F.col("range") >= MIN_RANGE) & (F.col("flat") >= MIN_FLAT) & (F.col("flat") < MAX_RANGE))
    sector = F.least(F.floor((F.atan2("v", "u") + math.pi) / (2 * math.pi / SECTORS)), F.lit(SECTORS - 1))
    ring = F.least(F.floor(F.col("flat") / (MAX_RANGE / RINGS)), F.lit(RINGS - 1))
    return gated.withColumn("patch", (sector * RINGS + ring).cast("int"))


def seeds(patched: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """The (up to) twenty lowest points, that is largest heights, of each patch; ties by point index."""
    w = Window.partitionBy(*keys, "patch").orderBy(F.desc("height"), "pt_idx")
    return patched.withColumn("seed", F.row_number().over(w)).where(F.col("seed") <= SEEDS)


def patch_statistics(seeded: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Centroid and population covariance of each patch's seeds in (height, u, v)."""
    cov = {"chh": F.var_pop("height"), "cuu": F.var_pop("u"), "cvv": F.var_pop("v"), "chu": F.covar_pop("height", "u"), "chv": F.covar_pop("height", "v"), "cuv": F.covar_pop("u", "v")}
    return seeded.groupBy(*keys, "patch").agg(F.count("*").alias("n"), F.avg("height").alias("centroid"), *[v.alias(k) for k, v in cov.items()])


def plane_fit(stats: DataFrame) -> DataFrame:
    """``stats`` with eig_min, eig_sum and normal_h, the height share of the smallest eigenvector (closed form).

    Each step is a column of its own: a single expression would repeat its parts many times over."""
    c = F.col
    out = stats.withColumns({"__off": c("chu") ** 2 + c("chv") ** 2 + c("cuv") ** 2, "eig_sum": c("chh") + c("cuu") + c("cvv")})
    out = out.withColumn("__q", c("eig_sum") / 3)
    out = out.withColumn("__p", F.sqrt(((c("chh") - c("__q")) ** 2 + (c("cuu") - c("__q")) ** 2 + (c("cvv") - c("__q")) ** 2 + 2 * c("__off")) / 6))
    out = out.withColumn("__s", F.when(c("__p") > 0, c("__p")))
    out = out.withColumns({f"__{k}": (c(k) - c("__q")) / c("__s") for k in ("chh", "cuu", "cvv")} | {f"__{k}": c(k) / c("__s") for k in ("chu", "chv", "cuv")})
    x, y, z, d, e, f = (c(f"__{k}") for k in ("chh", "cuu", "cvv", "chu", "chv", "cuv"))
    out = out.withColumn("__det", x * (y * z - f * f) - d * (d * z - f * e) + e * (d * f - y * e))
    out = out.withColumn("__angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c("__det") / 2))) / 3)
    least = F.when(c("__off") < 1e-30, F.least("chh", "cuu", "cvv")).otherwise(c("__q") + 2 * c("__p") * F.cos(c("__angle") + 2 * math.pi / 3))
    out = out.withColumn("eig_min", least)
    out = out.withColumns({f"__{k}": c(k) - c("eig_min") for k in ("chh", "cuu", "cvv")})
    d, e, f = c("chu"), c("chv"), c("cuv")
    rows = ((x, d, e), (d, y, f), (e, f, z))
    for n, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        s, t = rows[i], rows[j]
        out = out.withColumns({f"__n{n}0": s[1] * t[2] - s[2] * t[1], f"__n{n}1": s[2] * t[0] - s[0] * t[2], f"__n{n}2": s[0] * t[1] - s[1] * t[0]})
    out = out.withColumns({f"__l{n}": c(f"__n{n}0") ** 2 + c(f"__n{n}1") ** 2 + c(f"__n{n}2") ** 2 for n in range(3)})
    out = out.withColumn("__best", F.greatest("__l0", "__l1", "__l2"))
    share = F.lit(None).cast("double")
    for n in (2, 1, 0):
        share = F.when(c(f"__l{n}") == c("__best"), F.abs(f"__n{n}0") / F.sqrt(f"__l{n}")).otherwise(share)
    # where no direction stands out the fallback axis is taken, which passes as upright
    out = out.withColumn("normal_h", F.when(c("__best") < 1e-30, F.lit(1.0)).otherwise(share))
    return out.select(*stats.columns, "eig_sum", "eig_min", "normal_h")


def ground_patches(fits: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Patches that are full, upright and planar and within a metre of the frame's lowest one; of frames with three or
    more such."""
    ok = (F.col("n") >= MIN_POINTS) & (F.abs("normal_h") >= UPRIGHT) & (F.col("eig_sum") >= 1e-12) & (F.col("eig_min") / F.col("eig_sum") <= PLANAR)
    frame = Window.partitionBy(*keys)
    # flags behind windows: a filter in front of them would be pushed into the fit and repeat its expressions
    marked = fits.withColumn("__ok", F.coalesce(ok, F.lit(False))).withColumn("lowest", F.max(F.when(F.col("__ok"), F.col("centroid"))).over(frame))
    marked = marked.withColumn("__level", F.col("__ok") & (F.abs(F.col("centroid") - F.col("lowest")) <= LEVEL))
    marked = marked.withColumn("patches", F.sum(F.col("__level").cast("int")).over(frame))
    return marked.where(F.col("__level") & (F.col("patches") >= MIN_PATCHES)).drop("__ok", "__level")


def upper_median(c: Column | str) -> Column:
    """The element at index n // 2 of the sorted values."""
    values = F.array_sort(F.collect_list(c))
    return F.element_at(values, F.expr("cast(count(*) div 2 as int) + 1"))


def ground_heights(seeded: DataFrame, accepted: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Detected height of each frame: the upper median of the seeds of its ground patches (128 patches of 20 at most)."""
    pooled = seeded.join(accepted.select(*keys, "patch"), [*keys, "patch"], "left_semi")
    return pooled.groupBy(*keys).agg(upper_median("height").alias("detected"))


def smooth_step(before: float | None, found: float | None) -> float | None:
    """Next smoothed height: blended where it moved less than half a metre, else replaced; kept where nothing was found."""
    if found is None:
        return before
    return SMOOTH_SHARE * before + (1 - SMOOTH_SHARE) * found if before is not None and abs(before - found) < SMOOTH_GATE else found


def settled(values: list[float | None]) -> tuple[bool, float | None]:
    """Whether the smoothed height after ``values`` is the same whatever it was before, and that height. The states that are
    possible lie between two bounds, which each blend halves until they are one number, and a jump makes one at once."""
    low, high = -math.inf, math.inf
    for v in values:
        if v is None:
            continue
        if low > v - SMOOTH_GATE and high < v + SMOOTH_GATE:
            low, high = smooth_step(low, v), smooth_step(high, v)
        elif low >= v + SMOOTH_GATE or high <= v - SMOOTH_GATE:
            low = high = v
        else:  # some states blend, some are replaced
            inner = max(low, v - SMOOTH_GATE), min(high, v + SMOOTH_GATE)
            low, high = min(v, SMOOTH_SHARE * inner[0] + (1 - SMOOTH_SHARE) * v), max(v, SMOOTH_SHARE * inner[1] + (1 - SMOOTH_SHARE) * v)
    return low == high, low if low == high else None


def folded(values: list[float | None], now: float | None) -> list[float | None]:
    """Smoothed heights of ``values`` in order, from ``now`` on."""
    out = []
    for v in values:
        now = smooth_step(now, v)
        out.append(now)
    return out


def smoothed(heights: DataFrame, sensor: str = "sensor_id", order: str = "frame_id", column: str = "detected", before: DataFrame | None = None, size: int = SLICE) -> DataFrame:
    """``heights`` (one row a frame) with smooth, folded in frame order within each sensor; ``before`` (sensor, smooth) has
    the heights to start from.

    A sensor's history is cut into slices of ``size`` frame numbers. A slice tells the height that it ends with where that
    doesn't depend on what came before it, as it doesn't after some fifty blends or one clear jump; else its values go to
    the sensor's row of slices, which is folded for the heights that slices begin with."""
    kinds, types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in heights.schema), dict(heights.dtypes)
    rows = sliced(heights, order, size)

    def values(pdf: pd.DataFrame) -> list[float | None]:
        return [None if pd.isna(v) else float(v) for v in pdf[column]]

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        found = values(pdf.sort_values(order))
        sure, end = settled(found)
        rest = [] if sure else [v for v in found if v is not None]
        return pd.DataFrame([(pdf[sensor].iloc[0], pdf["__slice"].iloc[0], end, rest)], columns=[sensor, "__slice", "__end", "__values"])

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, now, out = pdf.sort_values("__slice"), None, []
        if not pd.isna(pdf["__from"].iloc[0]):
            now = float(pdf["__from"].iloc[0])
        for end, rest in zip(pdf["__end"], pdf["__values"], strict=True):
            out.append(now)
            now = folded(list(rest), now)[-1] if len(rest) else now if pd.isna(end) else float(end)
        return pd.DataFrame({sensor: pdf[sensor], "__slice": pdf["__slice"], "__entry": pd.Series(out, index=pdf.index, dtype="float64")})

    def run(pdf: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        pdf, now = pdf.sort_values(order), plan["__entry"].iloc[0]
        out = folded(values(pdf), None if pd.isna(now) else float(now))
        return pdf.drop(columns="__slice").assign(smooth=pd.Series(out, index=pdf.index, dtype="float64"))

    slices = rows.groupBy(sensor, "__slice").applyInPandas(summary, f"{sensor} {types[sensor]}, __slice long, __end double, __values array<double>")
    start = slices.withColumn("__from", F.lit(None).cast("double")) if before is None else slices.join(before.select(sensor, F.col("smooth").alias("__from")), sensor, "left")
    plan = start.groupBy(sensor).applyInPandas(entries, f"{sensor} {types[sensor]}, __slice long, __entry double")
    return rows.groupBy(sensor, "__slice").cogroup(plan.groupBy(sensor, "__slice")).applyInPandas(run, f"{kinds}, smooth double")


def _small(rows: DataFrame) -> DataFrame:
    """A written table of one row a frame, broadcast where its checked number of rows allows it."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def ground_filter(points: DataFrame, frames: DataFrame, sensor_height: float | None = None, thickness: float = 0.15, before: DataFrame | None = None) -> DataFrame:
    """``points`` (sensor_id, frame_id, pt_idx, x, y, z, range, valid) with height, smooth and ``ground``.

    ``frames`` has one row a frame: sensor_id, frame_id and the remapped accelerations ax, ay, az (null: no IMU). Frames
    without gravity, or without a height ever, lose nothing. Per-frame rows are joined to the points by frame. ``before``
    (sensor_id, smooth) has the smoothed heights of earlier frames. Columns named as the results are replaced."""
    keys = ("sensor_id", "frame_id")
    points, names = hidden(points, (*keys, "pt_idx", "x", "y", "z", "range", "valid"))
    gravity = gravity_frame(frames.select(*keys, "ax", "ay", "az"))
    gravity = _small(written(gravity, "gravity"))
    placed = height(points.join(gravity.drop("ax", "ay", "az"), list(keys), "left"))
    if sensor_height is not None:
        found = gravity.select(*keys, F.when(F.col("gx").isNotNull(), F.lit(float(sensor_height))).alias("detected"))
    else:
        seeded = seeds(polar_patches(placed), keys)
        accepted = ground_patches(plane_fit(patch_statistics(seeded, keys)), keys)
        found = gravity.select(*keys).join(ground_heights(seeded, accepted, keys), list(keys), "left")
    levels = _small(written(smoothed(found, before=before).select(*keys, "smooth"), "levels"))
    out = placed.join(levels, list(keys), "left")
    is_ground = F.coalesce(F.col("valid") & (F.col("height") >= F.col("smooth") - thickness), F.lit(False))
    return shown(out.withColumn("ground", is_ground), names, "height", "smooth", "ground")
