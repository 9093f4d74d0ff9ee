"""As-of joins, change detection, discovery and frame statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrostrat.operators.slices import SLICE, SLICE_NS, latest, runs


def latest_imu(frames: DataFrame, imu: DataFrame, sensor: str = "sensor_id", ts: str = "ts_ns", columns: tuple[str, ...] = ("accel_x", "accel_y", "accel_z"), size: int = SLICE_NS) -> DataFrame:
    """``frames`` with the last IMU row at or before their time: a union and a running last value over slices of ``size``
    of time, one shuffle."""
    value = F.struct(*columns)
    left = frames.select(sensor, ts, F.struct(*[c for c in frames.columns]).alias("f"), F.lit(None).cast(imu.select(value.alias("v")).schema["v"].dataType).alias("v"))
    right = imu.select(sensor, ts, F.lit(None).cast(left.schema["f"].dataType).alias("f"), value.alias("v"))
    seen = latest(left.unionByName(right).withColumn("late", F.col("f").isNotNull()), sensor, (F.col(ts), F.col("late")), ts, "v", size)
    return seen.where("late").select("f.*", "v.*")


def changes(rows: DataFrame, key: str, order: str, columns: tuple[str, ...], size: int = SLICE) -> DataFrame:
    """Rows whose columns differ from the row before of their key (the first row included)."""
    found = runs(rows.withColumn("__now", F.struct(*columns)), key, order, "__now", lambda now, before: ~before.eqNullSafe(now), size=size)
    return found.where(F.col("__before").isNull() | F.col("__start")).select(*rows.columns)


def discover_first(rows: DataFrame, key: str = "src_ip", order: str = "capture_seq") -> DataFrame:
    """The first row of each sender, pre-aggregated before the shuffle."""
    first = F.min_by(F.struct(*rows.columns), F.col(order)).alias("r")
    return rows.groupBy(F.col(key).alias("__key")).agg(first).select("r.*")


def enriched(services: DataFrame, info: DataFrame, key: str = "serial") -> DataFrame:
    """Announced services with what their sensors tell, where they do."""
    return services.join(info, key, "left")


def discovered(passive: DataFrame, announced: DataFrame) -> DataFrame:
    return passive.unionByName(announced, allowMissingColumns=True)


def latest_frame(frames: DataFrame, sensor: str = "sensor_id", frame: str = "frame_id") -> DataFrame:
    """Only the newest frame of each sensor (load shedding; off by default)."""
    return frames.groupBy(F.col(sensor).alias("__s")).agg(F.max_by(F.struct(*frames.columns), F.col(frame)).alias("r")).select("r.*")


def stage_window_averages(timings: DataFrame, stages: tuple[str, ...], ordinal: str = "frame_ordinal", size: int = 100) -> DataFrame:
    """Averages over each full run of ``size`` frames (ordinals from 1)."""
    group = F.floor((F.col(ordinal) - 1) / size).alias("window_no")
    return timings.groupBy(group).agg(F.count("*").alias("frames"), *[F.avg(s).alias(f"avg_{s}") for s in stages]).where(F.col("frames") == size)


def ground_removed(before: Column, after: Column) -> Column:
    return F.sum(F.when(before & ~after, 1).otherwise(0)).cast("long").alias("ground_removed")


def prefix_offsets(counts: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], n: str = "n") -> DataFrame:
    """Exclusive running sums of ``n``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum(n).over(w), F.lit(0)))
