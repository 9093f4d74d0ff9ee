"""Frame assembly: packets of a sensor to frames.

``assemble_counted`` is for sensors that count packets: a frame ends where the count falls. The packet that shows the
boundary isn't part of any frame, and the frame open at the end isn't emitted; ``keep_boundary`` keeps both. On
well-formed captures this is a window over slices of ``size`` packets (``slices``); ``exact=True`` runs the state machine
over such slices of header rows (``machine``; never points), which also holds for adjacent boundaries and packets without
points.

``assemble_numbered`` is for sensors that number frames: a frame is a run of equal ids; ``emitted_frame_id`` is the id
of the packet that ended it, as the reference emits it, and ``frame_id`` its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cirrostrat.operators.machine import assemble_exact
from cirrostrat.operators.slices import SLICE, runs


def boundaries(headers: DataFrame, sensor: str = "sensor_id", count: str = "pkt_cnt", order: str = "capture_seq", size: int = SLICE) -> DataFrame:
    """``headers`` with boundary (first packet or falling count) and ordinal (boundaries so far)."""
    out = _counted(headers, sensor, count, order, size)
    return out.select(*headers.columns, F.col("__boundary").alias("boundary"), F.col("__ordinal").alias("ordinal"))


def _counted(headers: DataFrame, sensor: str, count: str, order: str, size: int) -> DataFrame:
    found = runs(headers, sensor, order, count, lambda now, before: now < before, size=size)
    return found.withColumn("__boundary", F.col("__start") | F.col("__before.v").isNull())


def assemble_counted(headers: DataFrame, exact: bool = False, keep_boundary: bool = False, sensor: str = "sensor_id", count: str = "pkt_cnt", order: str = "capture_seq", size: int = SLICE) -> DataFrame:
    """(sensor, order, frame_id) of every packet that is part of an emitted frame. ``exact`` needs a column n_points."""
    if exact:
        return assemble_exact(headers, sensor, count, order, size=size)
    marked = _counted(headers.select(sensor, order, count), sensor, count, order, size)
    if not keep_boundary:  # the frame open at the end is the one that no boundary follows
        marked = marked.where((F.col("__ordinal") < F.col("__total")) & ~(F.col("__boundary") & (F.col("__ordinal") > 0)))
    return marked.select(sensor, order, F.col("__ordinal").alias("frame_id"))


class FrameMachine:
    """The state of a counted sensor: feed (order, count, number of points) in order; a finished frame comes back as
    (frame id, orders of its packets)."""

    def __init__(self, frame_id: int = 0, last: int = 65535, first: bool = True, fresh: bool = False, parts: list | None = None, points: int = 0):
        self.frame_id, self.last, self.first, self.fresh, self.parts, self.points = frame_id, last, first, fresh, parts or [], points

    def feed(self, order: int, count: int, n_points: int) -> tuple[int, list[int]] | None:
        if self.fresh:  # the packet after a boundary opens the frame, whatever its count
            self.parts, self.points, self.fresh = [], 0, False
        elif self.first or count < self.last:
            if not self.first and self.points:
                done = self.frame_id, self.parts
                self.frame_id, self.last, self.fresh = self.frame_id + 1, count, True
                return done
            self.parts, self.points = [], 0
        self.first, self.last = False, count
        self.parts.append(order)
        self.points += n_points
        return None


def assemble_numbered(headers: DataFrame, sensor: str = "sensor_id", number: str = "header_frame_id", order: str = "capture_seq", initial: int = 0, size: int = SLICE) -> DataFrame:
    """(sensor, order, ordinal, frame_id, emitted_frame_id, complete) of every packet; the run open at the end isn't
    complete. A capture that doesn't start with ``initial`` has a first frame without pixels (``ordinal`` starts at 1)."""
    found = runs(headers.select(sensor, order, number), sensor, order, number, lambda now, before: now != before, F.lit(initial).cast(headers.schema[number].dataType), size)
    emitted = F.col("__next.v")
    return found.select(sensor, order, F.col("__ordinal").alias("ordinal"), F.col(number).alias("frame_id"), emitted.alias("emitted_frame_id"), emitted.isNotNull().alias("complete"))


def scatter(pixels: DataFrame, keys: tuple[str, ...] = ("sensor_id", "ordinal")) -> DataFrame:
    """One row per pixel of a frame; of repeated writes the last one (by capture order, then place in the packet)."""
    last = F.max_by(F.struct("depth", "reflect"), F.struct("capture_seq", "col_in_packet"))
    return pixels.groupBy(*keys, "row", "col").agg(last.alias("p")).select(*keys, "row", "col", "p.depth", "p.reflect")


def with_point_index(points: DataFrame, order: tuple[str, ...] = ("capture_seq", "block"), keys: tuple[str, ...] = ("sensor_id", "frame_id"), capacity: int | None = None) -> DataFrame:
    """``points`` numbered from 0 within their frame; points beyond the frame's capacity are dropped."""
    out = points.withColumn("pt_idx", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return out.where(F.col("pt_idx") < capacity) if capacity is not None else out


def frame_summary(points: DataFrame, keys: tuple[str, ...] = ("sensor_id", "frame_id")) -> DataFrame:
    """Points of each frame and the running total of its sensor."""
    counts = points.groupBy(*keys).agg(F.count("*").alias("n_points"))
    return counts.withColumn("total_points", F.sum("n_points").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]))) if len(keys) > 1 else counts
