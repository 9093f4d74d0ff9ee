"""Stages of a live stream, timed, and shedding of frames that a slow sink can't keep up with.

``run_stages`` takes each micro-batch through named stages. A stage's result is a table in the shared folder, so its time is
its own and a lost executor costs no stage before it. ``Averages`` gives a report for every ``size`` frames; ``Progress`` does
the same for the phases that Spark itself times (planning, log, batch), with the frames that an observation counts.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from cirrostrat.functions.tables import written
from cirrostrat.operators import tracks
from cirrostrat.streaming.frames import available

Stage = tuple[str, Callable[[DataFrame], DataFrame]]
OBSERVED = "frames"


class Averages:
    """Mean seconds a frame of each stage, reported once ``size`` frames are together: frames, points, and seconds by stage
    with their ``total``. Sums of one report are kept, nothing else; a restart begins anew."""

    def __init__(self, report: Callable[[dict], None], size: int = 100):
        self.report, self.size = report, size
        self._clear()

    def _clear(self) -> None:
        self.frames, self.points, self.sums = 0, 0, {}

    def add(self, frames: int, seconds: dict[str, float], points: int = 0) -> None:
        """A micro-batch: its frames, and what its stages took for all of them. One without frames still costs time."""
        self.frames, self.points = self.frames + frames, self.points + points
        for stage, s in seconds.items():
            self.sums[stage] = self.sums.get(stage, 0.0) + s
        if self.frames >= self.size:
            means = {stage: s / self.frames for stage, s in self.sums.items()}
            self.report({"frames": self.frames, "points": self.points, "seconds": means | {"total": sum(means.values())}})
            self._clear()


class Progress(StreamingQueryListener):
    """Adds the phases of a query's micro-batches to ``averages``; frames are those that ``observed`` counts. ``addBatch`` is
    the batch itself; ``triggerExecution`` contains the other phases and isn't added."""

    def __init__(self, averages: Averages, name: str):
        self.averages, self.name = averages, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.name:
            row = (p.observedMetrics or {}).get(OBSERVED)
            phases = {k: ms / 1000 for k, ms in p.durationMs.items() if k != "triggerExecution"}
            self.averages.add(int(row["frames"] or 0) if row else 0, phases, int(row["points"] or 0) if row else 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def observed(points: DataFrame, first: Column | None = None) -> DataFrame:
    """``points`` with an observation of frames (rows for which ``first`` holds, by default those with pt_idx 0) and points."""
    mark = F.col("pt_idx") == 0 if first is None else first
    return points.observe(OBSERVED, F.count_if(mark).alias("frames"), F.count(F.lit(1)).alias("points"))


def newest(points: DataFrame) -> DataFrame:
    """Points of each sensor's newest frame; points without sensor or frame are in none."""
    return points.join(tracks.latest_frame(points.where("frame_id is not null").select("sensor_id", "frame_id")), ["sensor_id", "frame_id"], "left_semi")


def run_stages(points: DataFrame, stages: list[Stage], sink: Callable[[DataFrame, int], None], checkpoint: str, report: Callable[[dict], None], keep_latest: bool = False, size: int = 100, name: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Start a stream of whole frames' points (sensor_id, frame_id, pt_idx, ...) through ``stages`` into ``sink(rows, epoch)``,
    which is timed as ``publish``. ``keep_latest`` sheds: of what has come in while the sink was busy only the newest frame of
    each sensor goes on. ``report`` gets the averages over the frames that went on (with ``shed``, those that didn't, since
    the report before). A frame must not be cut by a micro-batch (``live.whole_frames``); a micro-batch that is tried again
    reaches ``sink`` under the same epoch."""
    shed = 0

    def told(averages: dict) -> None:
        nonlocal shed
        report(averages | {"shed": shed})
        shed = 0

    averages = Averages(told, size)

    def each(batch: DataFrame, epoch: int) -> None:
        nonlocal shed
        seconds, rows = {}, batch
        came = written(rows, "came") if keep_latest else rows
        rows = newest(came) if keep_latest else rows
        for stage, step in stages:
            start = time.perf_counter()
            rows = written(step(rows), "stage")
            seconds[stage] = time.perf_counter() - start
        start = time.perf_counter()
        sink(rows, epoch)
        seconds["publish"] = time.perf_counter() - start
        counted = lambda df: df.agg(F.count_distinct(F.struct("sensor_id", "frame_id")).alias("n"), F.count(F.lit(1)).alias("points")).first()
        own = counted(rows)
        shed += counted(came)["n"] - own["n"] if keep_latest else 0
        averages.add(own["n"], seconds, own["points"])

    writer = observed(points).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return available(writer, points.sparkSession) if available_now else writer.start()
