"""The counted sensors' frame machine over slices of a sensor's history.

The machine's state matters to a slice only in what it does to the slice's first packet: the packet opens a frame, goes on
with one (that has points already, or none), or shows a boundary and is lost. So each slice is walked once from each of
these four entries, and gives a summary: frames completed, the state it leaves, and what became of the frame that was open
before. A sensor's summaries, a row a slice, are put together in order; then each slice is walked again from the entry that
it has, and its packets get their frames. No task has more than a slice of packets, whatever a sensor's share of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.operators.slices import SLICE, sliced

#: What a slice's first packet does.
OPENS, GOES_ON_EMPTY, GOES_ON, LOST = range(4)
#: What becomes, within a slice, of the frame that was open before it.
OPEN, DONE, CLEARED = range(3)


@dataclass(frozen=True)
class Walk:
    """``owner``: a packet's frame, from 0 for that of the entry, -1 for packets of none; ``frames`` completed (frame
    ``frames`` is open at the end, if any); the state left: ``fresh``, ``last``, ``points``; ``head``: as above."""

    owner: np.ndarray
    frames: int
    fresh: bool
    last: int
    points: bool
    head: int


def walk(counts: list[int], n_points: list[int], entry: int) -> Walk:
    owner, frames, begin, fresh = np.full(len(counts), -1, np.int64), 0, 0, entry == LOST
    last, points, head = counts[0], n_points[0] > 0 or entry == GOES_ON, DONE if entry == LOST else CLEARED if entry == OPENS else OPEN
    if entry == LOST:
        frames, begin, points = 1, 1, False
    for i in range(1, len(counts)):
        count, some = counts[i], n_points[i] > 0
        if fresh:  # opens the frame, whatever its count
            begin, points, fresh = i, some, False
        elif count >= last:
            points |= some
        elif points:  # complete; this packet is lost
            owner[begin:i] = frames
            head = DONE if head == OPEN else head
            frames, begin, points, fresh = frames + 1, i + 1, False, True
        else:  # a boundary without points: the frame begins anew
            head = CLEARED if head == OPEN else head
            begin, points = i, some
        last = count
    if not fresh:
        owner[begin:] = frames
    return Walk(owner, frames, fresh, last, points, head)


def compose(first: list[int], summaries: list[list[tuple]]) -> list[tuple[int, int, bool]]:
    """(entry, number of the frame it has, whether the frame open at the end is completed later) of each slice of a sensor
    in order, from its first count and its (frames, fresh, last, points, head) by entry."""
    entries, numbers, state, number = [], [], None, 0
    for count, by_entry in zip(first, summaries, strict=True):
        fresh, last, points = state or (True, 0, False)
        entry = OPENS if fresh or count < last and not points else LOST if count < last else GOES_ON if points else GOES_ON_EMPTY
        frames, *state, _ = by_entry[entry]
        entries.append(entry)
        numbers.append(number)
        number += frames
    later, out = False, []
    for entry, start, by_entry in zip(reversed(entries), reversed(numbers), reversed(summaries), strict=True):
        out.append((entry, start, later))
        head = by_entry[entry][-1]
        later = head == DONE or head == OPEN and later
    return out[::-1]


def members(counts: list[int], n_points: list[int], entry: int, start: int, later: bool) -> np.ndarray:
    """The frame of each packet of a slice, -1 for those of no emitted one."""
    found = walk(counts, n_points, entry)
    out = np.where(found.owner >= 0, found.owner + start, -1)
    if not later:
        out[found.owner == found.frames] = -1
    return out


def assemble_exact(headers: DataFrame, sensor: str = "sensor_id", count: str = "pkt_cnt", order: str = "capture_seq", points: str = "n_points", size: int = SLICE) -> DataFrame:
    """(sensor, order, frame_id) of every packet that is part of an emitted frame, as the machine tells them. Rows without
    sensor, order or count are dropped."""
    kind = dict(headers.dtypes)[sensor]
    rows = headers.select(F.col(sensor).alias("s"), F.col(order).cast("long").alias("o"), F.col(count).cast("long").alias("c"), F.coalesce(F.col(points).cast("long"), F.lit(0)).alias("n"))
    rows = sliced(rows.where("s is not null and o is not null and c is not null"), "o", size)

    def lists(pdf: pd.DataFrame) -> tuple[list[int], list[int]]:
        return pdf["c"].tolist(), pdf["n"].tolist()

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        counts, n = lists(pdf.sort_values("o", kind="stable"))
        walks = [walk(counts, n, e) for e in range(4)]
        return pd.DataFrame([(pdf["s"].iloc[0], pdf["__slice"].iloc[0], counts[0], [[w.frames, int(w.fresh), w.last, int(w.points), w.head] for w in walks])], columns=["s", "__slice", "first", "by"])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__slice")
        found = compose(pdf["first"].tolist(), [[(int(f), bool(fresh), int(last), bool(p), int(h)) for f, fresh, last, p, h in by] for by in pdf["by"]])
        entry, start, later = zip(*found, strict=True)
        return pd.DataFrame({"s": pdf["s"], "__slice": pdf["__slice"], "entry": entry, "start": start, "later": later})

    def placed(pdf: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o", kind="stable")
        at = plan.iloc[0]
        frame = members(*lists(pdf), int(at["entry"]), int(at["start"]), bool(at["later"]))
        return pd.DataFrame({"s": pdf["s"], "o": pdf["o"], "frame_id": frame})[frame >= 0]

    slices = rows.groupBy("s", "__slice").applyInPandas(summary, f"s {kind}, __slice long, first long, by array<array<long>>")
    plan = slices.groupBy("s").applyInPandas(joined, f"s {kind}, __slice long, entry int, start long, later boolean")
    out = rows.groupBy("s", "__slice").cogroup(plan.groupBy("s", "__slice")).applyInPandas(placed, f"s {kind}, o long, frame_id long")
    return out.toDF(sensor, order, "frame_id")
