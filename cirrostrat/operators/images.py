"""Range images as arrays: a frame's pixels scattered and projected at once, without a row for each missing pixel.

A frame's distinct pixels are at most its image (131,072 for the largest sensor), so a task's group is bounded whatever a
sensor repeats: ``frames.scatter`` has combined repeated writes before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cirrostrat.operators.geometry import MM

#: Rows of a beam table that are sent to the tasks: eight times the largest sensor's image.
MOST_BEAMS = 1 << 20


def _kinds(df: DataFrame, keys: tuple[str, ...]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def _scattered(t: pa.Table, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    """Depth and reflect images, flat; pixels outside them, or without a depth or a place, are left out."""
    t = t.filter(pc.and_(pc.and_(t.column("row").is_valid(), t.column("col").is_valid()), t.column("depth").is_valid()))
    row, col = t.column("row").to_numpy(), t.column("col").to_numpy()
    inside = (row >= 0) & (row < rows) & (col >= 0) & (col < cols)
    at = row[inside].astype(np.int64) * cols + col[inside]
    depth, reflect = np.zeros(rows * cols, dtype=np.int32), np.zeros(rows * cols, dtype=np.int16)
    depth[at] = t.column("depth").to_numpy()[inside]
    reflect[at] = t.column("reflect").fill_null(0).to_numpy()[inside]
    return depth, reflect


def range_images(pixels: DataFrame, rows: int, cols: int, keys: tuple[str, ...] = ("sensor_id", "ordinal")) -> DataFrame:
    """One row a frame: ``keys``, depth array<int> and reflect array<smallint> of rows * cols values, row by row; missing
    pixels are 0. ``pixels`` are distinct (``frames.scatter``). Null keys are a frame; an empty table gives no rows."""

    def run(t: pa.Table) -> pa.Table:
        depth, reflect = _scattered(t, rows, cols)
        own = {k: t.column(k).slice(0, 1).combine_chunks() for k in keys}
        return pa.table(own | {"depth": pa.array([depth], pa.list_(pa.int32())), "reflect": pa.array([reflect], pa.list_(pa.int16()))})

    own = pixels.select(*keys, "row", "col", "depth", "reflect")
    return own.groupBy(*keys).applyInArrow(run, f"{_kinds(own, keys)}, depth array<int>, reflect array<smallint>")


def beams(lut: DataFrame) -> dict[str, np.ndarray]:
    """A beam table's columns, sorted by row and column; a table of more than MOST_BEAMS rows is an error."""
    table = lut.limit(MOST_BEAMS + 1).toArrow()
    if table.num_rows > MOST_BEAMS:
        raise ValueError(f"a beam table of more than {MOST_BEAMS} rows")
    table = table.sort_by([("row", "ascending"), ("col", "ascending")])
    return {c: table.column(c).to_numpy() for c in ("row", "col", "src_col", "xc", "yc", "zc", "xo", "yo", "range_delta", "beam_z")}


def project(pixels: DataFrame, lut: DataFrame, keys: tuple[str, ...] = ("sensor_id", "ordinal"), only_returns: bool = False) -> DataFrame:
    """``geometry.project_xyz`` by one array kernel a frame: the same points, in the same arithmetic of single floats.
    ``pixels`` are distinct (``frames.scatter``); a null depth counts as missing."""
    shared = pixels.sparkSession.sparkContext.broadcast(beams(lut))

    def run(t: pa.Table) -> pa.Table:
        b = shared.value
        if not len(b["row"]):
            return pa.table({k: t.column(k).slice(0, 0) for k in keys} | {c: pa.array([], kind) for c, kind in _OUT})
        rows, cols = int(b["row"].max()) + 1, int(b["src_col"].max()) + 1
        depth, reflect = (image[b["row"].astype(np.int64) * cols + b["src_col"]] for image in _scattered(t, rows, cols))
        r = np.where(depth == 0, np.float32(0), (depth * np.int32(8)).astype(np.float32) - b["range_delta"])
        axis = lambda c, o: (r * b[c] + b[o]) * np.float32(MM)
        found = {"row": b["row"], "col": b["col"], "x": axis("xc", "xo"), "y": axis("yc", "yo"), "z": axis("zc", "beam_z"), "range": r * np.float32(MM), "intensity": reflect}
        keep = np.flatnonzero(depth > 0) if only_returns else np.arange(len(depth))
        first = pa.array(np.zeros(len(keep), dtype=np.int64))
        return pa.table({k: t.column(k).combine_chunks().take(first) for k in keys} | {c: pa.array(found[c][keep], kind) for c, kind in _OUT})

    own = pixels.select(*keys, "row", "col", "depth", "reflect")
    out = "row int, col int, x float, y float, z float, range float, intensity smallint"
    return own.groupBy(*keys).applyInArrow(run, f"{_kinds(own, keys)}, {out}")


_OUT = (("row", pa.int32()), ("col", pa.int32()), ("x", pa.float32()), ("y", pa.float32()), ("z", pa.float32()), ("range", pa.float32()), ("intensity", pa.int16()))
