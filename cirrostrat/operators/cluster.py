"""Clustering: voxel components and DBSCAN, per frame, with ids by the smallest member index.

Frames are independent, so by default each frame's components are found by one grouped task: voxel clustering ships
only the voxel table (count and first point index a voxel, aggregated in the JVM), DBSCAN the frame's points.
``neighbor_counts`` and ``dbscan_by_joins`` are for frames too large for one worker: grid equi-joins with the distance
as a residual, counts pre-aggregated (for DBSCAN only around cells of few points), and label propagation over written tables.

Every operator takes columns frame_id, pt_idx, x, y, z and (optionally) valid; invalid points get cluster 0 and are
nobody's neighbour.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrostrat.functions.tables import written
from cirrostrat.operators import groups
from cirrostrat.operators.columns import hidden, shown

PAIRS_AT_ONCE = 4_000_000
#: Cells from the origin up to which points of a cell are known to be neighbours.
FAR = 2.0**30
#: Pairs of points that are looked at for two parts of cells, and how often cells are halved.
FEW, LEVELS = 64, 20


def valid_mask(x: str = "x", y: str = "y", z: str = "z") -> Column:
    """All but exact zeros; NaN counts as valid."""
    return ~((F.col(x) == 0) & (F.col(y) == 0) & (F.col(z) == 0))


def voxel_key(c: str, cell: float, single: bool = False) -> Column:
    """floor(c / cell) as an int, by the reciprocal (in single precision for FLOAT columns); values out of range go to the
    first or last voxel, NaN to voxel 0."""
    scaled = F.col(c) * F.lit(float(np.float32(1) / np.float32(cell))).cast("float") if single else F.col(c) * F.lit(1.0 / cell)
    known = F.when(F.isnan(scaled), 0.0).otherwise(scaled.cast("double"))
    return F.coalesce(F.floor(F.greatest(F.lit(-2147483648.0), F.least(F.lit(2147483647.0), known))), F.lit(0)).cast("int")


def _valid(points: DataFrame) -> DataFrame:
    return points.where("valid") if "valid" in points.columns else points.where(valid_mask())


def with_voxels(points: DataFrame, cell: float) -> DataFrame:
    single = dict(points.dtypes)["x"] == "float"
    return points.withColumns({f"v{c}": voxel_key(c, cell, single) for c in "xyz"})


def voxel_histogram(points: DataFrame, cell: float) -> DataFrame:
    """Valid points and smallest point index of each occupied voxel."""
    return with_voxels(_valid(points), cell).groupBy("frame_id", "vx", "vy", "vz").agg(F.count("*").alias("n"), F.min("pt_idx").alias("first"))


class Forest:
    """Union-find over numpy arrays; a root is the smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.roots()
            ra, rb = root[a], root[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _cells(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct cells, first row, rows) of integer keys sorted lexicographically."""
    change = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
    first = np.flatnonzero(change)
    return keys[first], first, np.diff(np.append(first, len(keys)))


def _lookup(cells: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted cell among the sorted distinct ``cells``, or -1. Axes are taken one after the other, by the
    ranks of the values that occur, so codes stay below the square of the number of cells."""
    have, want = np.zeros(len(cells), dtype=np.int64), np.zeros(len(wanted), dtype=np.int64)
    for k in range(cells.shape[1]):
        values = np.unique(cells[:, k])
        place = np.minimum(np.searchsorted(values, wanted[:, k]), len(values) - 1)
        ok = (want >= 0) & (values[place] == wanted[:, k])
        codes = have * len(values) + np.searchsorted(values, cells[:, k])
        known, have = np.unique(codes, return_inverse=True)
        code = want * len(values) + place
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        want = np.where(ok & (known[at] == code), at, -1)
    return want


def voxel_labels(vox: np.ndarray, n: np.ndarray, first: np.ndarray, min_pts: int, bridge: int, frame: np.ndarray | None = None) -> np.ndarray:
    """Cluster ids of the voxels of a frame, or of several (``frame``: the number of each voxel's). Dense voxels (``max(bridge, min_pts)`` points or more) form components; sparse
    eligible ones take the smallest id next to them; then, in order, the rest adopt from a labelled neighbour."""
    labels = np.zeros(len(vox), dtype=np.int64)
    if not len(vox):
        return labels
    frame = np.zeros(len(vox), dtype=np.int64) if frame is None else frame
    order = np.lexsort((vox[:, 2], vox[:, 1], vox[:, 0], frame))
    cells, rank, frame = np.column_stack([frame[order], vox[order].astype(np.int64)]), first[order], frame[order]
    eligible, dense = n[order] >= min_pts, n[order] >= max(bridge, min_pts)
    offsets = [d for d in itertools.product((-1, 0, 1), repeat=3) if any(d)]
    near = np.stack([_lookup(cells, cells + np.array((0, *d))) for d in offsets], axis=1)  # in scan order
    forest = Forest(len(cells))
    by_rank = np.lexsort((rank, frame))  # so that a root is the voxel with the smallest point index
    place = np.empty(len(cells), dtype=np.int64)
    place[by_rank] = np.arange(len(cells))
    for k in range(13, 26):
        both = (near[:, k] >= 0) & dense & dense[near[:, k]]
        forest.join(place[both], place[near[both, k]])
    root = forest.roots()
    out = np.zeros(len(cells), dtype=np.int64)
    tops, ids = np.unique(root[place[dense]], return_inverse=True)
    of = frame[by_rank[tops]]  # numbers begin anew in each frame
    out[dense] = ids + 1 - np.searchsorted(of, of)[ids]
    top = len(tops) + 1
    sparse = eligible & ~dense
    around = np.where((near >= 0) & dense[near], out[near], top)
    found = around.min(axis=1)
    out[sparse & (found < top)] = found[sparse & (found < top)]
    for i in by_rank[(sparse & (out == 0))[by_rank]].tolist():
        for j in near[i].tolist():
            if j >= 0 and out[j]:
                out[i] = out[j]
                break
    labels[order] = out
    return labels


def labelled_voxels(points: DataFrame, cell: float, min_pts: int = 4, bridge: int = 0) -> DataFrame:
    """frame_id, vx, vy, vz, n (valid points) and label of each occupied voxel; ``bridge`` 0 means min_pts, label 0 no
    cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups.whole(batches, "frame_id"):
            vox = np.stack([t.column(c).to_numpy() for c in ("vx", "vy", "vz")], axis=1)
            frame = np.cumsum(groups.changes([t.column("frame_id").combine_chunks()]))
            labels = voxel_labels(vox, t.column("n").to_numpy(), t.column("first").to_numpy(), min_pts, bridge or min_pts, frame)
            yield from t.select(["frame_id", "vx", "vy", "vz", "n"]).append_column("label", pa.array(labels)).to_batches()

    kind = dict(points.dtypes)["frame_id"]
    return voxel_histogram(points, cell).repartition("frame_id").sortWithinPartitions("frame_id").mapInArrow(run, f"frame_id {kind}, vx int, vy int, vz int, n long, label long")


def voxel_cluster_sizes(points: DataFrame, cell: float, min_pts: int = 4, bridge: int = 0) -> DataFrame:
    """Points of each cluster (frame_id, cluster_id, n_points; 0: noise and invalid points). The voxels' own counts are
    summed, so no point is joined to its label."""
    found = labelled_voxels(points, cell, min_pts, bridge).select("frame_id", F.col("label").alias("cluster_id"), "n")
    valid = F.col("valid") if "valid" in points.columns else valid_mask()
    rest = points.where(~valid).groupBy("frame_id").agg(F.count("*").alias("n")).select("frame_id", F.lit(0).cast("long").alias("cluster_id"), "n")
    return found.unionByName(rest).groupBy("frame_id", "cluster_id").agg(F.sum("n").alias("n_points"))


_OWN = ("frame_id", "pt_idx", "x", "y", "z", "valid")


def voxel_cluster(points: DataFrame, cell: float, min_pts: int = 4, bridge: int = 0) -> DataFrame:
    """``points`` with cluster_id (in place of a column of that name); ``bridge`` 0 means min_pts."""
    points, names = hidden(points, _OWN)
    keyed = with_voxels(points, cell)
    labelled = labelled_voxels(points, cell, min_pts, bridge).where("label > 0").drop("n")
    valid = F.col("valid") if "valid" in points.columns else valid_mask()
    out = keyed.join(labelled, ["frame_id", "vx", "vy", "vz"], "left")
    return shown(out.withColumn("cluster_id", F.when(valid, F.coalesce("label", F.lit(0))).otherwise(0).cast("long")), names, "cluster_id")


def _pairs(xyz: np.ndarray, eps: float):
    """Index pairs (i < j) within eps, chunk by chunk, by a grid of eps cells."""
    cell = np.clip(np.nan_to_num(np.floor(xyz.astype(np.float64) / eps), nan=0.0), -(2.0**62), 2.0**62).astype(np.int64)
    order = np.lexsort((cell[:, 2], cell[:, 1], cell[:, 0]))
    cells, first, size = _cells(cell[order])
    limit = xyz.dtype.type(eps) * xyz.dtype.type(eps)
    halves = [d for d in itertools.product((-1, 0, 1), repeat=3) if d >= (0, 0, 0)]
    for d in halves:
        other = _lookup(cells, cells + np.array(d)) if any(d) else np.arange(len(cells))
        a, b = np.flatnonzero(other >= 0), other[other >= 0]
        work = size[a] * size[b]
        # a chunk of cell pairs holds PAIRS_AT_ONCE point pairs; a larger cell pair is cut by rows of its first cell
        ends = np.cumsum(work)
        start = 0
        while start < len(a):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS_AT_ONCE, side="right")))
            ca, cb = a[start:stop], b[start:stop]
            rows = np.concatenate([np.arange(first[k], first[k] + size[k]) for k in ca])
            mate = np.repeat(cb, size[ca])
            step = max(1, PAIRS_AT_ONCE // max(1, int(size[mate].max())))
            for r in range(0, len(rows), step):
                i, m = rows[r : r + step], mate[r : r + step]
                reps = size[m]
                left = np.repeat(i, reps)
                right = np.repeat(first[m], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                if not any(d):
                    keep = left < right
                    left, right = left[keep], right[keep]
                p, q = order[left], order[right]
                delta = xyz[p] - xyz[q]
                near = delta[:, 0] * delta[:, 0] + delta[:, 1] * delta[:, 1] + delta[:, 2] * delta[:, 2] <= limit
                yield p[near], q[near]
            start = stop


def dbscan_labels(xyz: np.ndarray, eps: float, min_pts: int, bridge: int = 0) -> np.ndarray:
    """Cluster ids of a frame's valid points in index order."""
    from cirrostrat.operators import blocks

    n, bridge = len(xyz), bridge or min_pts
    known = np.isfinite(xyz).all(axis=1)
    if 1 < min_pts <= bridge and (np.abs(xyz[known].astype(np.float64)) < blocks.side(eps) * FAR).all():
        out = np.zeros(n, dtype=np.int64)
        if known.any():  # the others are nobody's neighbours
            out[known] = blocks.frame_labels(xyz[known], eps, min_pts, bridge)
        return out
    counts = np.ones(n, dtype=np.int64)
    for p, q in _pairs(xyz, eps) if n else ():
        counts += np.bincount(p, minlength=n) + np.bincount(q, minlength=n)
    if bridge != min_pts:
        return _sequential(xyz, eps, counts, min_pts, bridge)
    core, forest = counts >= min_pts, Forest(n)
    for p, q in _pairs(xyz, eps) if n else ():
        both = core[p] & core[q]
        forest.join(p[both], q[both])
    out = np.zeros(n, dtype=np.int64)
    tops, ids = np.unique(forest.roots()[core], return_inverse=True)
    out[core] = ids + 1
    edge = np.full(n, len(tops) + 1, dtype=np.int64)
    for p, q in _pairs(xyz, eps) if n else ():
        for a, b in ((p, q), (q, p)):
            border = core[a] & ~core[b]
            np.minimum.at(edge, b[border], out[a[border]])
    found = ~core & (edge <= len(tops))
    out[found] = edge[found]
    return out


def _sequential(xyz: np.ndarray, eps: float, counts: np.ndarray, min_pts: int, bridge: int) -> np.ndarray:
    """Index-ordered growth, for bridge other than min_pts: a seed always spreads, later points only with ``bridge``
    neighbours, and absorbed noise doesn't spread."""
    near = _near_each(xyz, eps)
    labels, now = np.full(len(xyz), -1, dtype=np.int64), 0  # -1: not seen, 0: noise
    for seed in range(len(xyz)):
        if labels[seed] != -1:
            continue
        if counts[seed] < min_pts:
            labels[seed] = 0
            continue
        now += 1
        labels[seed], front = now, [seed]
        while front:
            found = np.concatenate([near(i) for i in front])
            fresh = np.unique(found[labels[found] == -1])
            labels[found[labels[found] == 0]] = now
            labels[fresh] = now
            front = fresh[counts[fresh] >= bridge].tolist()
    return labels


def _near_each(xyz: np.ndarray, eps: float):
    """A function from a point to its neighbours, looked up cell by cell so that a frame's pairs are never held at once."""
    cell = np.clip(np.nan_to_num(np.floor(xyz.astype(np.float64) / eps), nan=0.0), -(2.0**62), 2.0**62).astype(np.int64)
    order = np.lexsort((cell[:, 2], cell[:, 1], cell[:, 0]))
    cells, first, size = _cells(cell[order])
    home = np.empty(len(xyz), dtype=np.int64)
    home[order] = np.repeat(np.arange(len(cells)), size)
    around = np.stack([_lookup(cells, cells + np.array(d)) for d in itertools.product((-1, 0, 1), repeat=3)], axis=1)
    limit = xyz.dtype.type(eps) * xyz.dtype.type(eps)

    def near(i: int) -> np.ndarray:
        members = np.concatenate([order[first[c] : first[c] + size[c]] for c in around[home[i]].tolist() if c >= 0])
        delta = xyz[members] - xyz[i]
        return members[delta[:, 0] * delta[:, 0] + delta[:, 1] * delta[:, 1] + delta[:, 2] * delta[:, 2] <= limit]

    return near


def dbscan(points: DataFrame, eps: float, min_pts: int = 4, bridge: int = 0) -> DataFrame:
    """``points`` with cluster_id (in place of a column of that name), a frame a task; ``bridge`` 0 means min_pts."""
    points, names = hidden(points, _OWN)
    mask = (F.col("valid") if "valid" in points.columns else valid_mask()).alias("__valid")

    def run(t: pa.Table) -> pa.Table:
        ok = t.column("__valid").to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(t.column("pt_idx").to_numpy(), kind="stable")
        order = order[ok[order]]
        labels = np.zeros(len(t), dtype=np.int64)
        labels[order] = dbscan_labels(np.stack([t.column(c).to_numpy()[order] for c in "xyz"], axis=1), eps, min_pts, bridge)
        return t.drop_columns("__valid").append_column("cluster_id", pa.array(labels))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return shown(points.select("*", mask).groupBy("frame_id").applyInArrow(run, f"{kinds}, cluster_id long"), names, "cluster_id")


def half_neighbors(points: DataFrame, eps: float) -> DataFrame:
    """Neighbour pairs (frame_id, a, b), each pair once and each point its own neighbour: one side's cell is spread over
    itself and the 13 cells behind it, so the join is an equi-join on the cell with the distance as a residual."""
    grid = with_voxels(_valid(points), eps).select("frame_id", "pt_idx", "x", "y", "z", *[F.col(f"v{c}").cast("long").alias(f"v{c}") for c in "xyz"])
    halves = [d for d in itertools.product((-1, 0, 1), repeat=3) if d >= (0, 0, 0)]
    off = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("dx", "dy", "dz"), d, strict=True)]) for d in halves])
    a = grid.select("frame_id", F.col("pt_idx").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"], "vx", "vy", "vz", F.inline(off))
    same = ((F.col("dx") == 0) & (F.col("dy") == 0) & (F.col("dz") == 0)).alias("same")
    a = a.select("frame_id", "a", "ax", "ay", "az", same, *[(F.col(f"v{c}") + F.col(f"d{c}")).alias(f"v{c}") for c in "xyz"])
    b = grid.withColumnRenamed("pt_idx", "b")
    d2 = sum(((F.col(f"a{c}") - F.col(c)) * (F.col(f"a{c}") - F.col(c)) for c in "yz"), (F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")))
    once = ~F.col("same") | (F.col("a") <= F.col("b"))
    return a.join(b, ["frame_id", "vx", "vy", "vz"]).where((d2 <= F.lit(eps) * F.lit(eps)) & once).select("frame_id", "a", "b")


def neighbors(points: DataFrame, eps: float) -> DataFrame:
    """Ordered neighbour pairs (frame_id, a, b), each point its own neighbour."""
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half_neighbors(points, eps).select("frame_id", F.inline(both))


def neighbor_counts(points: DataFrame, eps: float) -> DataFrame:
    """Valid points within eps of each valid point, itself included; summed where the pairs are found before they move."""
    pairs = half_neighbors(points, eps)
    ends = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    return pairs.select("frame_id", F.explode(ends).alias("pt_idx")).groupBy("frame_id", "pt_idx").agg(F.count("*").alias("neighbors"))


def _in_cells(points: DataFrame, cell: float, min_pts: int) -> tuple[DataFrame, DataFrame]:
    """(points with their cell, cells), both written. A cell's name is its smallest point; it is dense if it has ``min_pts`` points,
    which are neighbours of each other then. Points that aren't finite are left out; beyond ``FAR`` no cell is dense."""
    scaled = {c: F.greatest(F.lit(-(2.0**48)), F.least(F.lit(2.0**48), F.col(c).cast("double") / cell)) for c in "xyz"}
    known = reduce(lambda p, q: p & q, [F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False)) for c in "xyz"])
    rows = _valid(points).where(known).select("frame_id", "pt_idx", "x", "y", "z", *[F.floor(v).cast("long").alias(f"v{c}") for c, v in scaled.items()])
    key = ["frame_id", "vx", "vy", "vz"]
    dense = (F.col("n") >= min_pts) & (F.greatest(*[F.abs(c) for c in key[1:]]) < FAR)
    cells = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("pt_idx").alias("cell")).withColumn("dense", dense)
    cells = written(cells, "cells")
    return written(rows.join(cells.drop("n"), key), "placed"), cells


def _touching(points: DataFrame, pairs: DataFrame, eps: float, cell: float) -> DataFrame:
    """Of the pairs of dense cells (frame_id, cell, other) those with a pair of points within eps. Cells are halved along each axis,
    level by level: the boxes around two parts, and a point of each, mostly tell; parts that remain open are halved again, and
    those of few points are looked at pair by pair. A pair of cells is settled by the first parts that touch."""
    limit, key = F.lit(eps) * F.lit(eps), ["frame_id", "cell", "other"]
    square = lambda d: d * d
    apart = lambda p, q: square(p("x") - q("x")) + square(p("y") - q("y")) + square(p("z") - q("z"))
    sides = lambda df: (df.select("frame_id", "cell", *[F.col(c).alias(f"a_{c}") for c in df.columns[2:]]), df.select("frame_id", F.col("cell").alias("other"), *[F.col(c).alias(f"b_{c}") for c in df.columns[2:]]))
    open_, links = pairs.select(*key, F.lit(0).cast("long").alias("a_parent"), F.lit(0).cast("long").alias("b_parent")), []
    for level in range(LEVELS):
        last, step = level == LEVELS - 1, 2.0**level
        place = {c: F.greatest(F.lit(0.0), F.least(F.lit(step - 1), F.floor((F.col(c).cast("double") / cell - F.col(f"v{c}")) * step).cast("double"))).cast("long") for c in "xyz"}
        joint = lambda shift: reduce(lambda m, n: F.shiftleft(m, 20) + F.shiftright(n, shift), list(place.values())[1:], F.shiftright(place["x"], shift))  # noqa: E731, B023
        parts = points.select("frame_id", "cell", joint(0).alias("part"), joint(1).alias("parent"), "x", "y", "z")
        ends = [f(F.col(c).cast("double")).alias(f"{n}{c}") for n, f in (("low", F.min), ("high", F.max)) for c in "xyz"]
        boxes = parts.groupBy("frame_id", "cell", "part", "parent").agg(F.count("*").alias("n"), F.min(F.struct("x", "y", "z")).alias("one"), *ends)
        boxes = boxes.join(open_.select("frame_id", "cell").union(open_.select("frame_id", "other")).distinct(), ["frame_id", "cell"], "left_semi") if level else boxes
        first, second = sides(written(boxes, "boxes"))
        both = open_.join(first, ["frame_id", "cell", "a_parent"]).join(second, ["frame_id", "other", "b_parent"])
        least = sum((square(F.greatest(F.lit(0.0), F.col(f"a_low{c}") - F.col(f"b_high{c}"), F.col(f"b_low{c}") - F.col(f"a_high{c}"))) for c in "xyz"), F.lit(0.0))
        most = sum((square(F.greatest(F.col(f"a_high{c}") - F.col(f"b_low{c}"), F.col(f"b_high{c}") - F.col(f"a_low{c}"))) for c in "xyz"), F.lit(0.0))
        # the bounds are rounded, so they tell only what is clear; single places are told by their points
        met = (apart(lambda c: F.col(f"a_one.{c}"), lambda c: F.col(f"b_one.{c}")) <= limit) | (most <= limit * (1 - 1e-6))
        single = reduce(lambda p, q: p & q, [F.col(f"{k}_low{c}") == F.col(f"{k}_high{c}") for k in "ab" for c in "xyz"])
        few = (F.col("a_n") * F.col("b_n") <= FEW) | F.lit(last)
        tested = both.select(*key, "a_part", "b_part", met.alias("met"), few.alias("few"), (single | (least > limit * (1 + 1e-6))).alias("never")).where("met or not never")
        tested = written(tested.drop("never"), "parts")
        hit = tested.where("met").select(*key).distinct()
        rest = tested.where("not met").join(hit, key, "left_anti")
        one, two = sides(parts.drop("parent"))
        close = rest.where("few").join(one, ["frame_id", "cell", "a_part"]).join(two, ["frame_id", "other", "b_part"])
        close = close.where(apart(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")) <= limit).select(*key)
        links.append(written(hit.union(close).distinct(), "links"))
        open_ = rest.where("not few").join(links[-1], key, "left_anti").select(*key, F.col("a_part").alias("a_parent"), F.col("b_part").alias("b_parent"))
        if not open_.limit(1).count():
            break
        open_ = written(open_, "open")
    return reduce(DataFrame.union, links)


def dbscan_by_joins(points: DataFrame, eps: float, min_pts: int = 4, max_rounds: int = 200) -> DataFrame:
    """``points`` with cluster_id for bridge == min_pts, without grouping a frame in one task.

    Cells have a side of eps / sqrt(3), so all points of a cell with ``min_pts`` points are core and one cluster. Pairs of points
    are looked at only for the points of other cells, which are fewer than ``min_pts`` a cell; so their number grows with the
    points, not with the square of their density. Dense cells are linked by ``_touching``."""
    from cirrostrat.operators import blocks

    cell = blocks.side(eps)
    placed, cells = _in_cells(points, cell, min_pts)
    around = cells.select("frame_id", F.col("cell"), "dense", "vx", "vy", "vz")
    for v in ("vx", "vy", "vz"):
        around = around.withColumn(v, F.explode(F.sequence(F.col(v) - blocks.REACH, F.col(v) + blocks.REACH)))
    others = cells.select("frame_id", "vx", "vy", "vz", F.col("cell").alias("other"), F.col("dense").alias("whole"))
    around = around.join(others, ["frame_id", "vx", "vy", "vz"]).where("not dense or whole and cell < other")
    around = written(around.select("frame_id", "cell", "dense", "other", "whole"), "around")

    # a dense cell stands for its points; other points stand for themselves
    loose = placed.where("not dense").select("frame_id", "cell", F.col("pt_idx").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    loose = loose.join(around.where("not dense").drop("dense"), ["frame_id", "cell"]).drop("cell")
    there = placed.select("frame_id", F.col("cell").alias("other"), F.col("pt_idx").alias("b"), "x", "y", "z")
    d2 = sum(((F.col(f"a{c}") - F.col(c)) * (F.col(f"a{c}") - F.col(c)) for c in "yz"), (F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")))
    near = loose.join(there, ["frame_id", "other"]).where(d2 <= F.lit(eps) * F.lit(eps))
    near = near.select("frame_id", "a", F.when(F.col("whole"), F.col("other")).otherwise(F.col("b")).alias("b"), "whole")
    near = written(near.groupBy("frame_id", "a", "b", "whole").agg(F.count("*").alias("n")), "neighbors")
    nodes = near.groupBy("frame_id", "a").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pts).select("frame_id", "a")
    nodes = written(nodes.union(cells.where("dense").select("frame_id", "cell")), "cores")
    pairs = written(near.join(nodes.withColumnRenamed("a", "b"), ["frame_id", "b"], "left_semi").select("frame_id", "a", "b", "whole"), "pairs")
    links = pairs.join(nodes, ["frame_id", "a"], "left_semi").where("a <> b")
    dense = _touching(placed.where("dense"), around.where("dense").select("frame_id", "cell", "other"), eps, cell)
    ways = [links.select("frame_id", "a", "b"), links.where("whole").select("frame_id", "b", "a"), dense.select("frame_id", "cell", "other"), dense.select("frame_id", "other", "cell")]
    edges = written(reduce(DataFrame.union, ways), "core_edges")
    labels = written(nodes.select("frame_id", "a", F.col("a").alias("label")), "labels")
    for _ in range(max_rounds):
        low = edges.join(labels, ["frame_id", "a"]).groupBy("frame_id", "b").agg(F.min("label").alias("low")).withColumnRenamed("b", "a")
        hooked = labels.join(low, ["frame_id", "a"], "left").select("frame_id", "a", "label", F.least("label", F.coalesce("low", "label")).alias("next"))
        jumped = hooked.join(hooked.select("frame_id", F.col("a").alias("next"), F.col("next").alias("far")), ["frame_id", "next"])
        after = written(jumped.select("frame_id", "a", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), "labels")
        labels = after.drop("moved")
        if not after.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError("labels did not settle")
    ids = labels.where("a = label").select("frame_id", "label", F.row_number().over(Window.partitionBy("frame_id").orderBy("label")).cast("long").alias("cluster_id"))
    cored = labels.join(ids, ["frame_id", "label"]).select("frame_id", F.col("a").alias("b"), "cluster_id")
    found = pairs.join(cored, ["frame_id", "b"]).withColumn("own", F.col("a") == F.col("b"))
    best = found.groupBy("frame_id", F.col("a").alias("pt_idx")).agg(F.coalesce(F.min(F.when(F.col("own"), F.col("cluster_id"))), F.min("cluster_id")).alias("cluster_id"))
    held = placed.where("dense").select("frame_id", F.col("cell").alias("b"), "pt_idx").join(cored, ["frame_id", "b"]).select("frame_id", "pt_idx", "cluster_id")
    best = best.union(held)
    points, names = hidden(points, _OWN)
    return shown(points.join(best, ["frame_id", "pt_idx"], "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(0))), names, "cluster_id")


def relabel(cluster_id: Column, ground: Column, ran: Column | bool = True) -> Column:
    """0 noise, 1 ground, 2 and up clusters, where the ground step ran; else the ids as they are."""
    moved = F.when(ground, 1).when(cluster_id > 0, cluster_id + 1).otherwise(0).cast("long")
    return F.when(F.lit(ran) if isinstance(ran, bool) else ran, moved).otherwise(cluster_id)


def cluster(points: DataFrame, algorithm: str = "voxel", eps_mm: int = 200, min_pts: int = 4, bridge: int = 0) -> DataFrame:
    """Dispatch by name: ``voxel``, anything else is DBSCAN."""
    return (voxel_cluster if algorithm == "voxel" else dbscan)(points, eps_mm / 1000, min_pts, bridge)
