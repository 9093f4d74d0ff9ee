"""DBSCAN and neighbour counts by blocks of cells, so that a frame of any size is spread over tasks.

A cell's side is eps / sqrt(3), so all points of a cell are neighbours: a cell with ``min_pts`` points is core throughout
without a count, and a cell's core points are one cluster without a pair. A block is ``SIDE`` cells along each axis; its task
has the block's points and a margin of the cells around, two deep for what neighbours its points have (eps is less than two
cells), two more for whether those are core themselves. Cells are linked by the first close pair that is found, and only
where they aren't linked yet.

What leaves a block is narrow: each point with the local cluster it belongs to or may join, and the links of local clusters
to cells of other blocks. One task a frame joins these (never points or pairs) and numbers the clusters; points get their
number by a join. So no pairs are written, and no task holds a frame unless one block does.

Points that aren't finite, or lie beyond 2**50 cells, are nobody's neighbours.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrostrat.functions.tables import written
from cirrostrat.operators.cluster import Forest, _cells, _lookup, _pairs, _valid
from cirrostrat.operators.columns import hidden, shown

SIDE, REACH = 64, 2
#: Pairs of points that are tested at once, and of a pair of cells in the first step.
AT_ONCE, FEW = 1_000_000, 1_024
_FAR = 2.0**50
#: Cells that may hold a neighbour, nearest first.
_AROUND = sorted((d for d in itertools.product(range(-REACH, REACH + 1), repeat=3) if any(d)), key=lambda d: (sum(max(abs(v) - 1, 0) ** 2 for v in d), sum(map(abs, d)), d))


def side(eps: float) -> float:
    """The side of a cell: a little less than eps / sqrt(3), for rounding."""
    return eps / math.sqrt(3) * (1 - 1e-5)


def cells_of(xyz: np.ndarray, cell: float) -> np.ndarray:
    return np.floor(xyz.astype(np.float64) / cell).astype(np.int64)


def _expanded(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (pair of runs, place in the first, place in the second) of runs that begin at a and b."""
    work = na * nb
    which = np.repeat(np.arange(len(a)), work)
    k = np.arange(len(which)) - np.repeat(np.cumsum(work) - work, work)
    return which, a[which] + k // nb[which], b[which] + k % nb[which]


def _near_cells(cells: np.ndarray) -> list[np.ndarray]:
    """For each place in ``_AROUND`` the index of every cell's neighbour there, or -1; cells are sorted and distinct."""
    place, extent = np.empty_like(cells), 1
    for k in range(3):  # wider gaps than the reach are as good as the reach
        values, at = np.unique(cells[:, k], return_inverse=True)
        steps = np.concatenate([[0], np.cumsum(np.minimum(np.diff(values), REACH + 1))]) + REACH
        place[:, k] = steps[at]
        extent *= int(steps[-1]) + 1 + REACH
    if extent >= 1 << 62:
        return [_lookup(cells, cells + np.array(d)) for d in _AROUND]
    wide = place.max(axis=0) + 1 + REACH
    code = (place[:, 0] * wide[1] + place[:, 1]) * wide[2] + place[:, 2]
    out = []
    for d in _AROUND:
        want = code + (d[0] * int(wide[1]) + d[1]) * int(wide[2]) + d[2]
        at = np.minimum(np.searchsorted(code, want), len(code) - 1)
        out.append(np.where(code[at] == want, at, -1))
    return out


class Cells:
    """Points sorted by cell, with the cells that may hold a neighbour; ``depth`` of a cell is 0 where its points count."""

    def __init__(self, xyz: np.ndarray, index: np.ndarray, eps: float):
        cell = cells_of(xyz, side(eps))
        self.order = np.lexsort((index, cell[:, 2], cell[:, 1], cell[:, 0]))
        self.xyz, self.index = xyz[self.order], index[self.order]
        self.cells, self.first, self.size = _cells(cell[self.order])
        self.home = np.repeat(np.arange(len(self.cells)), self.size)
        self.limit = xyz.dtype.type(eps) * xyz.dtype.type(eps)
        self.around, self.depth = self._around(), np.zeros(len(self.cells), np.int64)

    def _around(self) -> list[np.ndarray]:
        return _near_cells(self.cells)

    def _close(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        d = self.xyz[p] - self.xyz[q]
        return d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] <= self.limit

    def _pieces(self, points: np.ndarray, cell: np.ndarray):
        """(points, first points of their cells, sizes) with ``AT_ONCE`` pairs at most; a larger cell in parts."""
        start = 0
        while start < len(points):
            ends = np.cumsum(self.size[cell[start:]])
            stop = start + max(1, int(np.searchsorted(ends, AT_ONCE, side="right")))
            p, c = points[start:stop], cell[start:stop]
            if stop - start == 1 and self.size[c[0]] > AT_ONCE:
                for at in range(0, int(self.size[c[0]]), AT_ONCE):
                    yield p, self.first[c] + at, np.array([min(AT_ONCE, int(self.size[c[0]]) - at)])
            else:
                yield p, self.first[c], self.size[c]
            start = stop

    def counts(self, most: int) -> np.ndarray:
        """Neighbours of each point (itself included), exact below ``most``, as far as the margin lets them be known."""
        found = np.repeat(self.size, self.size)
        for other in self.around:
            open_ = np.flatnonzero((found < most) & (other[self.home] >= 0) & (self.depth[self.home] <= REACH))
            for p, first, size in self._pieces(open_, other[self.home[open_]]):
                if found[p[0]] >= most:  # a large cell's later part
                    continue
                which, i, j = _expanded(p, np.ones(len(p), np.int64), first, size)
                np.add.at(found, p, np.bincount(which[self._close(i, j)], minlength=len(p)))
        return found

    def near(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a point of ``points`` and a neighbour; for points whose neighbours are few."""
        which, i, j = _expanded(points, np.ones(len(points), np.int64), self.first[self.home[points]], self.size[self.home[points]])
        found = [(i[i != j], j[i != j])]
        for other in self.around:
            open_ = points[other[self.home[points]] >= 0]
            for p, first, size in self._pieces(open_, other[self.home[open_]]):
                _, i, j = _expanded(p, np.ones(len(p), np.int64), first, size)
                met = self._close(i, j)
                found.append((i[met], j[met]))
        return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])

    def by_core(self, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sort a cell's core points first, by index: (core, core points of each cell, the first one's index or -1)."""
        by = np.lexsort((self.index, ~core, self.home))
        self.xyz, self.index, self.order, core = self.xyz[by], self.index[by], self.order[by], core[by]
        held = np.bincount(self.home, weights=core, minlength=len(self.cells)).astype(np.int64)
        return core, held, np.where(held > 0, self.index[self.first], -1)

    def _touch(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Whether runs of points that begin at a and b have a close pair: small ones at once, large ones strip by strip
        up to the first that is found."""
        out, work = np.zeros(len(a), bool), na * nb
        small = np.flatnonzero(work <= FEW)
        for start in range(0, len(small), AT_ONCE // FEW):
            s = small[start : start + AT_ONCE // FEW]
            which, i, j = _expanded(a[s], na[s], b[s], nb[s])
            out[s] = np.bincount(which[self._close(i, j)], minlength=len(s)) > 0
        for k in np.flatnonzero(work > FEW).tolist():
            step = max(1, FEW // int(min(nb[k], FEW)))
            for i, j in itertools.product(range(0, int(na[k]), step), range(0, int(nb[k]), FEW)):
                p, q = a[k] + np.arange(i, min(i + step, na[k])), b[k] + np.arange(j, min(j + FEW, nb[k]))
                if self._close(np.repeat(p, len(q)), np.tile(q, len(p))).any():
                    out[k] = True
                    break
        return out


class Block(Cells):
    """Points of a block and its margin; ``depth`` is a cell's distance from the block (0: its own)."""

    def __init__(self, xyz: np.ndarray, index: np.ndarray, eps: float, low: np.ndarray, count: int = SIDE):
        self.low, self.count = low, count
        super().__init__(xyz, index, eps)
        high = low + count - 1
        self.depth = np.maximum(np.maximum(low - self.cells, self.cells - high), 0).max(axis=1)
        self.edge = np.minimum(self.cells - low, high - self.cells).min(axis=1)  # cells of its own that lie within the reach of another block

    def _around(self) -> list[np.ndarray]:
        # cells by their place in the block's own grid, with room for the reach beyond the margin
        wide = self.count + 6 * REACH
        place = self.cells - self.low + 3 * REACH
        code = (place[:, 0] * wide + place[:, 1]) * wide + place[:, 2]
        grid = np.full(wide**3, -1, np.int64)
        grid[code] = np.arange(len(code))
        return [grid[code + (d[0] * wide + d[1]) * wide + d[2]] for d in _AROUND]

    def cores(self, min_pts: int) -> np.ndarray:
        """Which points have ``min_pts`` neighbours (themselves included), as far as the margin lets it be known."""
        return self.counts(min_pts) >= min_pts

    def local(self, min_pts: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(node of each point or -1, nodes that a point near core cells may join, links between nodes). A node is the
        index of the first core point of a local cluster, or of a cell of another block."""
        core, held, name = self.by_core(self.cores(min_pts))
        own, forest, far = self.depth == 0, Forest(len(self.cells)), []
        rank = np.argsort(np.where(own & (held > 0), name, np.iinfo(np.int64).max), kind="stable")  # a root is the smallest
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        for d, other in zip(_AROUND, self.around, strict=True):
            a = np.flatnonzero(own & (held > 0) & (other >= 0))
            b = other[a]
            a, b = a[(held[b] > 0) & (d > (0, 0, 0))], b[(held[b] > 0) & (d > (0, 0, 0))]
            inside = own[b]
            roots = forest.roots()
            apart = ~inside | (roots[place[a]] != roots[place[b]])
            a, b, inside = a[apart], b[apart], inside[apart]
            met = self._touch(self.first[a], held[a], self.first[b], held[b])
            forest.join(place[a[met & inside]], place[b[met & inside]])
            far.append(np.stack([a[met & ~inside], b[met & ~inside]], axis=1))
        root = name[rank[forest.roots()[place]]]
        node_of = np.where(own, root, name)  # as other blocks know it
        far = np.concatenate(far) if far else np.empty((0, 2), np.int64)
        links = np.stack([root[far[:, 0]], name[far[:, 1]]], axis=1)
        rim = own & (held > 0) & (self.edge < REACH)
        links = np.unique(np.concatenate([links, np.stack([root[rim], name[rim]], axis=1)]), axis=0)
        mine = own[self.home]
        node = np.where(mine & core, root[self.home], -1)
        border = np.flatnonzero(mine & ~core)
        near: list[set] = [set() for _ in range(len(border))]
        same = held[self.home[border]] > 0
        for k in np.flatnonzero(same).tolist():
            near[k].add(int(node_of[self.home[border[k]]]))
        for other in self.around:
            cell = other[self.home[border]]
            k = np.flatnonzero((cell >= 0) & (held[cell] > 0))
            c = cell[k]
            met = self._touch(border[k], np.ones(len(k), np.int64), self.first[c], held[c])
            for i, v in zip(k[met].tolist(), node_of[c[met]].tolist(), strict=True):
                near[i].add(int(v))
        options: list = [None] * len(self.index)
        for i, found in zip(border.tolist(), near, strict=True):
            if found:
                options[i] = sorted(found)
        return node, options, links


def frame_labels(xyz: np.ndarray, eps: float, min_pts: int, bridge: int) -> np.ndarray:
    """Cluster ids of a frame's points in index order, for ``bridge`` >= ``min_pts``, without its neighbour pairs.

    Points with ``bridge`` neighbours are strong: they spread, so a component of them is always in one cluster, and it is found
    cell by cell. The others have fewer than ``bridge`` neighbours each, so their lists are short. What depends on the order
    is then decided over components and seeds that don't spread (min_pts neighbours or more): each takes what it reaches
    and nobody has taken."""
    c = Cells(xyz, np.arange(len(xyz)), eps)
    counts = c.counts(bridge)
    place = np.empty(len(xyz), np.int64)
    place[c.order] = counts
    strong, held, name = c.by_core(counts >= bridge)
    counts = place[c.order]
    rank = np.argsort(np.where(held > 0, name, np.iinfo(np.int64).max), kind="stable")  # a root is the smallest
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    forest = Forest(len(rank))
    for d, other in zip(_AROUND, c.around, strict=True):
        if d < (0, 0, 0):
            continue
        a = np.flatnonzero((held > 0) & (other >= 0))
        a = a[held[other[a]] > 0]
        roots = forest.roots()
        a = a[roots[place[a]] != roots[place[other[a]]]]
        met = a[c._touch(c.first[a], held[a], c.first[other[a]], held[other[a]])]
        forest.join(place[met], place[other[met]])
    # components by their first point; the part of each cell, and of each strong point
    tops, part = np.unique(forest.roots()[place][held > 0], return_inverse=True)
    of_cell = np.full(len(held), -1, np.int64)
    of_cell[held > 0] = part
    of = np.where(strong, of_cell[c.home], -1)
    p, q = c.near(np.flatnonzero(~strong))
    out = np.zeros(len(xyz), np.int64)
    weak = np.flatnonzero(~strong & (counts >= min_pts))
    if not len(weak):
        out[strong] = of[strong] + 1
        edge = np.full(len(xyz), len(tops), np.int64)
        np.minimum.at(edge, p[strong[q]], of[q[strong[q]]])
        out[edge < len(tops)] = edge[edge < len(tops)] + 1
    else:
        out, taken = _in_order(c, name[rank[tops]], of, weak, p, q)
        out[strong] = taken[of[strong]]
    labels = np.empty(len(xyz), np.int64)
    labels[c.order] = out
    return labels


def _in_order(c: Cells, firsts: np.ndarray, of: np.ndarray, weak: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels of points that aren't strong, labels of components): seeds one by one, by index. ``of``: the component of
    strong points, else -1; (p, q): each other point and its neighbours."""
    out, taken, now = np.zeros(len(of), np.int64), np.zeros(len(firsts), np.int64), 0
    by = np.argsort(of[q], kind="stable")  # a component's points around it
    rim, begin = p[by], np.searchsorted(of[q][by], np.arange(len(firsts) + 1))
    mine = np.argsort(p, kind="stable")
    q, start, stop = q[mine], np.searchsorted(p[mine], weak), np.searchsorted(p[mine], weak, side="right")
    seeds = np.concatenate([firsts, c.index[weak]])

    def take(k: int) -> None:
        taken[k] = now
        around = rim[begin[k] : begin[k + 1]]
        out[around[out[around] == 0]] = now

    for s in np.argsort(seeds, kind="stable").tolist():
        if s < len(firsts):
            if not taken[s]:
                now += 1
                take(s)
        elif not out[weak[s - len(firsts)]]:
            now += 1
            s -= len(firsts)
            out[weak[s]] = now
            for v in q[start[s] : stop[s]].tolist():
                if of[v] < 0:
                    out[v] = out[v] or now
                elif not taken[of[v]]:
                    take(of[v])
    return out, taken


def numbered(roots: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, cluster numbers from 1 by the smallest node) of a frame."""
    nodes, flat = np.unique(np.concatenate([roots, links.ravel()]), return_inverse=True)
    forest = Forest(len(nodes))
    pairs = flat[len(roots) :].reshape(-1, 2)
    forest.join(pairs[:, 0], pairs[:, 1])
    return nodes, np.unique(forest.roots(), return_inverse=True)[1] + 1


def in_blocks(points: DataFrame, cell: float, count: int, margin: int) -> DataFrame:
    """Each point once for every block that needs it: __bx, __by, __bz and __own (whether it lies in the block)."""
    out = points
    for a in "xyz":
        c = F.floor(F.col(a).cast("double") / cell)
        low, high = (F.floor((c + v) / count).cast("long") for v in (-margin, margin))
        out = out.withColumn(f"__h{a}", F.floor(c / count).cast("long")).withColumn(f"__b{a}", F.explode(F.sequence(low, high)))
    own = (F.col("__hx") == F.col("__bx")) & (F.col("__hy") == F.col("__by")) & (F.col("__hz") == F.col("__bz"))
    return out.withColumn("__own", own).drop("__hx", "__hy", "__hz")


def _within(cell: float) -> Column:
    """Whether a point's cells can be told."""
    ok = F.lit(True)
    for a in "xyz":
        ok = ok & F.coalesce(~F.isnan(F.col(a)) & (F.abs(F.col(a).cast("double") / cell) < _FAR), F.lit(False))
    return ok


def _lines(xyz: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points on lines along ``axis``: (order, first of each distinct point, first distinct point of each line, line of each
    distinct point)."""
    a, b = (k for k in range(3) if k != axis)
    order = np.lexsort((xyz[:, axis], xyz[:, b], xyz[:, a]))
    p = xyz[order]
    moved = np.concatenate([[True], (p[1:, (a, b)] != p[:-1, (a, b)]).any(axis=1)])
    fresh = np.flatnonzero(moved | np.concatenate([[True], p[1:, axis] != p[:-1, axis]]))
    line = np.cumsum(moved[fresh]) - 1
    return order, fresh, np.searchsorted(line, np.arange(line[-1] + 2)), line


def line_counts(xyz: np.ndarray, eps: float) -> np.ndarray | None:
    """Neighbours of each point, itself included, where points lie on few lines along an axis (coordinates with steps, repeated
    points): on a line a point's neighbours are a range, found by search. None where pairs are no more work."""
    axis = int(np.argmax([len(np.unique(xyz[:, k])) for k in range(3)]))
    order, fresh, begin, line = _lines(xyz, axis)
    if 4 * (len(begin) - 1) > len(xyz):
        return None
    p, held = xyz[order][fresh], np.diff(begin)
    across = p[begin[:-1]].astype(np.float64)
    across[:, axis] = 0
    cell = np.floor(xyz.astype(np.float64) / eps).astype(np.int64)
    size = _cells(cell[np.lexsort((cell[:, 2], cell[:, 1], cell[:, 0]))])[2]
    budget, pairs, most = int(np.sum(size.astype(np.float64) ** 2)), [(np.arange(len(held)), np.arange(len(held)))], 2 * len(p)
    for i, j in _pairs(across, eps * (1 + 1e-6)):
        pairs += [(i, j), (j, i)]
        most += int(held[i].sum() + held[j].sum())
        if most > budget:
            return None
    limit = xyz.dtype.type(eps) * xyz.dtype.type(eps)
    values, at = np.unique(p[:, axis], return_inverse=True)
    code, total = line * len(values) + at, np.append(fresh, len(xyz))
    found, along = np.zeros(len(p), np.int64), np.ascontiguousarray(p[:, axis])
    v = along.astype(np.float64)

    def moved(edge: np.ndarray, stop: np.ndarray, step: int, other: int, wanted: bool) -> None:
        """Move edges on, not beyond ``stop``, while the distinct point at ``edge + other`` is close, or isn't."""
        open_ = np.flatnonzero(edge != stop)
        while len(open_):
            d = along[own[open_]] - along[edge[open_] + other]
            x, y, z = (d * d if k == axis else square[k][which[open_]] for k in range(3))
            open_ = open_[(x + y + z <= limit) == wanted]
            edge[open_] += step
            open_ = open_[edge[open_] != stop[open_]]

    for lines, others in pairs:
        ends, start = np.cumsum(held[lines]), 0
        while start < len(lines):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, side="right")))
            i, j = lines[start:stop], others[start:stop]
            which, own, _ = _expanded(begin[i], held[i], begin[i], np.ones(len(i), np.int64))
            flat = across[i] - across[j]
            square = [d * d for d in (p[begin[i], k] - p[begin[j], k] for k in range(3))]
            reach = np.sqrt(np.maximum(float(limit) - (flat * flat).sum(axis=1), 0))[which]
            base, first, last = (j * len(values))[which], begin[j][which], begin[j + 1][which]
            low = np.searchsorted(code, base + np.searchsorted(values, v[own] - reach))
            high = np.searchsorted(code, base + np.searchsorted(values, v[own] + reach, side="right"))
            # the bounds are rounded; the points next to them tell where the range ends
            moved(low, first, -1, -1, True)
            moved(high, last, 1, 0, True)
            moved(low, high, 1, 0, False)
            moved(high, low, -1, -1, False)
            found += np.bincount(own, total[high] - total[low], len(p)).astype(np.int64)
            start = stop
    out = np.empty(len(xyz), np.int64)
    out[order] = np.repeat(found, np.diff(total))
    return out


def pair_counts(xyz: np.ndarray, eps: float) -> np.ndarray:
    """Neighbours of each point, itself included, by looking at the pairs of close cells."""
    found = np.ones(len(xyz), np.int64)
    for p, q in _pairs(xyz, eps):
        found += np.bincount(p, minlength=len(xyz)) + np.bincount(q, minlength=len(xyz))
    return found


def neighbor_counts(points: DataFrame, eps: float, count: int = SIDE) -> DataFrame:
    """frame_id, pt_idx and neighbors (valid points within eps, itself included) of each valid point: a task has a block's
    points and a margin, and only counts leave it. Points on few lines along an axis are counted by search, others pair by pair."""
    cell, kind = side(eps), dict(points.dtypes)
    rows = _valid(points).select("frame_id", "pt_idx", "x", "y", "z")

    def run(t: pa.Table) -> pa.Table:
        xyz = np.stack([t.column(c).to_numpy() for c in "xyz"], axis=1)
        found = line_counts(xyz, eps)
        found = pair_counts(xyz, eps) if found is None else found
        own = t.column("__own").to_numpy(zero_copy_only=False).astype(bool)
        return t.select(["frame_id", "pt_idx"]).append_column("neighbors", pa.array(found)).filter(pa.array(own))

    near = in_blocks(rows.where(_within(cell)), cell, count, REACH)
    counted = near.groupBy("frame_id", "__bx", "__by", "__bz").applyInArrow(run, f"frame_id {kind['frame_id']}, pt_idx {kind['pt_idx']}, neighbors long")
    return counted.unionByName(rows.where(~_within(cell)).select("frame_id", "pt_idx", F.lit(1).cast("long").alias("neighbors")))


def dbscan_by_blocks(points: DataFrame, eps: float, min_pts: int = 4, count: int = SIDE) -> DataFrame:
    """``points`` with cluster_id, as ``cluster.dbscan`` gives it for bridge == min_pts."""
    cell, kind = side(eps), dict(points.dtypes)
    rows = _valid(points).where(_within(cell)).select("frame_id", F.col("pt_idx").cast("long").alias("__id"), "x", "y", "z")

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        xyz = np.stack([t.column(c).to_numpy() for c in "xyz"], axis=1)
        low = np.array([k.as_py() for k in key[1:]], np.int64) * count
        block = Block(xyz, t.column("__id").to_numpy(), eps, low, count)
        node, options, links = block.local(min_pts)
        mine = (block.depth == 0)[block.home]
        frame = t.column("frame_id").slice(0, 1).combine_chunks()
        n, m = int(mine.sum()), len(links)
        return pa.table({
            "frame_id": frame.take(pa.array(np.zeros(n + m, np.int64))),
            "__id": pa.concat_arrays([pa.array(block.index[mine]), pa.nulls(m, pa.int64())]),
            "__node": pa.array(np.concatenate([node[mine], links[:, 0]]), mask=np.concatenate([node[mine] < 0, np.zeros(m, bool)])),
            "__near": pa.array([o for o, ok in zip(options, mine, strict=True) if ok] + [[int(v)] for v in links[:, 1]], pa.list_(pa.int64())),
        })

    def join(t: pa.Table) -> pa.Table:
        a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
        nodes, ids = numbered(a[a == b], np.stack([a[a != b], b[a != b]], axis=1))
        frame = t.column("frame_id").slice(0, 1).combine_chunks()
        return pa.table({"frame_id": frame.take(pa.array(np.zeros(len(nodes), np.int64))), "__node": pa.array(nodes), "cluster_id": pa.array(ids.astype(np.int64))})

    frame_kind = kind["frame_id"]
    placed = in_blocks(rows, cell, count, 2 * REACH).groupBy("frame_id", "__bx", "__by", "__bz")
    found = written(placed.applyInArrow(run, f"frame_id {frame_kind}, __id long, __node long, __near array<long>"), "blocks")
    linked = found.where("__id is null").select("frame_id", F.col("__node").alias("a"), F.col("__near")[0].alias("b"))
    roots = found.where("__id is not null and __node is not null").select("frame_id", F.col("__node").alias("a"), F.col("__node").alias("b"))
    ids = linked.union(roots).distinct().groupBy("frame_id").applyInArrow(join, f"frame_id {frame_kind}, __node long, cluster_id long")
    ids = written(ids, "clusters")
    core = found.where("__id is not null and __node is not null").join(ids, ["frame_id", "__node"]).select("frame_id", "__id", "cluster_id")
    border = found.where("__id is not null and __near is not null").select("frame_id", "__id", F.explode("__near").alias("__node"))
    border = border.join(ids, ["frame_id", "__node"]).groupBy("frame_id", "__id").agg(F.min("cluster_id").alias("cluster_id"))
    points, names = hidden(points, ("frame_id", "pt_idx"))
    labels = core.union(border).select("frame_id", F.col("__id").alias("__at"), "cluster_id")
    out = points.withColumn("__at", F.col("pt_idx").cast("long")).join(labels, ["frame_id", "__at"], "left")
    return shown(out.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(0)).cast("long")), names, "cluster_id")
