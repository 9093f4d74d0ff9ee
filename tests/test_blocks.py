"""DBSCAN and neighbour counts by blocks against those of whole frames."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrostrat.operators import blocks
from cirrostrat.operators import cluster as C


def by_blocks(xyz, eps, min_pts, count):
    """Cluster ids as the tasks give them, without Spark."""
    cell = blocks.cells_of(xyz, blocks.side(eps))
    home, index = cell // count, np.arange(len(xyz)) * 3 + 5
    nodes, near, roots, links = {}, {}, [], []
    for b in np.unique(home, axis=0):
        low = b * count
        here = ((cell >= low - 4) & (cell <= low + count + 3)).all(axis=1)
        block = blocks.Block(xyz[here], index[here], eps, low, count)
        node, options, joined = block.local(min_pts)
        mine = (block.depth == 0)[block.home]
        for i, v, o in zip(block.index[mine].tolist(), node[mine].tolist(), itertools.compress(options, mine), strict=True):
            if v >= 0:
                nodes[i] = v
                roots.append(v)
            elif o:
                near[i] = o
        links.append(joined)
    found = np.concatenate(links) if links else np.empty((0, 2), np.int64)
    named, ids = blocks.numbered(np.unique(np.array(roots, np.int64)), found)
    number = dict(zip(named.tolist(), ids.tolist(), strict=True))
    return [number[nodes[i]] if i in nodes else min((number[v] for v in near.get(i, [])), default=0) for i in index.tolist()]


@pytest.mark.parametrize(("count", "scenes"), [(1, 3), (2, 8), (5, 25), (32, 80)])
def test_random_scenes(count, scenes):
    rng = np.random.default_rng(count)
    for _ in range(scenes):
        n, kind = int(rng.integers(1, 40 if count == 1 else 120)), rng.integers(0, 4)
        span = float(rng.choice([1.0, 2.0, 4.0]))
        xyz = rng.uniform(-span, span, (n, 3)) * (1, 1, rng.choice([0.1, 1.0]))
        if kind == 1:  # lumps and repeated points
            xyz = xyz[rng.integers(0, max(1, n // 8), n)] + rng.normal(0, 0.05, (n, 3)) * rng.integers(0, 2, (n, 1))
        elif kind == 2:  # on a lattice, with distances that equal eps
            xyz = np.round(xyz * 4) / 4
        elif kind == 3:
            xyz = xyz.astype(np.float32)
        eps, min_pts = float(rng.choice([0.25, 0.3, 0.5, 0.9])), int(rng.integers(1, 7))
        assert by_blocks(xyz, eps, min_pts, count) == C.dbscan_labels(xyz, eps, min_pts).tolist()


def test_strips_of_large_cells(monkeypatch):
    """Thousands of points in a few cells, tested in pieces."""
    monkeypatch.setattr(blocks, "AT_ONCE", 2_000)
    rng = np.random.default_rng(1)
    lumps = np.concatenate([rng.normal(c, 0.03, (700, 3)) for c in ((0, 0, 0), (0.5, 0, 0), (1.4, 0, 0), (1.4, 0.45, 0))])
    xyz = np.concatenate([lumps, rng.uniform(-1, 2, (200, 3))])
    for eps in (0.35, 0.5):
        assert by_blocks(xyz, eps, 5, 4) == C.dbscan_labels(xyz, eps, 5).tolist()


def frames(spark, sizes, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f, i, *map(float, p)) for f, n in enumerate(sizes) for i, p in enumerate(np.concatenate([rng.uniform(-2, 2, (n, 3)), np.zeros((3, 3))]))]
    inf, nan = float("inf"), float("nan")
    rows += [(0, 10_000 + i, *p) for i, p in enumerate([(inf, 0.0, 1.0), (nan, 1.0, 1.0), (1e300, 0.0, 0.0), (1.0, -inf, nan), (-1e9, 1e9, 0.5)])]
    return spark.createDataFrame(rows, "frame_id long, pt_idx int, x double, y double, z double")


def test_frames_in_spark(spark):
    points = frames(spark, [300, 80, 0, 1]).withColumns({"valid": F.col("pt_idx") % 9 != 4, "__node": F.lit("n"), "__id": F.lit(7), "cell": F.lit(1.5), "__own": F.lit(True), "__label": F.lit(3)})
    for min_pts in (3,):
        got = {(r.frame_id, r.pt_idx): r.cluster_id for r in blocks.dbscan_by_blocks(points, 0.4, min_pts, 8).collect()}
        want = {(r.frame_id, r.pt_idx): r.cluster_id for r in C.dbscan(points, 0.4, min_pts).collect()}
        finite = [k for k in want if k[1] < 10_000]
        assert len(got) == len(want) and [got[k] for k in finite] == [want[k] for k in finite]
        assert all(got[k] == 0 for k in want if k[1] in range(10_000, 10_004))
    assert blocks.dbscan_by_blocks(points, 0.4, 3, 8).columns == [*points.columns, "cluster_id"]
    assert blocks.dbscan_by_blocks(points.limit(0), 0.4).collect() == []


def test_neighbor_counts_in_spark(spark):
    points = frames(spark, [250, 60], 2)
    got = {(r.frame_id, r.pt_idx): r.neighbors for r in blocks.neighbor_counts(points, 0.5, 8).collect()}
    for f in (0, 1):
        rows = [r for r in points.collect() if r.frame_id == f and (r.x or r.y or r.z)]
        xyz = np.array([(r.x, r.y, r.z) for r in rows])
        with np.errstate(invalid="ignore", over="ignore"):
            near = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2) <= 0.25
        for r, n in zip(rows, near.sum(axis=1).tolist(), strict=True):
            assert got[f, r.pt_idx] == max(n, 1)


@pytest.mark.parametrize("seed", range(4))
def test_points_on_lines_are_counted_by_search(seed):
    """Coordinates with steps along two axes, also repeated, with distances that equal eps: as pair by pair."""
    rng = np.random.default_rng(seed)
    for axes in itertools.permutations(range(3)):
        xyz = np.stack([rng.integers(-4, 5, 900) * 0.4, rng.uniform(-2, 2, 900), rng.integers(0, 4, 900) * 0.2], axis=1)[:, axes]
        for points in (xyz, np.round(xyz, 1), np.concatenate([xyz[:100]] * 9), xyz.astype(np.float32)):
            found = blocks.line_counts(points, 0.6)
            assert found is not None and found.tolist() == blocks.pair_counts(points, 0.6).tolist()


def test_neighbour_counts_of_lines(spark):
    xyz = [(0.4 * (i % 9), 0.001 * i + 0.1, 0.2 * (i % 5)) for i in range(3_000)]
    p = spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(xyz)], "frame_id long, pt_idx int, x double, y double, z double")
    a = np.array(xyz)
    want = [int((((a - v) ** 2).sum(axis=1) <= 0.5**2).sum()) for v in a[:200]]
    assert [r.neighbors for r in blocks.neighbor_counts(p, 0.5).orderBy("pt_idx").limit(200).collect()] == want
    assert blocks.line_counts(a, 0.5) is not None
