"""DBSCAN by boxes of cells: as by plain loops, wherever the boxes are cut."""

import numpy as np
import pytest

from abacist.operators import density
from abacist.plans import tiles


def plain(x, eps, min_points):
    """(cluster, core) of each row; clusters go by the least name of the cells of their core points."""
    n, dims = x.shape
    near = tiles.square_distances(x[:, None], x[None]) <= eps * eps
    core = near.sum(1) >= min_points
    root = np.arange(n)
    a, b = np.nonzero(near & core[:, None] & core[None])
    root = tiles.linked(root, a, b)
    side = eps / np.sqrt(dims) * (1 - 1e-12)
    names = [",".join(map(str, c)) for c in np.floor(x / side).astype(int).tolist()]
    least = {r: min(names[i] for i in np.flatnonzero(core & (root == r))) for r in set(root[core].tolist())}
    number = {r: k for k, r in enumerate(sorted(least, key=least.get))}
    label = [number[root[i]] if core[i] else min((number[root[j]] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(n)]
    return dict(enumerate(zip(label, core.tolist())))


def points(dims, n, scale):
    rng = np.random.default_rng(dims)
    x = np.round(rng.normal(0, scale, (n, dims)), 2)
    # A dense spot, copies, and a hot position.
    return np.concatenate([x, rng.normal(0, 0.05, (120, dims)), x[:60], np.repeat(x[:1], 40, axis=0)])


def labels(spark, x, eps, min_points):
    names = [f"c{k}" for k in range(x.shape[1])]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in names)).repartition(4)
    return {r.id: (r.cluster, r.core) for r in density.dbscan(df, names, "id", eps, min_points).collect()}


@pytest.mark.parametrize("dims, n, scale, eps", [(1, 300, 30.0, 0.4), (2, 900, 7.0, 0.6), (3, 500, 2.0, 0.6), (4, 300, 1.0, 0.6)])
def test_boxes_give_what_plain_loops_give(spark, monkeypatch, dims, n, scale, eps):
    # Points are not repeated as rows for each of the cells around them.
    monkeypatch.setattr(density, "_around", None)
    monkeypatch.setattr(density, "LEAST_POINTS", 0)
    monkeypatch.setattr(tiles, "TILE_POINTS", 60)
    x = points(dims, n, scale)
    found = labels(spark, x, eps, 5)
    assert found == plain(x, eps, 5)
    assert len({c for c, _ in found.values()}) > 3


def test_joins_of_cells_give_the_same(spark, monkeypatch):
    x = points(2, 300, 5.0)
    monkeypatch.setattr(density, "MOST_POINTS", -1)
    assert labels(spark, x, 0.6, 5) == plain(x, 0.6, 5)


def test_splits_cover_every_cell_once(spark, monkeypatch):
    monkeypatch.setattr(tiles, "PLANNED_CELLS", 200)
    x = points(2, 2000, 30.0)
    spots = spark.createDataFrame([(v.tolist(), 1, [int(k) for k in np.floor(v)]) for v in x], "x array<double>, w long, cell array<long>")
    plan = tiles.Tiles.plan(spots, 2, 4, 100)
    rows = plan.dealt(spots).collect()
    low, high = plan.low, plan.high
    home = [r for r in rows if (np.array(r.cell) >= low[r.tile]).all() and (np.array(r.cell) <= high[r.tile]).all()]
    assert len(low) > 5 and sorted(r.x for r in home) == sorted(v.tolist() for v in x)
    wide = sum(((np.floor(x) >= np.where(a == tiles.FIRST, a, a - 4)) & (np.floor(x) <= np.where(b == tiles.LAST, b, b + 4))).all(1).sum() for a, b in zip(low, high))
    assert len(rows) == wide


def test_any_within():
    rng = np.random.default_rng(1)
    for k in range(60):
        a, b = rng.normal(0, 1, (rng.integers(1, 80), 2)), rng.normal((2 + k / 20, 0), 1, (rng.integers(1, 80), 2))
        assert tiles.any_within(a, b, 0.3, most=10) == bool((tiles.square_distances(a[:, None], b[None]) <= 0.09).any())
