"""Single linkage and density clusters against brute force."""

import numpy as np
import pandas as pd
import pytest

from abacist.operators import density, linkage
from abacist.operators.density import dbscan
from abacist.plans.neighbours import points


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), **{f"f{i}": x[:, i] for i in range(x.shape[1])}}))


def kruskal(x):
    """Heights at which components join, and a function from height to labels."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    i, j = np.triu_indices(len(x), 1)
    root, heights = np.arange(len(x)), []
    for k in np.argsort(d[i, j], kind="stable"):
        a, b = root[i[k]], root[j[k]]
        if a != b:
            root[root == max(a, b)] = min(a, b)
            heights.append(d[i[k], j[k]])

    def labels(height):
        out = np.arange(len(x))
        for a, b in zip(i, j):
            if d[a, b] <= height and out[a] != out[b]:
                out[out == max(out[a], out[b])] = min(out[a], out[b])
        return np.unique(out, return_inverse=True)[1]

    return heights, labels


def made(n, dims, seed):
    rng = np.random.default_rng(seed)
    grid = rng.integers(0, 4, (n // 3, dims)).astype(float)  # many equal distances and copies
    return np.vstack([rng.normal(0, 1, (n // 3, dims)), grid, rng.normal(9, 0.5, (n - 2 * (n // 3), dims))])


@pytest.mark.parametrize("limit,n", [(20_000, 150), (0, 45)])
def test_spanning_tree_and_heights(spark, limit, n):
    x = made(n, 2, n)
    heights, _ = kruskal(x)
    tree = linkage.spanning_tree(points(frame(spark, x), "id", ["f0", "f1"]), limit)
    rows = tree.collect()
    assert len(rows) == n - 1 and np.allclose(sorted(r.distance for r in rows), heights)
    steps = linkage.merge_heights(tree).orderBy("step").collect()
    assert np.allclose([s.distance for s in steps], heights) and [s.clusters for s in steps] == list(range(n - 1, 0, -1))


def test_labels_by_number_and_height(spark):
    x = made(90, 3, 4)
    heights, labels = kruskal(x)
    df, names = frame(spark, x), ["f0", "f1", "f2"]
    by_height = linkage.single_linkage(df, names, "id", height=0.9, standardize=False).toPandas().sort_values("id")
    assert by_height["cluster"].tolist() == labels(0.9).tolist()
    cut = int(np.flatnonzero(np.diff(heights) > 1e-9)[-1])  # a height that no tie crosses
    k = len(x) - cut - 1
    by_number = linkage.single_linkage(df, names, "id", k=k, standardize=False).toPandas().sort_values("id")
    assert by_number["cluster"].tolist() == labels((heights[cut] + heights[cut + 1]) / 2).tolist()


def test_density_beyond_four_features(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(0, 0.4, (90, 6)), rng.normal(5, 0.4, (60, 6)), rng.uniform(-9, 9, (30, 6)), np.zeros((20, 6))])
    eps, least = 1.1, 6
    got = dbscan(frame(spark, x), [f"f{i}" for i in range(6)], "id", eps, least).toPandas().sort_values("id")
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        low = np.where(core, np.where(near & core[None, :], label[None, :], len(x)).min(1), len(x))
        if (low == label).all():
            break
        label = low
    number = {v: k for k, v in enumerate(sorted(set(label[core])))}
    want = [number[label[i]] if core[i] else min([number[label[j]] for j in np.flatnonzero(near[i] & core)], default=-1) for i in range(len(x))]
    assert got["core"].tolist() == core.tolist() and got["cluster"].tolist() == want


def test_repeated_points_of_the_grid_are_not_broadcast(spark, monkeypatch):
    plans, join = [], density.skew_join

    def seen(big, other, on, *rest, **options):
        out = join(big, other, on, *rest, **options)
        if list(on) == ["near"]:
            plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(density, "skew_join", seen)
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 0.3, (60, 2)), rng.uniform(-9, 9, (60, 2))])
    dbscan(frame(spark, x), ["f0", "f1"], "id", 0.5, 5).collect()
    assert len(plans) == 3 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
