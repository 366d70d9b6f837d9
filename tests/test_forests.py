"""Single linkage cut at a height: one search within it, forests of portions, chains joined at once."""

import numpy as np
import pyarrow as pa
import pytest

from abacist.operators import linkage
from abacist.plans import components, tiles
from abacist.plans.neighbours import points


def tree_within(x, height):
    """Kruskal over all pairs, by (distance, ends)."""
    a, b = np.triu_indices(len(x), 1)
    d = np.sqrt(((x[a] - x[b]) ** 2).sum(axis=1))
    root, out = list(range(len(x))), []
    for k in np.lexsort((b, a, d)):
        u, v = int(a[k]), int(b[k])
        while root[u] != u:
            u = root[u]
        while root[v] != v:
            v = root[v]
        if d[k] <= height and u != v:
            root[max(u, v)] = min(u, v)
            out.append((int(a[k]), int(b[k])))
    return sorted(out)


def table(spark, x):
    names = [f"f{k}" for k in range(x.shape[1])]
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in names)), names


@pytest.mark.parametrize("task, rounds", [(2_000_000, False), (200, True)])
def test_forest_within_a_height(spark, monkeypatch, task, rounds):
    rng = np.random.default_rng(5)
    x = np.round(np.concatenate([rng.normal(0, 1, (250, 3)), rng.normal(9, 0.2, (150, 3)), [[30.0, 0, 0]]]), 2)
    x = np.unique(x, axis=0)
    df, names = table(spark, x)
    monkeypatch.setattr(linkage, "TASK_EDGES", task)
    monkeypatch.setattr(linkage, "SOME_EDGES", 500)
    if not rounds:
        # Neither rounds of searches over all points nor labels that walk along the tree.
        for name in ("_large_tree", "connected_components"):
            monkeypatch.setattr(linkage, name, None)
    tree = linkage.spanning_tree(points(df, "id", names), 0, 0.8)
    assert sorted((r.a, r.b) for r in tree.collect()) == tree_within(x, 0.8)
    if not rounds:
        found = {r.id: r.cluster for r in linkage.single_linkage(df, names, "id", height=0.8, standardize=False, broadcast_points=0).collect()}
        a, b = np.array(tree_within(x, 0.8)).T
        root = tiles.linked(np.arange(len(x)), a, b)
        assert found == dict(enumerate(np.unique(root, return_inverse=True)[1].tolist()))


def test_pairs_beyond_one_portion_keep_the_least_edges(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(linkage, "SOME_EDGES", 300)
    x = np.round(rng.normal(0, 1, (120, 2)), 1)  # many ties
    x = np.unique(x, axis=0)
    ids = np.arange(len(x))
    own = linkage._lightest(linkage._light_pairs(ids, x, ids, x, 1.5))
    assert sorted(zip(own["a"].to_pylist(), own["b"].to_pylist())) == tree_within(x, 1.5)
    nothing = linkage._lightest(pa.table({c: pa.array([], t) for c, t in (("a", pa.int64()), ("b", pa.int64()), ("distance", pa.float64()))}))
    assert nothing.num_rows == 0


@pytest.mark.parametrize("most", [2_000_000, 3])
def test_chains(spark, monkeypatch, most):
    monkeypatch.setattr(components, "TASK_EDGES", most)
    n = 400 if most > 3 else 12
    order = np.random.default_rng(3).permutation(n).tolist()
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(order, order[1:])], "src long, dst long")
    nodes = spark.createDataFrame([(k,) for k in range(n + 2)], "node long")
    found = {r.node: r.root for r in components.components_of_chains(nodes, edges).collect()}
    assert found == {**dict.fromkeys(range(n), 0), n: n, n + 1: n + 1}
