"""Searches of the pivot tree room by room, and scores of isolation forests."""

import numpy as np
import pandas as pd
import pytest

from abacist.operators import anomaly
from abacist.operators.anomaly import IsolationForest
from abacist.plans import pivots
from abacist.plans.neighbours import by_tree, points
from abacist.plans.pivots import PivotTree


@pytest.mark.parametrize("room_points", [60, 4000])
def test_a_visitor_is_sent_once_to_each_room(spark, monkeypatch, room_points):
    rng = np.random.default_rng(room_points)
    x = np.vstack([rng.normal(0, 1, (500, 8)), np.repeat(rng.normal(0, 1, (10, 8)), 10, axis=0)])
    pts = points(spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), **{f"f{i}": x[:, i] for i in range(8)}})), "id", [f"f{i}" for i in range(8)])
    monkeypatch.setattr(pivots, "BLOCK_POINTS", 100)
    monkeypatch.setattr(pivots, "ROOM_POINTS", room_points, raising=False)
    monkeypatch.setattr(pivots, "LEAF_POINTS", 20)
    sent, deal = [], pivots._together
    tree = PivotTree.build(pts, leaf_points=20, block_points=100)

    def dealt(left, right, keys, *rest):
        sent.append((keys, left.count(), left.select("id", *keys).distinct().count()))
        return deal(left, right, keys, *rest)

    monkeypatch.setattr(pivots, "_together", dealt)
    got = {}
    for r in by_tree(pts, tree, 5, True).collect():
        got.setdefault(r["qid"], []).append((r["distance"], r["tid"]))
    pieces = sum(-(-int(n) // room_points) for n in tree.sizes)
    assert all(rows == once <= pieces * len(x) for _, rows, once in sent) and sent[-1][0] == ["room"]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        assert np.allclose([v for v, _ in sorted(got[i])[:5]], np.sort(d[i])[:5])


def walked(tree, row):
    at = 0
    while tree[at][0] >= 0:
        at = int(tree[at][2] if row[int(tree[at][0])] <= tree[at][1] else tree[at][3])
    return tree[at][4]


@pytest.mark.parametrize("width", [1, 3])
def test_scores_equal_a_walk_through_the_trees(spark, monkeypatch, width):
    rng = np.random.default_rng(width)
    x = np.round(rng.normal(0, 2, (3000, width)), 1)
    names = [f"f{i}" for i in range(width)]
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(x)), **{n: x[:, i] for i, n in enumerate(names)}}))
    model = IsolationForest(trees=9, sample=40).fit(df, names, "k")
    seen, real = [], anomaly._path_sums
    monkeypatch.setattr(anomaly, "_path_sums", lambda trees, rows: seen.append(len(rows)) or real(trees, rows))
    got = model.transform(df).toPandas().sort_values("k")["score"].to_numpy()
    total = np.zeros(len(x))
    for tree in model.forest:
        total += [walked(tree, row) for row in x]
    assert (got == 2.0 ** (-(total / 9) / model.unit)).all()
    if width == 1:  # the trees are walked for their own cuts only, not for every row
        assert len(seen) == 1 and seen[0] <= 9 * 40
