"""Ordering, quantiles, skewed joins, ranks, neighbours, components."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from abacist.plans import skew
from abacist.plans.components import connected_components
from abacist.plans.kendall import kendall_counts
from abacist.plans.moments import _narrow, _wide, complete
from abacist.plans.neighbours import by_tree, nearest_neighbours, points, search_bounds
from abacist.plans.ordering import carried, windowed, with_row_index, with_running_totals
from abacist.plans.pivots import PivotTree
from abacist.plans.quantiles import exact_quantiles, grouped_quantiles, order_statistics, ranked_summary
from abacist.plans.ranks import average_ranks


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(1)
    # A third of the rows share one value.
    rows = [(i, "a" if rng.random() < 0.6 else "b", 7.0 if i % 3 == 0 else rng.gauss(0, 10)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k long, g string, v double")


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_row_index_ignores_partitioning(spark, numbers, parts):
    rows, df = numbers
    got = {r["k"]: r["i"] for r in with_row_index(df.repartition(parts), ["v", "k"], "i").collect()}
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert got == want


def test_running_totals(spark):
    df = spark.range(1000).withColumn("w", F.col("id") % 7)
    got = {r["id"]: r["s"] for r in with_running_totals(df.repartition(5), ["id"], {"s": "w"}).collect()}
    assert got == dict(enumerate(itertools.accumulate(i % 7 for i in range(1000))))


@pytest.mark.parametrize("limits", [dict(direct_rows=0), dict(direct_rows=0, bracket_rows=5), dict(direct_rows=0, bracket_rows=100), dict()])
def test_exact_quantiles(numbers, limits):
    rows, df = numbers
    probs = [0.0, 0.01, 0.25, 0.3333, 0.5, 0.9, 1.0]
    got = exact_quantiles(df.repartition(7), ["v"], probs, **limits)["v"]
    assert np.allclose(got, np.quantile([r[2] for r in rows], probs), atol=1e-9)


def test_quantiles_of_empty_and_null(spark):
    df = spark.createDataFrame([(None, float("nan"))] * 3, "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [None]}
    assert exact_quantiles(df, ["a"], [0.5], direct_rows=0) == {"a": [None]}


def test_order_statistics(numbers):
    rows, df = numbers
    ordered = sorted(r[2] for r in rows)
    got = order_statistics(df, {"v": [0, 17, 1500, 2999]}, bracket_rows=10)
    assert got == {("v", k): ordered[k] for k in (0, 17, 1500, 2999)}


def test_grouped_quantiles_ordered_plan(numbers):
    rows, df = numbers
    got = {r["g"]: (r["lo"], r["hi"]) for r in grouped_quantiles(df, ["g"], "v", (0.1, 0.75), ("lo", "hi"), direct_rows=0).collect()}
    for g in "ab":
        assert np.allclose(got[g], np.quantile([r[2] for r in rows if r[1] == g], [0.1, 0.75]))


def test_windowed_blocks_match_one_window(spark):
    df = spark.range(500).select(F.col("id").alias("i"), (F.col("id") * 13 % 101).cast("double").alias("v"))
    out = windowed(df, "i", lambda w: {"a": F.lag("v", 3).over(w), "b": F.sum("v").over(w.rowsBetween(-4, 2))}, 4, 2, block_rows=16)
    v = [i * 13 % 101 for i in range(500)]
    for r in out.collect():
        i = r["i"]
        assert r["a"] == (v[i - 3] if i >= 3 else None)
        assert r["b"] == sum(v[max(0, i - 4) : i + 3])


@pytest.mark.parametrize("forward", [True, False])
def test_carried_across_blocks_and_groups(spark, forward):
    rows = [(i, i // 100, float(i) if i % 37 == 0 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, g long, v double")
    out = carried(df, "i", ["v"], ["g"], forward=forward, block_rows=8).collect()
    for r in out:
        same = [x for x in rows if x[1] == r["g"] and x[2] is not None]
        side = [x for x in same if (x[0] <= r["i"] if forward else x[0] >= r["i"])]
        want = (side[-1] if forward else side[0])[2] if side else None
        assert (r["v_carried"]["value"] if r["v_carried"] else None) == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_spreads_hot_keys(spark, how, monkeypatch):
    monkeypatch.setattr(skew, "SPREAD_ROWS", 1000)
    big = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    other = spark.range(0, 9000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("b")).unionByName(spark.createDataFrame([(1, 5)], "k long, b long"))
    assert skew.hot_keys(big, ["k"]) == [(1,)]
    got = sorted(map(tuple, skew.skew_join(big, other, ["k"], how).select("k", "a", "b").collect()), key=str)
    want = sorted(map(tuple, big.join(other, "k", how).select("k", "a", "b").collect()), key=str)
    assert got == want


def test_average_ranks_with_salted_join(spark, numbers, monkeypatch):
    rows, df = numbers
    import abacist.plans.ranks as ranks

    plain = {r["k"]: r["r"] for r in average_ranks(df, "v", None, "r").collect()}
    monkeypatch.setattr(ranks, "SINGLE_TASK_VALUES", 10)
    monkeypatch.setattr(ranks, "SPREAD_ROWS", 1000)
    assert plain == {r["k"]: r["r"] for r in average_ranks(df, "v", None, "r").collect()}
    v = np.array([r[2] for r in rows])
    assert all(plain[k] == (v < x).sum() + ((v == x).sum() + 1) / 2 for k, _, x in rows[:50])


def test_kendall_counts_brute_force(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(9)), float(rng.randrange(13))) for _ in range(150)]
    k = kendall_counts(spark.createDataFrame(rows, "x double, y double"), "x", "y")
    con = sum((a[0] - b[0]) * (a[1] - b[1]) > 0 for a, b in itertools.combinations(rows, 2))
    dis = sum((a[0] - b[0]) * (a[1] - b[1]) < 0 for a, b in itertools.combinations(rows, 2))
    assert (k["n"], k["concordant"], k["discordant"]) == (150, con, dis)


def test_wide_and_narrow_moments_agree(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(5, 2, (400, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    data = complete(df, list("abcd"))
    for m in (_narrow(data, list("abcd")), _wide(data, list("abcd"))):
        assert np.allclose(m.cov, np.cov(x.T)) and np.allclose(m.mean, x.mean(0))


@pytest.mark.parametrize("limit", [0, 20_000])
def test_neighbours_brute_force(spark, limit):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (150, 3)), rng.normal(8, 0.1, (100, 3)), np.zeros((120, 3))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double").repartition(5)
    pts = points(df, "id", ["a", "b", "c"])
    got = {}
    for r in nearest_neighbours(pts, pts, 4, exclude_self=True, broadcast_points=limit).collect():
        got.setdefault(r["qid"], []).append((r["distance"], r["tid"]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(len(x)):
        want = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:4]
        assert np.allclose([v for v, _ in sorted(got[i])], [v for v, _ in want])
        assert sorted(got[i])[0][1] != i and len(got[i]) == 4


def test_components(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)]
    nodes = spark.createDataFrame([(f"{i:03d}",) for i in range(61)] + [("x",), ("y",), ("z",)], "node string")
    edges = spark.createDataFrame([*chain, ("z", "y")], "src string, dst string")
    got = dict(map(tuple, connected_components(nodes, edges).select("node", "root").collect()))
    assert {got[f"{i:03d}"] for i in range(61)} == {"000"} and got["x"] == "x" and got["z"] == got["y"] == "y"


def _compared(spark, x, k):
    """Points that queries meet in the tree search, and the search's answer."""
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), **{f"f{i}": x[:, i] for i in range(x.shape[1])}}))
    pts = points(df, "id", [f"f{i}" for i in range(x.shape[1])])
    tree = PivotTree.build(pts, leaf_points=50, block_points=200)
    visits = tree.visits(search_bounds(pts, tree, k, True))
    size = tree.points.groupBy("cell", "leaf", "part").count()
    return visits.join(size, ["cell", "leaf", "part"]).agg(F.sum("count")).first()[0], tree, pts


def test_neighbour_search_grows_less_than_the_square(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.uniform(0, 10, (6000, 2)), rng.normal(3, 0.01, (2000, 2))])
    rng.shuffle(x)
    met = [_compared(spark, x[:n], 4)[0] for n in (500, 2000, 8000)]
    assert met[1] < 6 * met[0] and met[2] < 6 * met[1]  # the square would be 16
    assert met[2] < 0.12 * 8000 * 8000


def test_tree_search_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(0, 1, (700, 5)), np.repeat(rng.normal(0, 1, (30, 5)), 10, axis=0), rng.normal(40, 5, (3, 5))])
    _, tree, pts = _compared(spark, x, 6)
    assert tree.leaves.count() > 8
    got = {}
    for r in by_tree(pts, tree, 6, True).collect():
        got.setdefault(r["qid"], []).append((r["distance"], r["tid"]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(len(x)):
        want = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:6]
        assert np.allclose([v for v, _ in sorted(got[i])[:6]], [v for v, _ in want])


@pytest.mark.parametrize("limit", [10, 60, 100_000])
def test_ranked_summary_of_several_columns(spark, limit):
    rng = np.random.default_rng(limit)
    n = 4000
    x = pd.DataFrame({
        "a": rng.normal(0, 5, n), "b": rng.integers(0, 6, n).astype(float), "c": np.where(rng.random(n) < 0.4, 7.0, rng.normal(7, 3, n)),
        "d": np.where(rng.random(n) < 0.3, np.nan, rng.exponential(2, n)), "e": np.full(n, 2.5), "g": np.full(n, np.nan),
    })
    df = spark.createDataFrame(x).repartition(7)
    spans = {c: (int(x[c].count()), *((float(x[c].min()), float(x[c].max())) if x[c].count() else (None, None))) for c in x}
    probs = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    got = ranked_summary(df, list(x), spans, probs, 0.1, [F.sum("b").alias("total")], bracket_rows=limit)
    assert got.extra["total"] == x["b"].sum()
    for c in x:
        v = np.sort(x[c].dropna().to_numpy())
        if not len(v):
            assert got.quantiles[c] == [None] * 6 and got.trimmed[c] is None
            continue
        k = int(0.1 * len(v))
        assert np.allclose(got.quantiles[c], np.quantile(v, probs)) and np.isclose(got.trimmed[c], v[k : len(v) - k].mean()), c
