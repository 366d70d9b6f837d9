"""Single-linkage clustering: a minimum spanning tree by Boruvka rounds, cut by number or height."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.operators.cluster import Scaling
from abacist.plans.components import components_of_chains, connected_components
from abacist.plans.neighbours import BROADCAST_POINTS, nearest_neighbours, points
from abacist.plans.ordering import with_row_index
from abacist.plans.pivots import PivotTree, distances, in_steps, matrix, slack
from abacist.plans.session import stored
from abacist.plans.skew import skew_join
from abacist.plans.tiles import linked

EDGE = "a long, b long, distance double"
#: Neighbours of each point that are kept for all rounds.
KNOWN = 8
#: Edges that are thinned to a forest at a time, and that one task may hold.
SOME_EDGES = 65_536
TASK_EDGES = 2_000_000
_EDGES = pa.schema([("id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("distance", pa.float64())])


def _nearest_other(ids, x, label, tids, tx, tlabel, bound=None) -> pa.Table:
    """Of each row the least edge (distance, ends) to a point of another label: id, a, b, distance."""
    out = []
    for s in in_steps(len(x), len(tx)):
        d = distances(x[s], tx)
        d[label[s][:, None] == tlabel[None, :]] = np.inf
        least = d.min(axis=1)
        limit = least + slack(np.where(np.isinf(least), 0, least))
        if bound is not None:
            limit = np.minimum(limit, bound[s] + slack(bound[s]))
        i, j = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
        exact = np.sqrt(((x[s][i] - tx[j]) ** 2).sum(axis=1))
        one, two = np.minimum(ids[s][i], tids[j]), np.maximum(ids[s][i], tids[j])
        order = np.lexsort((two, one, exact, i))
        first = order[np.unique(i[order], return_index=True)[1]]
        out.append(pa.Table.from_arrays([pa.array(ids[s][i[first]]), pa.array(one[first]), pa.array(two[first]), pa.array(exact[first])], schema=_EDGES))
    return pa.concat_tables(out) if out else _EDGES.empty_table()


def _least_of_each(edges: pa.Table) -> pa.Table:
    ids, a, b, distance = (edges[c].to_numpy() for c in ("id", "a", "b", "distance"))
    order = np.lexsort((b, a, distance, ids))
    return edges.take(pa.array(order[np.unique(ids[order], return_index=True)[1]]))


def _least(edges: DataFrame) -> DataFrame:
    """The least edge of each label among (label, a, b, distance); equal lengths go by their ends, so no circle closes."""
    best = edges.groupBy("label").agg(F.min(F.struct("distance", "a", "b")).alias("e"))
    return best.select("label", "e.a", "e.b", "e.distance")


def _small_tree(spots: DataFrame) -> DataFrame:
    """Rounds over points that fit in memory: every task sees all of them."""
    spark = spots.sparkSession
    rows = spots.select("id", "x").orderBy("id").toArrow()  # at most broadcast_points
    ids, x = rows["id"].to_numpy(), matrix(rows["x"])
    label, told = np.arange(len(ids)), []
    while len(ids) and label.max() > 0:
        shared = spark.sparkContext.broadcast((ids, x, label))

        def search(batches, shared=shared):
            tids, tx, tlabel = shared.value
            for batch in batches:
                if batch.num_rows:
                    own = batch.column(0).to_numpy()
                    at = np.searchsorted(tids, own)
                    found = _nearest_other(own, tx[at], tlabel[at], tids, tx, tlabel)
                    at = np.searchsorted(tids, found["id"].to_numpy())
                    yield from found.append_column("label", pa.array(tlabel[at])).drop_columns(["id"]).to_batches()

        chosen = _least(spots.select("id").mapInArrow(search, f"{EDGE}, label long")).select("a", "b", "distance").distinct().collect()
        root = np.arange(len(ids))
        for a, b, distance in chosen:  # at most one edge for each label
            told.append((a, b, distance))
            u, v = (int(label[np.searchsorted(ids, e)]) for e in (a, b))
            while root[u] != u:
                u = root[u] = root[root[u]]
            while root[v] != v:
                v = root[v] = root[root[v]]
            root[max(u, v)] = min(u, v)
        while (root != root[root]).any():
            root = root[root]
        label = root[label]
        label = np.unique(label, return_inverse=True)[1]
        shared.unpersist()
    return spark.createDataFrame(told, EDGE)


def _large_tree(spots: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rounds on tables: known neighbours first, then only the balls and leaves that can hold a shorter edge."""
    tree = PivotTree.build(spots)
    known = stored(nearest_neighbours(spots, spots, KNOWN, exclude_self=True, broadcast_points=0).select(F.col("qid").alias("id"), F.col("tid").alias("other"), "distance"))
    reach = stored(known.groupBy("id").agg(F.max("distance").alias("reach")))
    labels = stored(spots.select("id", F.col("id").alias("label")))
    found = None
    for _ in range(max_rounds):
        heads = labels.groupBy("label").agg(F.min("id").alias("id")).orderBy("label").limit(2)
        ends = heads.join(spots, "id").select("x").collect()
        if len(ends) < 2:
            return found if found is not None else spots.sparkSession.createDataFrame([], EDGE)
        named = stored(tree.points.join(labels, "id"))
        other = labels.select(F.col("id").alias("other"), F.col("label").alias("other_label"))
        out = known.join(labels, "id").join(other, "other").filter("label <> other_label")
        near = stored(_least(out.select("label", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "distance")))
        # Two points of different labels: one of them is no member of the row's own component.
        away = [F.sqrt(F.aggregate(F.zip_with("x", F.lit(list(e["x"])), lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)) for e in ends]
        safe = named.groupBy("label").agg(F.min(F.greatest(*away)).alias("safe"))
        short = near.select(F.col("label").alias("of"), "distance")
        bounds = safe.join(short, F.col("label") == F.col("of"), "left").select("label", F.coalesce(F.col("distance"), F.col("safe")).alias("bound"))
        bounds = stored(bounds)
        # Points whose known neighbours reach beyond the bound have nothing to add.
        asking = named.join(bounds, "label").join(reach, "id", "left").filter(F.coalesce(F.col("reach") <= F.col("bound"), F.lit(True)))
        asking = stored(asking.select("id", "x", "bound", "label"))

        def work(rows: pa.Table, pts: pa.Table) -> pa.Table:
            if not rows.num_rows or not pts.num_rows:
                return _EDGES.empty_table()
            own = pts["label"].to_numpy()
            if (own == own[0]).all():  # a leaf of one component has nothing for its own points
                rows = rows.filter(pc.not_equal(rows["label"], int(own[0])))
                if not rows.num_rows:
                    return _EDGES.empty_table()
            cells = [t[c].to_numpy() for t, c in ((rows, "id"), (rows, "label"), (pts, "id"), (pts, "label"))]
            return _nearest_other(cells[0], matrix(rows["x"]), cells[1], cells[2], matrix(pts["x"]), cells[3], rows["bound"].to_numpy())

        met = replace(tree, points=named).search(asking, work, f"id long, {EDGE}", _least_of_each).join(labels, "id").select("label", "a", "b", "distance")
        chosen = stored(_least(near.unionByName(met)).select("a", "b", "distance").distinct())
        found = chosen if found is None else stored(found.unionByName(chosen))
        linked = chosen.join(labels.select(F.col("id").alias("a"), F.col("label").alias("src")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("dst")), "b")
        roots = connected_components(labels.select(F.col("label").alias("node")).distinct(), linked.select("src", "dst"))
        labels = stored(skew_join(labels, roots.select(F.col("node").alias("label"), "root"), ["label"]).select("id", F.col("root").alias("label")))
    raise RuntimeError("the spanning tree did not close")


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.float64())])


def _lightest(edges: pa.Table) -> pa.Table:
    """The minimum spanning forest of some edges; an edge that it lacks is in no forest of more edges either."""
    a, b, distance = (edges[c].to_numpy() for c in _PAIRS.names)
    order = np.lexsort((b, a, distance))
    names, ends = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    u, v = ends[: len(order)], ends[len(order) :]
    root, kept, at = np.arange(len(names)), np.zeros(len(order), bool), np.arange(len(order))
    while True:
        at = at[root[u[at]] != root[v[at]]]
        if not len(at):
            return edges.select(_PAIRS.names).take(pa.array(order[kept]))
        least = np.full(len(names), len(order))
        np.minimum.at(least, root[u[at]], at)
        np.minimum.at(least, root[v[at]], at)
        taken = np.unique(least[least < len(order)])
        kept[taken] = True
        root = linked(root, u[taken], v[taken])


def _light_pairs(ids: np.ndarray, x: np.ndarray, tids: np.ndarray, tx: np.ndarray, height: float) -> pa.Table:
    """A forest of the pairs within `height`: the nearest first, then only those that their components leave open."""
    half, names, forest = (tx * tx).sum(axis=1) / 2, np.union1d(ids, tids), _PAIRS.empty_table()
    at, to = np.searchsorted(names, ids), np.searchsorted(names, tids)
    limit = height + slack(np.array(height))
    for s in in_steps(len(x), len(tx)):
        inner = x[s] @ tx.T - half
        own = (x[s] * x[s]).sum(axis=1) / 2
        i, j = np.nonzero(inner >= (own - limit * limit / 2)[:, None])
        away = np.sqrt(np.clip(2 * (own[i] - inner[i, j]), 0, None))
        i += s.start
        if len(i) > SOME_EDGES:
            order = np.argsort(away)
            i, j, away = i[order], j[order], away[order]
        root = np.arange(len(names))
        for k in range(0, len(i), SOME_EDGES):
            p, q = i[k : k + SOME_EDGES], j[k : k + SOME_EDGES]
            if k:  # distances from inner products are short of exact by less than the slack
                sure = forest.filter(pc.less(forest["distance"], float(away[k] - 2 * slack(away[k]))))
                root = linked(root, np.searchsorted(names, sure["a"].to_numpy()), np.searchsorted(names, sure["b"].to_numpy()))
            open_ = (root[at[p]] != root[to[q]]) & (at[p] != to[q])
            p, q = p[open_], q[open_]
            exact = np.sqrt(((x[p] - tx[q]) ** 2).sum(axis=1))
            near = exact <= height
            one, two = ids[p[near]], tids[q[near]]
            some = pa.Table.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(exact[near])], schema=_PAIRS)
            forest = pa.concat_tables([forest, some])
            if len(i) > SOME_EDGES or forest.num_rows > 2 * (len(names) + SOME_EDGES):
                forest = _lightest(forest)
    return forest


def _forest_of(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of a table of edges: thinned in portions while that helps, then by rounds."""
    rows = edges.count()
    while rows > TASK_EDGES:
        part = F.pmod(F.xxhash64("a", "b"), F.lit(-(-rows // TASK_EDGES))).alias("part")
        edges = stored(edges.select(*_PAIRS.names, part).groupBy("part").applyInArrow(_lightest, EDGE))
        before, rows = rows, edges.count()
        if rows > 0.8 * before and rows > TASK_EDGES:
            return _by_rounds(edges)

    def whole(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        if tables:
            yield from _lightest(pa.concat_tables(tables).combine_chunks()).to_batches()

    return stored(edges.select(*_PAIRS.names).coalesce(1).mapInArrow(whole, EDGE))


def _by_rounds(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id")))
    found = stored(edges.limit(0))
    for _ in range(max_rounds):
        ends = edges.join(labels.select(F.col("id").alias("a"), F.col("label").alias("src")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("dst")), "b")
        out = stored(ends.filter("src <> dst"))
        if out.isEmpty():
            return found
        best = _least(out.select(F.explode(F.array("src", "dst")).alias("label"), "a", "b", "distance")).select("a", "b", "distance").distinct()
        chosen = stored(out.join(best.select("a", "b"), ["a", "b"]).select("a", "b", "distance", "src", "dst").distinct())
        found = stored(found.unionByName(chosen.select("a", "b", "distance")))
        roots = connected_components(labels.select(F.col("label").alias("node")).distinct(), chosen.select("src", "dst"))
        labels = stored(skew_join(labels, roots.select(F.col("node").alias("label"), "root"), ["label"]).select("id", F.col("root").alias("label")))
        edges = out.select("a", "b", "distance")
    raise RuntimeError("the spanning forest did not close")


def _forest_within(spots: DataFrame, height: float) -> DataFrame:
    """One pass over the pairs within `height`: each task returns a forest of its own, and these are thinned to one."""
    tree = PivotTree.build(spots)

    def work(rows: pa.Table, pts: pa.Table) -> pa.Table:
        if not rows.num_rows or not pts.num_rows:
            return _PAIRS.empty_table()
        return _light_pairs(rows["id"].to_numpy(), matrix(rows["x"]), pts["id"].to_numpy(), matrix(pts["x"]), height)

    asking = stored(tree.points.select("id", "x", F.lit(float(height)).alias("bound"), "cell"))
    return _forest_of(stored(tree.search(asking, work, EDGE, _lightest, ahead=True)))


def spanning_tree(pts: DataFrame, broadcast_points: int = BROADCAST_POINTS, height: float | None = None) -> DataFrame:
    """`(a, b, distance)`: the minimum spanning tree of `(id, x)`, one edge less than there are points.

    In each round every component takes its least edge to another one, so at
    most half of them are left.  Copies of a position hang on the one with the
    smallest id, at distance 0.  With `height`, longer edges need not be among
    them; many points are then searched within that distance only, once.
    """
    spots = stored(pts.groupBy("x").agg(F.min("id").alias("id")).select("id", "x"))
    copies = skew_join(pts, spots.select("x", F.col("id").alias("first")), ["x"]).filter("id <> first")
    copies = copies.select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("distance"))
    if spots.count() <= broadcast_points:
        tree = _small_tree(spots)
    else:
        tree = _large_tree(spots) if height is None else _forest_within(spots, height)
    return stored(tree.unionByName(copies))


def merge_heights(tree: DataFrame) -> DataFrame:
    """`(step, distance, clusters)`: the order in which components join, and how many are left then."""
    steps = with_row_index(tree, ["distance", "a", "b"], "step")
    total = F.lit(tree.count() + 1)
    return steps.select(F.col("step"), "distance", (total - F.col("step") - 1).alias("clusters"))


def single_linkage(
    df: DataFrame, features: Sequence[str], key: str, k: int | None = 3, height: float | None = None, standardize: bool = True, broadcast_points: int = BROADCAST_POINTS
) -> DataFrame:
    """`(key, cluster)`: agglomerative clusters of smallest gaps, numbered by their smallest keys.

    `k` clusters, or with `height` all that steps of at most that length join.
    Rows with a missing feature are dropped; keys are integers.
    """
    scaling = Scaling.of(df, features, standardize)
    pts = stored(points(scaling.scaled(df, [key]), key, scaling.names))
    tree = spanning_tree(pts, broadcast_points, height)
    if height is not None:
        kept = tree.filter(F.col("distance") <= height)
    else:
        heaviest = tree.orderBy(F.desc("distance"), F.desc("a"), F.desc("b")).limit(max(k, 1) - 1)
        kept = tree.join(heaviest.select("a", "b"), ["a", "b"], "left_anti")
    roots = components_of_chains(pts.select(F.col("id").alias("node")), kept.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    numbers = with_row_index(roots.select("root").distinct(), ["root"], "cluster")
    return skew_join(roots, numbers, ["root"]).select(F.col("node").alias(key), F.col("cluster").cast("int").alias("cluster"))
