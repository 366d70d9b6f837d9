"""Density-based clusters (DBSCAN) on a grid, without forming all close pairs.

The grid side is eps / sqrt(dims), so any two points of one cell are within
eps.  A cell that holds `min_points` rows is therefore all core, unseen.  Only
points of thinner cells need neighbour counts, and a cell meets a bounded
number of other cells, so those joins grow linearly with the data.  Two full
cells are linked by testing few of their points, then the rest, unless other
cells join them already.  Boxes of cells, with the cells around them, are worked on in
one task each; their components meet in the cells that several boxes hold.
Where a few cells have more points than a task should hold, or all cells few,
they are joined as tables instead, and full ones linked by sub-cells of a finer and finer grid.

Beyond four features a grid has too many neighbouring cells.  There the
points form a tree of pivots and meet the leaves that their balls reach, room
by room; only counts and one spanning forest per room leave a task, never
pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacist.plans.components import connected_components
from abacist.plans.neighbours import points
from abacist.plans.pivots import STEP, PivotTree, distances, in_steps, matrix, row_lists, slack
from abacist.plans.quantiles import clean_double, complete_rows
from abacist.plans.session import durable, stored
from abacist.plans.skew import skew_join
from abacist.plans.tiles import FIRST, LAST, Cells, Tiles, any_within, int_matrix, linked, portions, ranges, square_distances

MAX_DIMS = 4
HALVINGS = 5
#: Distinct points that a box of cells and its surroundings may have to be worked on by one task.
MOST_POINTS = 1_000_000
#: Fewer distinct points are joined as tables: no box is worth planning.
LEAST_POINTS = 512


def _cell(x: Column, dims: int, side: float) -> Column:
    return F.array(*[F.floor(x[i] / F.lit(side)).cast("long") for i in range(dims)])


def _offsets(dims: int) -> list[tuple[int, ...]]:
    """Cell offsets whose boxes can come within eps."""
    reach = math.ceil(math.sqrt(dims))
    keep = []
    for o in product(range(-reach, reach + 1), repeat=dims):
        gap = sum(max(abs(v) - 1, 0) ** 2 for v in o)
        if gap <= dims + 1e-9:
            keep.append(o)
    return keep


def _shifted(cell: Column, dims: int, offsets: Sequence[tuple[int, ...]]) -> Column:
    return F.array(*[F.array(*[cell[i] + F.lit(o[i]) for i in range(dims)]) for o in offsets])


def _around(rows: DataFrame, dims: int, offsets: Sequence[tuple[int, ...]], *keep: str | Column) -> DataFrame:
    """(keep, near): each row once for every cell near its own.

    The planner takes the repeats for as many rows as there were before; by that size it would send all of them to
    the driver as a broadcast.
    """
    return rows.select(*keep, F.explode(_shifted(F.col("cell"), dims, offsets)).alias("near")).hint("merge")


def _square_distance(a: str, b: str, dims: int) -> Column:
    return sum(((F.col(a)[i] - F.col(b)[i]) * (F.col(a)[i] - F.col(b)[i]) for i in range(dims)), F.lit(0.0))


def _box_gap(dims: int, farthest: bool) -> Column:
    """Smallest or largest squared distance between two sub-cells, in sub-cell sides."""
    total = F.lit(0.0)
    for i in range(dims):
        step = F.abs(F.col("sub_a")[i] - F.col("sub_b")[i]).cast("double")
        edge = step + 1 if farthest else F.greatest(step - 1, F.lit(0.0))
        total = total + edge * edge
    return total


def _full_links(full: DataFrame, dims: int, side: float, eps: float) -> DataFrame:
    """Pairs of full cells that hold core points within eps: `(a, b)`."""
    offsets = [o for o in _offsets(dims) if o > tuple([0] * dims)]
    cells = full.select("cell").distinct()
    pairs = cells.select(F.col("cell").alias("a"), F.explode(_shifted(F.col("cell"), dims, offsets)).alias("b"))
    open_ = durable(pairs.join(cells.select(F.col("cell").alias("b")), "b", "left_semi"))
    found = None
    # Occupied sub-cells of the pairs still undecided.
    parents = open_.select("a", "b", F.col("a").alias("sub_a"), F.col("b").alias("sub_b"))
    for level in range(1, HALVINGS + 1):
        unit = side / (1 << level)
        sub = full.select("cell", _cell(F.col("x"), dims, unit).alias("sub")).distinct()
        up = F.array(*[F.expr(f"shiftright(sub[{i}], 1)") for i in range(dims)])
        child = sub.select(up.alias("parent"), "sub")
        left = parents.join(child.select(F.col("parent").alias("sub_a"), F.col("sub").alias("next_a")), "sub_a")
        both = left.join(child.select(F.col("parent").alias("sub_b"), F.col("sub").alias("next_b")), "sub_b")
        both = both.select("a", "b", F.col("next_a").alias("sub_a"), F.col("next_b").alias("sub_b"))
        limit = (eps / unit) ** 2
        near = durable(both.filter(_box_gap(dims, False) <= F.lit(limit * (1 + 1e-12))))
        sure = near.filter(_box_gap(dims, True) <= F.lit(limit * (1 - 1e-12))).select("a", "b").distinct()
        found = sure if found is None else found.unionByName(sure)
        found = durable(found.distinct())
        parents = durable(near.join(found, ["a", "b"], "left_anti"))
    # What is left sits in sub-cells of side / 2^HALVINGS: compare the points themselves.
    unit = side / (1 << HALVINGS)
    pts = full.select(_cell(F.col("x"), dims, unit).alias("sub"), "x")
    left = parents.join(pts.select(F.col("sub").alias("sub_a"), F.col("x").alias("xa")), "sub_a")
    both = left.join(pts.select(F.col("sub").alias("sub_b"), F.col("x").alias("xb")), "sub_b")
    exact = both.filter(_square_distance("xa", "xb", dims) <= F.lit(eps * eps)).select("a", "b").distinct()
    return found.unionByName(exact).distinct()


def dbscan(df: DataFrame, features: Sequence[str], key: str, eps: float = 0.5, min_points: int = 5) -> DataFrame:
    """`(key, cluster, core)`; noise is -1.

    A border point within reach of several clusters joins the one with the
    smallest number.
    """
    dims = len(features)
    if dims > MAX_DIMS:
        return _by_tree(df, features, key, eps, min_points)
    side = eps / math.sqrt(dims) * (1 - 1e-12)
    rows = complete_rows(df.select(F.col(key).alias("id"), *[clean_double(c).alias(f"f{i}") for i, c in enumerate(features)]))
    # Copies of a position count once with a weight.
    spots = rows.select(F.array(*[f"f{i}" for i in range(dims)]).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("w"))
    spots = stored(spots.withColumn("cell", _cell(F.col("x"), dims, side)))
    # A point counts its neighbours in the cells around its own, of which all points must be there, too.
    tiles = Tiles.plan(spots, dims, 2 * math.ceil(math.sqrt(dims)))
    fits = tiles.total >= LEAST_POINTS and tiles.most <= MOST_POINTS
    labels = _by_boxes(spots, tiles, dims, eps, min_points) if fits else _by_joins(spots, dims, side, eps, min_points)
    spread = rows.select("id", F.array(*[f"f{i}" for i in range(dims)]).alias("x"))
    out = skew_join(spread, labels, ["x"], "left")
    return out.select(F.col("id").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("core", F.lit(False)).alias("core"))


FOUND = pa.schema([("kind", pa.int32()), ("x", pa.list_(pa.float64())), ("label", pa.string()), ("cell", pa.string())])
CORE, BORDER, LINK = 0, 1, 2


def _close(cells: Cells, x: np.ndarray, own: np.ndarray, who: np.ndarray, met: np.ndarray, offsets: Sequence[tuple[int, ...]], eps: float):
    """(asking, met) places of points within eps, portion by portion; points are sorted by their cell."""
    start = np.searchsorted(own[met], np.arange(cells.count + 1))
    asked, at = np.unique(own[who], return_inverse=True)
    for o in offsets:
        there = cells.find(cells.rows[asked] + np.array(o))[at]
        q = who[there >= 0]
        there = there[there >= 0]
        count = start[there + 1] - start[there]
        for s in portions(count, STEP):
            i, j = np.repeat(q[s], count[s]), met[ranges(start[there[s]], count[s])]
            near = square_distances(x[i], x[j]) <= eps * eps
            yield i[near], j[near]


def _link_full(root: np.ndarray, cells: Cells, x: np.ndarray, own: np.ndarray, full: np.ndarray, offsets: Sequence[tuple[int, ...]], eps: float) -> np.ndarray:
    """Joins full cells with points within eps; cells that hang together already are not compared."""
    start = np.searchsorted(own, np.arange(cells.count + 1))
    size, mine = np.diff(start), np.flatnonzero(full)
    ahead = [o for o in offsets if o > tuple([0] * x.shape[1])]
    for o in sorted(ahead, key=lambda o: sum(v * v for v in o)):
        there = cells.find(cells.rows[mine] + np.array(o))
        a, b = mine[there >= 0], there[there >= 0]
        a, b = a[full[b]], b[full[b]]
        # Few points of each often tell already.
        for few in (4, 0):
            open_ = root[a] != root[b]
            a, b = a[open_], b[open_]
            m, n = (np.minimum(size[c], few) if few else size[c] for c in (a, b))
            small = np.flatnonzero(m * n <= STEP)
            hit = np.zeros(len(a), bool)
            for s in portions((m * n)[small], STEP):
                k = small[s]
                pair = np.repeat(k, (m * n)[k])
                place = ranges(np.zeros(len(k), np.int64), (m * n)[k])
                i, j = start[a[pair]] + place // n[pair], start[b[pair]] + place % n[pair]
                hit[pair[square_distances(x[i], x[j]) <= eps * eps]] = True
            root = linked(root, a[hit], b[hit])
            for k in np.flatnonzero(m * n > STEP):
                if root[a[k]] != root[b[k]] and any_within(*(x[start[c[k]] : start[c[k] + 1]] for c in (a, b)), eps):
                    root = linked(root, a[k : k + 1], b[k : k + 1])
    return root


def _boxed(tiles: Tiles, dims: int, eps: float, min_points: int):
    """DBSCAN of one box: of its core points the component, of its border points all components they touch.

    Components are those of the box and the cells next to it, named by their least cell; those of different boxes meet
    in the cells that both hold.
    """
    offsets, reach = _offsets(dims), tiles.halo // 2

    def run(table: pa.Table) -> pa.Table:
        tile = table["tile"][0].as_py()
        cells = Cells(int_matrix(table["cell"]))
        if (cells.rows < FIRST + tiles.halo).any() or (cells.rows > LAST - tiles.halo).any():
            raise OverflowError("values are too far from 0 for cells of this eps")
        order = np.argsort(cells.number, kind="stable")
        own, x, w = cells.number[order], matrix(table["x"])[order], table["w"].to_numpy()[order]
        low, high = tiles.low[tile], tiles.high[tile]
        edge = lambda d: (np.where(low == FIRST, FIRST, low - d), np.where(high == LAST, LAST, high + d))
        inside = lambda d: ((cells.rows >= edge(d)[0]) & (cells.rows <= edge(d)[1])).all(axis=1)
        home, zone, middle = inside(0), inside(reach), inside(-reach)
        full = np.bincount(own, weights=w, minlength=cells.count) >= min_points
        everyone = np.arange(len(x))
        thin = np.flatnonzero(zone[own] & ~full[own])
        seen = np.zeros(len(x))
        for i, j in _close(cells, x, own, thin, everyone, offsets, eps):
            seen += np.bincount(i, weights=w[j], minlength=len(x))
        core = full[own] & zone[own]
        core[thin[seen[thin] >= min_points]] = True
        root = _link_full(np.arange(cells.count), cells, x, own, full & zone, offsets, eps)
        solid = np.flatnonzero(core)
        for i, j in _close(cells, x, own, thin[core[thin]], solid, offsets, eps):
            root = linked(root, own[i], own[j])
        held = np.unique(own[solid])
        names = np.array([",".join(map(str, c)) for c in cells.rows[held].tolist()], object)
        ranked = np.argsort(names.astype(str))
        comp, first = np.unique(root[held][ranked], return_index=True)
        least = names[ranked[first]]
        name = lambda c: least[np.searchsorted(comp, root[c])]
        border = np.flatnonzero(home[own] & ~full[own] & ~core)
        touched = [np.zeros((0, 2), np.int64)]
        for i, j in _close(cells, x, own, border, solid, offsets, eps):
            touched.append(np.unique(np.stack([i, root[own[j]]], axis=1), axis=0))
        touched = np.unique(np.concatenate(touched), axis=0)
        mine, seam = solid[home[own[solid]]], ~middle[held]
        told = np.concatenate([name(own[mine]), name(touched[:, 1]), name(held[seam]), least])
        kinds = np.repeat(np.array([CORE, BORDER, LINK], np.int32), [len(mine), len(touched), int(seam.sum()) + len(least)])
        places = np.concatenate([mine, touched[:, 0]])
        lists = pa.concat_arrays([row_lists(x[places].reshape(len(places), dims)), pa.nulls(len(kinds) - len(places), pa.list_(pa.float64()))])
        meets = [None] * len(places) + [*names[seam], *least]
        return pa.Table.from_arrays([pa.array(kinds), lists, pa.array(told, pa.string()), pa.array(meets, pa.string())], schema=FOUND)

    return run


def _by_boxes(spots: DataFrame, tiles: Tiles, dims: int, eps: float, min_points: int) -> DataFrame:
    """`(x, cluster, core)` of all points but noise, box by box."""
    found = tiles.dealt(spots).groupBy("tile").applyInArrow(_boxed(tiles, dims, eps, min_points), "kind int, x array<double>, label string, cell string")
    found = stored(found)
    seams = found.filter(F.col("kind") == LINK).select("label", "cell").distinct()
    # A cell at a border is held by few boxes: one link from each of its names to the least of them.
    least = seams.groupBy("cell").agg(F.min("label").alias("least"))
    links = stored(seams.join(least, "cell").select(F.col("label").alias("src"), F.col("least").alias("dst")).distinct())
    comp = connected_components(links.select(F.col("src").alias("node")), links.filter("src <> dst"))
    numbers = stored(_numbered(comp).select(F.col("node").alias("label"), "cluster"))
    told = found.filter(F.col("kind") != LINK).select("kind", "x", "label")
    told = skew_join(told, numbers, ["label"]).select("kind", "x", "cluster")
    border = told.filter(F.col("kind") == BORDER).groupBy("x").agg(F.min("cluster").alias("cluster")).withColumn("core", F.lit(False))
    return stored(told.filter(F.col("kind") == CORE).select("x", "cluster", F.lit(True).alias("core")).unionByName(border))


def _by_joins(spots: DataFrame, dims: int, side: float, eps: float, min_points: int) -> DataFrame:
    """The same by joins of cells, for points so dense that no task holds a few cells."""
    weights = durable(spots.groupBy("cell").agg(F.sum("w").alias("cell_w")))
    heavy = weights.filter(F.col("cell_w") >= min_points).select("cell")
    full = durable(skew_join(spots, heavy.withColumn("_full", F.lit(True)), ["cell"]).drop("_full"))
    thin = durable(spots.join(heavy, "cell", "left_anti"))
    offsets = _offsets(dims)
    asking = _around(thin, dims, offsets, "x", F.col("cell").alias("from_cell"))
    # Each cell is asked by at most (offsets x min_points) points of thin cells.
    met = skew_join(spots.select(F.col("cell").alias("near"), F.col("x").alias("y"), "w"), asking, ["near"])
    close = met.filter(_square_distance("x", "y", dims) <= F.lit(eps * eps))
    counts = close.groupBy("x").agg(F.sum("w").alias("seen"))
    thin_core = durable(thin.join(counts, "x").filter(F.col("seen") >= min_points).select("x", "cell"))
    core = durable(full.select("x", "cell").unionByName(thin_core))
    # Links that involve a core point of a thin cell, again a bounded number per cell.
    asking = _around(thin_core, dims, offsets, "x", F.col("cell").alias("from_cell"))
    met = skew_join(core.select(F.col("cell").alias("near"), F.col("x").alias("y")), asking, ["near"])
    thin_links = met.filter(_square_distance("x", "y", dims) <= F.lit(eps * eps)).select(F.col("from_cell").alias("a"), F.col("near").alias("b")).distinct()
    links = thin_links.unionByName(_full_links(full, dims, side, eps))
    name = lambda c: F.concat_ws(",", c)
    nodes = core.select(name(F.col("cell")).alias("node")).distinct()
    edges = links.filter(F.col("a") != F.col("b")).select(name(F.col("a")).alias("src"), name(F.col("b")).alias("dst"))
    comp = connected_components(nodes, edges)
    numbers = _numbered(comp)
    core_label = skew_join(core.withColumn("node", name(F.col("cell"))), numbers, ["node"]).select("x", "cell", "cluster")
    core_label = durable(core_label)
    # Border points: thin, not core, within eps of a core point.
    border = thin.join(thin_core.select("x"), "x", "left_anti")
    asking = _around(border, dims, offsets, "x")
    met = skew_join(core_label.select(F.col("cell").alias("near"), F.col("x").alias("y"), "cluster"), asking, ["near"])
    reached = met.filter(_square_distance("x", "y", dims) <= F.lit(eps * eps)).groupBy("x").agg(F.min("cluster").alias("cluster"))
    return core_label.select("x", "cluster", F.lit(True).alias("core")).unionByName(reached.withColumn("core", F.lit(False)))


def _within(rows: pa.Table, points: pa.Table, eps: float):
    """(visitor, point) places within eps, block of rows by block of rows."""
    x, tx = matrix(rows["x"]), matrix(points["x"])
    for s in in_steps(len(x), len(tx)):
        d = distances(x[s], tx)
        i, j = np.nonzero(d <= eps + slack(np.full(d.shape[1], eps)))
        near = ((x[s][i] - tx[j]) ** 2).sum(axis=1) <= eps * eps
        yield i[near] + s.start, j[near]


def _forest(names: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join each name to the smallest one of its component among the pairs of places (src, dst)."""
    root = np.arange(len(names))
    while True:
        low = root.copy()
        np.minimum.at(low, src, root[dst])
        np.minimum.at(low, dst, root[src])
        low = low[low]
        if (low == root).all():
            break
        root = low
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def _by_tree(df: DataFrame, features: Sequence[str], key: str, eps: float, min_points: int) -> DataFrame:
    rows = stored(points(df, key, features))
    spots = stored(rows.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")).select("id", "x", "w"))
    if spots.isEmpty():
        return df.sparkSession.createDataFrame([], f"`{key}` long, cluster int, core boolean")
    tree = PivotTree.build(spots)
    ball = F.lit(float(eps)).alias("bound")
    counts = pa.schema([("id", pa.int64()), ("seen", pa.int64())])

    def seen(visitors: pa.Table, pts: pa.Table) -> pa.Table:
        if not visitors.num_rows or not pts.num_rows:
            return counts.empty_table()
        w, total = pts["w"].to_numpy(), np.zeros(visitors.num_rows, np.int64)
        for i, j in _within(visitors, pts, eps):
            total += np.bincount(i, weights=w[j], minlength=len(total)).astype(np.int64)
        return pa.Table.from_arrays([visitors["id"], pa.array(total)], schema=counts)

    # Most points of a cluster have enough company in their own block and need not look further.
    home = tree.meet(tree.points.select("id", "x", "cell", "leaf", "part"), seen, "id long, seen long")
    sure = stored(home.filter(F.col("seen") >= min_points).select("id"))

    def summed(found: pa.Table) -> pa.Table:
        ids, at = np.unique(found["id"].to_numpy(), return_inverse=True)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, at, found["seen"].to_numpy())
        return pa.Table.from_arrays([pa.array(ids), pa.array(total)], schema=counts)

    asking = stored(spots.join(sure, "id", "left_anti").select("id", "x", ball))
    more = tree.search(asking, seen, "id long, seen long", summed).groupBy("id").agg(F.sum("seen").alias("seen"))
    core = stored(sure.unionByName(more.filter(F.col("seen") >= min_points).select("id")))
    cores = replace(tree, points=stored(tree.points.join(core, "id")))
    links = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def linked(visitors: pa.Table, pts: pa.Table) -> pa.Table:
        if not visitors.num_rows or not pts.num_rows:
            return links.empty_table()
        mine, theirs = visitors["id"].to_numpy(), pts["id"].to_numpy()
        names = np.union1d(mine, theirs)
        at, to = np.searchsorted(names, mine), np.searchsorted(names, theirs)
        src, dst = names[:0], names[:0]
        for i, j in _within(visitors, pts, eps):
            u, v = _forest(names, np.concatenate([np.searchsorted(names, src), at[i]]), np.concatenate([np.searchsorted(names, dst), to[j]]))
            src, dst = u, v
        return pa.Table.from_arrays([pa.array(src), pa.array(dst)], schema=links)

    def joined(found: pa.Table) -> pa.Table:
        src, dst = found["src"].to_numpy(), found["dst"].to_numpy()
        names = np.union1d(src, dst)
        src, dst = _forest(names, np.searchsorted(names, src), np.searchsorted(names, dst))
        return pa.Table.from_arrays([pa.array(src), pa.array(dst)], schema=links)

    asking = cores.points.select("id", "x", ball)
    edges = cores.search(asking, linked, "src long, dst long", joined).distinct()
    comp = connected_components(core.select(F.col("id").alias("node")), edges)
    label = stored(_numbered(comp).select(F.col("node").alias("id"), "cluster"))
    named = replace(tree, points=stored(cores.points.join(label, "id")))
    reached = pa.schema([("id", pa.int64()), ("cluster", pa.int32())])

    def bordering(visitors: pa.Table, pts: pa.Table) -> pa.Table:
        if not visitors.num_rows or not pts.num_rows:
            return reached.empty_table()
        cluster, best = pts["cluster"].to_numpy(), np.full(visitors.num_rows, np.iinfo(np.int32).max, np.int32)
        for i, j in _within(visitors, pts, eps):
            np.minimum.at(best, i, cluster[j])
        hit = np.flatnonzero(best != np.iinfo(np.int32).max)
        return pa.Table.from_arrays([visitors["id"].combine_chunks().take(pa.array(hit)), pa.array(best[hit])], schema=reached)

    def smallest(found: pa.Table) -> pa.Table:
        ids, at = np.unique(found["id"].to_numpy(), return_inverse=True)
        best = np.full(len(ids), np.iinfo(np.int32).max, np.int32)
        np.minimum.at(best, at, found["cluster"].to_numpy())
        return pa.Table.from_arrays([pa.array(ids), pa.array(best)], schema=reached)

    asking = stored(spots.join(core, "id", "left_anti").select("id", "x", ball))
    border = named.search(asking, bordering, "id long, cluster int", smallest).groupBy("id").agg(F.min("cluster").alias("cluster"))
    labels = label.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False)))
    known = spots.join(labels, "id").select("x", "cluster", "core")
    out = skew_join(rows, known, ["x"], "left")
    return out.select(F.col("id").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("core", F.lit(False)).alias("core"))


def _numbered(components: DataFrame) -> DataFrame:
    """Cluster numbers from 0 in the order of their smallest cell name."""
    from abacist.plans.ordering import with_row_index

    roots = with_row_index(components.select("root").distinct(), ["root"], "cluster")
    return skew_join(components, roots, ["root"]).select("node", F.col("cluster").cast("int").alias("cluster"))
