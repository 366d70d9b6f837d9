"""A two-level tree of pivots over points: which leaves a ball can meet.

A bounded number of top pivots (about the root of the number of leaves) cuts
the points into cells; within a cell every so many points one is a leaf pivot,
so the leaves grow with the data, densest where the points are.  A ball meets
a leaf only if it reaches the ring of distances that the leaf's points have
from their pivot, and the side of the leaf's pivot of the plane between it and
the pivot nearest to the ball's centre.  Cells and leaves are cut by their own
counts of points and of visitors, so no task holds a crowded one.

Cells share a bounded number of rooms.  A search sends a visitor, with its
coordinates, once to each room that its ball reaches, not once to each leaf;
the leaves to compare are picked inside the room's task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.plans.session import stored

#: Points of a leaf, on average; points and visitors of a leaf that meet in one task.
LEAF_POINTS = 1_000
BLOCK_POINTS = 4_000
BLOCK_VISITORS = 20_000
#: Top pivots at most: their coordinates are broadcast.
MAX_TOP = 4_096
#: Rows of one cell that look for their leaves in one task.
CELL_ROWS = 32_768
#: Rooms that small cells are packed into; points and bytes of coordinates of a room, and visitors of it in one task.
ROOMS = 16
ROOM_POINTS = 65_536
ROOM_BYTES = 32 << 20
ROOM_VISITORS = 32_768
#: Bytes of coordinates that one batch of visitors takes; rows of a room's results that are folded at a time.
BATCH_BYTES = 8 << 20
FOLD_ROWS = 250_000
#: Distances held at a time.
STEP = 1_000_000


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of doubles as rows."""
    rows = len(column)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def row_lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(values).ravel(), pa.float64()))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances, from the inner products: a few digits short of exact."""
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.clip(d2, 0, None))


def in_steps(rows: int, width: int):
    step = max(1, STEP // max(width, 1))
    for s in range(0, rows, step):
        yield slice(s, min(rows, s + step))


def slack(d: np.ndarray) -> np.ndarray:
    """Rounding that bounds on distances allow for."""
    return 1e-6 * (1.0 + d)


def meets(d: np.ndarray, near: np.ndarray, far: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Whether balls can hold points of the sets around pivots: ring and half-plane tests."""
    reach = bound[:, None] + slack(d)
    least = d.min(axis=1, keepdims=True)
    return (d - far <= reach) & (near - d <= reach) & (d - least <= 2 * reach)


def nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, away = np.zeros(len(x), np.int64), np.zeros(len(x))
    for s in in_steps(len(x), len(pivots)):
        d = distances(x[s], pivots)
        at[s] = d.argmin(1)
        away[s] = d[np.arange(len(d)), at[s]]
    return at, away


def _split(df: DataFrame, keys: list[str], most: int, parts: str) -> DataFrame:
    """(keys, parts): tasks that the rows of each key need; only keys that need several."""
    return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(parts)).filter(F.col(parts) > 1)


def _together(left: DataFrame, right: DataFrame, keys: list[str], most: int, work: Callable, schema: str) -> DataFrame:
    """cogroup by keys, where `left` is dealt to as many tasks as it needs and `right` (bounded by key) goes to each."""
    parts = stored(_split(left, keys, most, "_tasks"))
    tasks = F.coalesce("_tasks", F.lit(1))
    dealt = left.join(parts, keys, "left").withColumn("_task", F.pmod(F.xxhash64("id", F.lit(5)), tasks).cast("int")).drop("_tasks")
    copied = right.join(parts, keys, "left").withColumn("_task", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("_tasks")
    on = [*keys, "_task"]
    # Both sides may stem from one table: new names for its columns keep them apart.
    dealt, copied = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (dealt, copied))
    return dealt.groupBy(*on).cogroup(copied.groupBy(*on)).applyInArrow(work, schema)


@dataclass
class PivotTree:
    """Points as (id, x, cell, leaf, part) and the leaves as (cell, leaf, p, n, near, far, parts)."""

    points: DataFrame
    leaves: DataFrame
    top: np.ndarray
    sizes: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @classmethod
    def build(cls, points: DataFrame, leaf_points: int = LEAF_POINTS, block_points: int = BLOCK_POINTS) -> PivotTree:
        """`points` has id (integer) and x (array of doubles); further columns are kept."""
        spark = points.sparkSession
        count = points.count()
        # So many points a leaf that a cell's pivots stay few beside its points, at any size.
        leaf_points = max(leaf_points, count // (MAX_TOP * MAX_TOP))
        wanted = min(MAX_TOP, max(1, round((count / leaf_points) ** 0.5)))
        chosen = points.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(wanted).toArrow()
        top = np.unique(matrix(chosen["x"]), axis=0)
        placed = stored(_celled(points, top))
        stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).toPandas()
        sizes, near, far = np.zeros(len(top), np.int64), np.zeros(len(top)), np.full(len(top), -np.inf)
        sizes[stats["cell"]], near[stats["cell"]], far[stats["cell"]] = stats["n"], stats["near"], stats["far"]
        first = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(top)], "cell int, x array<double>")
        pivots = placed.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(leaf_points)) == 0).select("cell", "x").unionByName(first)
        numbered = stored(pivots.groupBy("cell").applyInArrow(_numbered, "cell int, leaf int, p array<double>"))
        found = _leafed(placed, numbered)
        found = stored(found)
        leaves = found.groupBy("cell", "leaf").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("near"), F.max("away").alias("far"))
        leaves = leaves.withColumn("parts", F.ceil(F.col("n") / block_points).cast("int"))
        leaves = stored(numbered.join(leaves, ["cell", "leaf"]))
        # Few rows have leaves of several parts.
        home = found.join(leaves.select("cell", "leaf", "parts"), ["cell", "leaf"])
        home = home.withColumn("part", F.pmod(F.xxhash64("id", F.lit(4)), F.col("parts")).cast("int"))
        points = placed.drop("cell", "away").join(home.select("id", "cell", "leaf", "part"), "id") if len(placed.columns) > 4 else home.select("id", "x", "cell", "leaf", "part")
        return cls(stored(points), leaves, top, sizes, near, far)

    def homes(self, rows: DataFrame) -> DataFrame:
        """(id, x, cell, leaf): the leaf whose pivot is nearest, within the cell whose pivot is nearest."""
        placed = stored(_celled(rows.select("id", "x"), self.top))
        return _leafed(placed, self.leaves.select("cell", "leaf", "p")).select("id", "x", "cell", "leaf")

    def visits(self, rows: DataFrame) -> DataFrame:
        """(id, x, bound, cell, leaf, part): the blocks that may hold points within `bound` of x."""
        cells = stored(rows.select("id", "x", "bound").mapInArrow(self._cells_met(), "id long, x array<double>, bound double, cell int"))
        leaves = self.leaves.select("cell", "leaf", "p", "near", "far", "parts")
        return _together(cells, leaves, ["cell"], CELL_ROWS, _leaves_met, "id long, x array<double>, bound double, cell int, leaf int, part int")

    def meet(self, visits: DataFrame, work: Callable, schema: str) -> DataFrame:
        """work(visitors, points) of every block that is visited; both are Arrow tables."""
        known = [c for c in self.points.columns]
        right = self.points.select(*known)
        return _together(visits, right, ["cell", "leaf", "part"], BLOCK_VISITORS, work, schema)

    def search(self, rows: DataFrame, work: Callable, schema: str, fold: Callable | None = None, ahead: bool = False) -> DataFrame:
        """work(visitors, points) for the leaves that may hold points within `bound` of x; further columns of rows are kept.

        `rows` is read twice.  `fold` shortens a table of results; a room returns what is left of all its leaves.
        With `ahead`, rows are points of the tree with their `cell` and meet no cell before it: of two
        points in different cells only one visits the other.
        """
        first, parts = self._rooms()
        used = np.flatnonzero(self.sizes > 0)
        spark = rows.sparkSession
        # At most MAX_TOP rows.
        rooms = F.broadcast(spark.createDataFrame([(int(c), int(first[c]), int(parts[c])) for c in used], "cell int, first int, parts int"))
        known = [c for c in self.points.columns if c != "part"]
        points = self.points.select(*known).join(rooms, "cell").withColumn("room", (F.col("first") + F.pmod(F.xxhash64("id", F.lit(6)), F.col("parts"))).cast("int"))
        pivots = self.leaves.select("cell", "leaf", F.col("p").alias("x")).join(rooms, "cell").withColumn("room", F.explode(F.expr("sequence(first, first + parts - 1)")))
        pivots = pivots.select("room", *[F.col(c) if c in ("x", "cell", "leaf") else F.lit(None).cast(self.points.schema[c].dataType).alias(c) for c in known])
        right = points.select("room", *known).unionByName(pivots)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        visitors = rows.mapInArrow(self._rooms_met(first, parts, ahead), f"{fields}, room int, cells array<int>")
        most = int(min(ROOM_VISITORS, self._room_points(), max(BLOCK_POINTS, self.sizes.sum() // 4)))
        return _together(visitors, right, ["room"], most, _in_room(work, fold), schema)

    def _room_points(self) -> int:
        return max(LEAF_POINTS, min(ROOM_POINTS, ROOM_BYTES // (8 * max(1, self.top.shape[1]))))

    def _rooms(self) -> tuple[np.ndarray, np.ndarray]:
        """By cell the first of its rooms and how many it has: small cells share one, large ones are cut."""
        limit = self._room_points()
        aim = min(limit, max(BLOCK_POINTS, -(-int(self.sizes.sum()) // ROOMS)))
        middle = self.top - self.top.mean(axis=0)
        axis = np.linalg.eigh(middle.T @ middle)[1][:, -1]
        first, parts = np.zeros(len(self.top), np.int64), np.maximum(1, -(-self.sizes // limit))
        room, held = 0, 0
        for c in np.argsort(middle @ axis, kind="stable"):
            if held and held + self.sizes[c] > aim:
                room, held = room + 1, 0
            first[c] = room
            if parts[c] > 1:
                room, held = room + int(parts[c]), 0
            else:
                held += int(self.sizes[c])
        return first, parts

    def _rooms_met(self, first: np.ndarray, parts: np.ndarray, ahead: bool = False):
        top, sizes, near, far = self.top, self.sizes, self.near, self.far
        used = np.flatnonzero(sizes > 0)
        rooms = int((first + parts).max())
        step = max(1, min(STEP // len(top), BATCH_BYTES // (8 * max(1, top.shape[1]) * min(rooms, len(top)))))

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, bound = matrix(batch.column(batch.schema.get_field_index("x"))), batch.column(batch.schema.get_field_index("bound")).to_numpy()
                for s in range(0, len(x), step):
                    q, c = np.nonzero(meets(distances(x[s : s + step], top), near, far, bound[s : s + step])[:, used])
                    c = used[c]
                    if ahead:
                        own = batch.column(batch.schema.get_field_index("cell")).to_numpy()[s : s + step]
                        q, c = q[c >= own[q]], c[c >= own[q]]
                    times = parts[c]
                    room = np.repeat(first[c], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                    q, c = np.repeat(q, times), np.repeat(c, times)
                    order = np.lexsort((c, room, q))
                    q, c, room = q[order], c[order], room[order]
                    new = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (room[1:] != room[:-1])]) if len(q) else np.zeros(0, np.int64)
                    cells = pa.ListArray.from_arrays(pa.array(np.r_[new, len(q)], pa.int32()), pa.array(c, pa.int32()))
                    taken = pa.array(q[new] + s)
                    yield pa.RecordBatch.from_arrays([*[v.take(taken) for v in batch.columns], pa.array(room[new], pa.int32()), cells], names=[*batch.schema.names, "room", "cells"])

        return run

    def reach(self, need: int):
        """For rows x: a distance within which at least `need` points lie, from the cells alone (infinite if there are fewer)."""
        sizes, far, top = self.sizes, self.far, self.top

        def run(x: np.ndarray) -> np.ndarray:
            out = np.full(len(x), np.inf)
            for s in in_steps(len(x), len(top)):
                d = distances(x[s], top) + np.where(sizes > 0, far, np.inf)
                order = np.argsort(d, axis=1)
                seen = np.cumsum(sizes[order], axis=1)
                at = (seen < need).sum(1)
                inside = at < len(top)
                best = np.take_along_axis(d, order, axis=1)[np.arange(len(d)), np.minimum(at, len(top) - 1)]
                out[s] = np.where(inside, best, np.inf)
            return out

        return run

    def _cells_met(self):
        top, sizes, near, far = self.top, self.sizes, self.near, self.far
        used = np.flatnonzero(sizes > 0)

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, bound = matrix(batch.column(1)), batch.column(2).to_numpy()
                for s in in_steps(len(x), len(top)):
                    d = distances(x[s], top)
                    # The plane test compares with the nearest of all pivots, used or not.
                    hit = meets(d, near, far, bound[s])[:, used]
                    q, c = np.nonzero(hit)
                    rows = pa.array(q + s.start)
                    yield pa.RecordBatch.from_arrays([batch.column(k).take(rows) for k in range(3)] + [pa.array(used[c].astype(np.int32))], names=["id", "x", "bound", "cell"])

        return run


def _celled(points: DataFrame, top: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at, away = nearest_pivot(matrix(batch.column(batch.schema.get_field_index("x"))), top)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(run, f"{schema}, cell int, away double")


def _numbered(table: pa.Table) -> pa.Table:
    pivots = np.unique(matrix(table["x"]), axis=0)
    n = len(pivots)
    return pa.Table.from_arrays([pa.array(np.full(n, table["cell"][0].as_py(), np.int32)), pa.array(np.arange(n, dtype=np.int32)), row_lists(pivots)], names=["cell", "leaf", "p"])


def _in_room(work: Callable, fold: Callable | None) -> Callable:
    """work() for each leaf of a room and the visitors whose balls reach it.  The leaves' pivots come among the points, without an id."""

    def run(rows: pa.Table, pts: pa.Table) -> pa.Table:
        named = pc.is_valid(pts["id"])
        pivots, pts = pts.filter(pc.invert(named)), pts.filter(named)
        if not rows.num_rows or not pts.num_rows:
            return work(rows.slice(0, 0), pts.slice(0, 0))
        pts = pts.take(pa.array(np.lexsort((pts["leaf"].to_numpy(), pts["cell"].to_numpy())))).combine_chunks()
        name = lambda t: t["cell"].to_numpy().astype(np.int64) << 32 | t["leaf"].to_numpy()
        names, starts = np.unique(name(pts), return_index=True)
        ends = np.append(starts[1:], pts.num_rows)
        known = name(pivots)
        order = np.argsort(known)
        p = matrix(pivots["x"])[order[np.searchsorted(known, names, sorter=order)]]
        tx = matrix(pts["x"])
        away = [np.sqrt(((tx[s:e] - c) ** 2).sum(axis=1)) for s, e, c in zip(starts, ends, p)]
        near, far = np.array([a.min() for a in away]), np.array([a.max() for a in away])
        x, bound = matrix(rows["x"]), rows["bound"].to_numpy()
        cells = rows["cells"].combine_chunks()
        met, visitor = cells.flatten().to_numpy(), np.repeat(np.arange(rows.num_rows), cells.value_lengths().to_numpy())
        rows = rows.drop_columns(["cells"]).combine_chunks()
        out, held = [], 0
        for cell in np.unique(names >> 32):
            who, leaves = visitor[met == cell], np.flatnonzero(names >> 32 == cell)
            hit = np.zeros((len(who), len(leaves)), bool)
            for s in in_steps(len(who), len(leaves)):
                hit[s] = meets(distances(x[who[s]], p[leaves]), near[leaves], far[leaves], bound[who[s]])
            for k, leaf in enumerate(leaves):
                some = who[hit[:, k]]
                if len(some):
                    out.append(work(rows.take(pa.array(some)), pts.slice(starts[leaf], ends[leaf] - starts[leaf])))
                    held += out[-1].num_rows
                    if fold and held > FOLD_ROWS:
                        out = [fold(pa.concat_tables(out))]
                        held = 0
        if not out:
            return work(rows.slice(0, 0), pts.slice(0, 0))
        return fold(pa.concat_tables(out)) if fold and len(out) > 1 else pa.concat_tables(out)

    return run


def _nothing(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


_LEAFED = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.float64())), ("cell", pa.int32()), ("leaf", pa.int32()), ("away", pa.float64())])
_VISITS = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.float64())), ("bound", pa.float64()), ("cell", pa.int32()), ("leaf", pa.int32()), ("part", pa.int32())])


def _leafed(placed: DataFrame, pivots: DataFrame) -> DataFrame:
    def work(rows: pa.Table, leaves: pa.Table) -> pa.Table:
        if not rows.num_rows or not leaves.num_rows:
            return _nothing(_LEAFED)
        at, away = nearest_pivot(matrix(rows["x"]), matrix(leaves["p"]))
        leaf = leaves["leaf"].to_numpy()[at].astype(np.int32)
        return pa.Table.from_arrays([rows["id"], rows["x"], rows["cell"], pa.array(leaf), pa.array(away)], schema=_LEAFED)

    return _together(placed.select("id", "x", "cell"), pivots, ["cell"], CELL_ROWS, work, "id long, x array<double>, cell int, leaf int, away double")


def _leaves_met(rows: pa.Table, leaves: pa.Table) -> pa.Table:
    if not rows.num_rows or not leaves.num_rows:
        return _nothing(_VISITS)
    x, bound, pivots = matrix(rows["x"]), rows["bound"].to_numpy(), matrix(leaves["p"])
    near, far, parts = leaves["near"].to_numpy(), leaves["far"].to_numpy(), leaves["parts"].to_numpy()
    leaf, cell = leaves["leaf"].to_numpy(), rows["cell"][0].as_py()
    out = []
    for s in in_steps(len(x), len(pivots)):
        q, c = np.nonzero(meets(distances(x[s], pivots), near, far, bound[s]))
        times = parts[c]
        part = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        q, c = np.repeat(q, times), np.repeat(c, times)
        some = rows.take(pa.array(q + s.start))
        here = pa.array(np.full(len(q), cell, np.int32))
        out.append(pa.Table.from_arrays([some["id"], some["x"], some["bound"], here, pa.array(leaf[c].astype(np.int32)), pa.array(part.astype(np.int32))], schema=_VISITS))
    return pa.concat_tables(out)
