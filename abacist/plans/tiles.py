"""Boxes of grid cells that hold about equally many points, and the points around each box.

The boxes are halves of halves: splits come from a bounded number of cells, in
hash order, and only decide which task works on what.  A point goes to the box
that holds its cell and to those whose border is at most `halo` cells away.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a box, on average, and cells that the splits are taken from.
TILE_POINTS = 131_072
PLANNED_CELLS = 65_536
#: Least and greatest cell number: sides without a neighbour.
FIRST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def int_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of whole numbers as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


@dataclass
class Tiles:
    """Splits (dimension, first cell of the upper side, lower, upper) of a tree whose leaves are -1 - box; least and greatest cells of the boxes."""

    splits: list[tuple[int, int, int, int]]
    low: np.ndarray
    high: np.ndarray
    halo: int
    total: int
    #: Points of the fullest box and its surroundings, estimated.
    most: float

    @classmethod
    def plan(cls, spots: DataFrame, dims: int, halo: int, tile_points: int | None = None) -> Tiles:
        """`spots` has x and cell (array of whole numbers)."""
        total = spots.count()
        rows = spots.select("cell", F.xxhash64("x").alias("_h")).orderBy("_h", "cell").limit(PLANNED_CELLS).select("cell").toArrow()
        cells = int_matrix(rows["cell"]).reshape(-1, dims)
        each = max(1.0, total / max(1, len(cells)))
        want = max(1, int((tile_points or TILE_POINTS) / each))
        splits, low, high, near = [], [], [], [0]

        def cut(own, around, lo, hi) -> int:
            if len(own) > want:
                spread = own.max(axis=0) - own.min(axis=0)
                k = int(spread.argmax())
                at = max(int(np.median(own[:, k])), int(own[:, k].min()) + 1)
                if spread[k] >= 4 * halo and (own[:, k] < at).any() and (own[:, k] >= at).any():
                    place = len(splits)
                    splits.append((k, at, 0, 0))
                    under, over = hi.copy(), lo.copy()
                    under[k], over[k] = at - 1, at
                    lower = cut(own[own[:, k] < at], around[around[:, k] < at + halo], lo, under)
                    upper = cut(own[own[:, k] >= at], around[around[:, k] >= at - halo], over, hi)
                    splits[place] = (k, at, lower, upper)
                    return place
            low.append(lo)
            high.append(hi)
            near.append(len(around))
            return -len(low)

        cut(cells, cells, np.full(dims, FIRST), np.full(dims, LAST))
        return cls(splits, np.array(low), np.array(high), halo, total, max(near) * each)

    def dealt(self, spots: DataFrame) -> DataFrame:
        """(tile, x, cell, w): every spot once for each box whose surroundings hold it."""
        splits, halo = self.splits, self.halo

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                cells = int_matrix(batch.column(1))
                tile, taken = [], []
                waiting = [(0 if splits else -1, np.arange(len(cells)))]
                while waiting:
                    node, rows = waiting.pop()
                    if not len(rows):
                        continue
                    if node < 0:
                        tile.append(np.full(len(rows), -1 - node, np.int32))
                        taken.append(rows)
                        continue
                    k, at, lower, upper = splits[node]
                    c = cells[rows, k]
                    waiting += [(lower, rows[c < at + halo]), (upper, rows[c >= at - halo])]
                rows = pa.array(np.concatenate(taken))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tile)), *[batch.column(k).take(rows) for k in range(3)]], names=["tile", "x", "cell", "w"])

        return spots.select("x", "cell", "w").mapInArrow(run, "tile int, x array<double>, cell array<long>, w long")


class Cells:
    """Numbers from 0 for the distinct rows of a table of whole numbers, in their order."""

    def __init__(self, rows: np.ndarray):
        self.axes = [np.unique(c) for c in rows.T]
        self.steps: list[np.ndarray] = []
        self.number = np.searchsorted(self.axes[0], rows[:, 0])
        for k in range(1, rows.shape[1]):
            pair = self.number * len(self.axes[k]) + np.searchsorted(self.axes[k], rows[:, k])
            known, self.number = np.unique(pair, return_inverse=True)
            self.steps.append(known)
        self.count = int(self.number.max()) + 1 if len(rows) else 0
        self.rows = np.zeros((self.count, rows.shape[1]), np.int64)
        self.rows[self.number] = rows

    def find(self, rows: np.ndarray) -> np.ndarray:
        """The numbers of other rows, -1 for those that are not there."""
        out, there = _place(self.axes[0], rows[:, 0])
        for k, known in enumerate(self.steps, 1):
            at, hit = _place(self.axes[k], rows[:, k])
            out, found = _place(known, out * len(self.axes[k]) + at)
            there &= hit & found
        return np.where(there, out, -1)


def _place(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return at, known[at] == values


def linked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place of each component, after those of a and b are joined as well."""
    while True:
        one, two = root[a], root[b]
        apart = one != two
        if not apart.any():
            return root
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows, added up one dimension after the other."""
    total = np.zeros(np.broadcast_shapes(x.shape, y.shape)[:-1])
    for k in range(x.shape[-1]):
        d = x[..., k] - y[..., k]
        total += d * d
    return total


def any_within(x: np.ndarray, y: np.ndarray, eps: float, most: int = 16_384) -> bool:
    """Whether two sets have points within eps: halves of boxes that are close enough, down to few pairs."""
    limit, waiting = eps * eps, [(x, y)]
    while waiting:
        a, b = waiting.pop()
        (al, ah), (bl, bh) = ((t.min(axis=0), t.max(axis=0)) for t in (a, b))
        gap = np.maximum(np.maximum(al - bh, bl - ah), 0)
        if (gap * gap).sum() > limit * (1 + 1e-12):
            continue
        wide = np.maximum(ah - bl, bh - al)
        if (wide * wide).sum() <= limit * (1 - 1e-12):
            return True
        if len(a) * len(b) <= most:
            if (square_distances(a[:, None], b[None]) <= limit).any():
                return True
            continue
        if len(a) < len(b):
            a, b, al, ah = b, a, bl, bh
        k = int((ah - al).argmax())
        order = np.argpartition(a[:, k], len(a) // 2)
        waiting += [(a[order[: len(a) // 2]], b), (a[order[len(a) // 2 :]], b)]
    return False


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of first, first + 1, ... of each range, one after the other."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def portions(count: np.ndarray, most: int):
    """Index ranges whose counts add up to at most `most`; a larger one stands alone."""
    edges, i = np.concatenate([[0], np.cumsum(count)]), 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + most, "right")) - 1)
        yield slice(i, j)
        i = j
