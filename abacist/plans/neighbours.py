"""Exact k nearest neighbours (Euclidean) without comparing all pairs.

Small reference sides are broadcast after their size is checked.  Beyond that
the reference becomes a tree of pivots (`plans/pivots.py`).  A query first meets
a block of its own leaf, whose k-th distance bounds the search, and then only
the leaves that a ball of that radius can reach.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abacist.plans.pivots import PivotTree, distances, in_steps, matrix, slack
from abacist.plans.quantiles import clean_double, complete_rows
from abacist.plans.session import stored

BROADCAST_POINTS = 20_000
FOUND = "qid long, tid long, distance double"
_FOUND = pa.schema([("qid", pa.int64()), ("tid", pa.int64()), ("distance", pa.float64())])


def points(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """`(id, x)` with x an array of doubles; rows with a missing value are dropped."""
    data = complete_rows(df.select(F.col(key).alias("id"), *[clean_double(c).alias(c) for c in features]))
    return data.select("id", F.array(*features).alias("x"))


def thin_copies(pts: DataFrame, keep: int) -> DataFrame:
    """At most `keep` rows per distinct position, those with the smallest ids.

    A query has no use for more copies of one point than neighbours wanted.
    Copies are thinned first within hash parts, then overall, so one repeated
    position never gathers in one task.
    """
    first = Window.partitionBy("x", "_part").orderBy("id")
    part = F.pmod(F.xxhash64("id"), F.lit(256))
    some = pts.withColumn("_part", part).withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= keep)
    last = Window.partitionBy("x").orderBy("id")
    return some.withColumn("_k", F.row_number().over(last)).filter(F.col("_k") <= keep).drop("_k", "_part")


def _nearest(qid, qx, tid, tx, k: int, exclude_self: bool, bound: np.ndarray | None = None) -> pa.Table:
    """The k nearest of one block for each query, ties by id, none beyond its bound."""
    out = []
    take = min(k + int(exclude_self), len(tx))
    wide = min(take + 4, len(tx))
    for s in in_steps(len(qx), len(tx)):
        q, rows = qx[s], s.stop - s.start
        d = distances(q, tx)
        order = np.argpartition(d, wide - 1, axis=1)[:, :wide]
        kept = np.take_along_axis(d, order, axis=1)
        limit = np.partition(kept, take - 1, axis=1)[:, take - 1]
        # Rounding of the fast distances: whatever may be among the nearest is ordered by exact ones.
        limit = limit + slack(limit)
        if bound is not None:
            limit = np.minimum(limit, bound[s] + slack(bound[s]))
        # Rows of which more than `wide` points are that near (ties) take all of them.
        more = np.flatnonzero((kept <= limit[:, None]).all(axis=1)) if wide < len(tx) else np.zeros(0, np.int64)
        plain = np.ones(rows, bool)
        plain[more] = False
        i, c = np.nonzero((kept <= limit[:, None]) & plain[:, None])
        j = order[i, c]
        extra, far = np.nonzero(d[more] <= limit[more, None])
        i, j = np.concatenate([i, more[extra]]), np.concatenate([j, far])
        exact = np.sqrt(((q[i] - tx[j]) ** 2).sum(axis=1))
        ids = qid[s][i]
        keep = np.ones(len(i), bool) if bound is None else exact <= bound[s][i] + slack(bound[s][i])
        if exclude_self:
            keep &= tid[j] != ids
        i, j, exact, ids = i[keep], j[keep], exact[keep], ids[keep]
        by = np.lexsort((tid[j], exact, i))
        i, j, exact, ids = i[by], j[by], exact[by], ids[by]
        first = np.searchsorted(i, np.arange(rows))
        best = np.arange(len(i)) - first[i] < k
        out.append(pa.Table.from_arrays([pa.array(ids[best]), pa.array(tid[j][best]), pa.array(exact[best])], schema=_FOUND))
    return pa.concat_tables(out) if out else _FOUND.empty_table()


def nearest_neighbours(
    queries: DataFrame, reference: DataFrame, k: int, exclude_self: bool = False, broadcast_points: int = BROADCAST_POINTS
) -> DataFrame:
    """`(qid, tid, distance, rank)`: the k nearest reference points per query.

    Both inputs are `points`; ids are integers.  Copies in the reference are
    thinned to the number that can matter, which cannot change the distances.
    """
    ref = stored(thin_copies(reference, k + int(exclude_self)))
    size = ref.count()
    if size == 0:
        return queries.sparkSession.createDataFrame([], FOUND + ", rank int")
    if size <= broadcast_points:
        rows = ref.orderBy("id").toArrow()  # size checked above
        shared = queries.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(), matrix(rows["x"])))

        def search(batches):
            tid, tx = shared.value
            for batch in batches:
                if batch.num_rows:
                    yield from _nearest(batch.column(0).to_numpy(), matrix(batch.column(1)), tid, tx, k, exclude_self).to_batches()

        found = queries.select("id", "x").mapInArrow(search, FOUND)
    else:
        found = by_tree(queries, PivotTree.build(ref), k, exclude_self)
    best = Window.partitionBy("qid").orderBy("distance", "tid")  # k rows per block met
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search_bounds(queries: DataFrame, tree: PivotTree, k: int, exclude_self: bool) -> DataFrame:
    """(id, x, bound): a distance within which each query has its k nearest, from one block of its own leaf or the cells."""
    need = k + int(exclude_self)
    homes = tree.homes(queries).withColumn("part", F.lit(0))

    def first(rows: pa.Table, points: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.float64())), ("bound", pa.float64())])
        if not rows.num_rows:
            return schema.empty_table()
        x, bound = matrix(rows["x"]), np.full(rows.num_rows, np.inf)
        if points.num_rows >= need:
            tx = matrix(points["x"])
            for s in in_steps(len(x), len(tx)):
                d = np.partition(distances(x[s], tx), need - 1, axis=1)[:, need - 1]
                bound[s] = d + slack(d)
        return pa.Table.from_arrays([rows["id"], rows["x"], pa.array(bound)], schema=schema)

    reach = tree.reach(need)

    def filled(batches):
        for batch in batches:
            if batch.num_rows:
                bound = batch.column(2).to_numpy().copy()
                open_ = np.isinf(bound)
                if open_.any():
                    d = reach(matrix(batch.column(1))[open_])
                    bound[open_] = d + slack(np.where(np.isinf(d), 0, d))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bound)], names=["id", "x", "bound"])

    schema = "id long, x array<double>, bound double"
    return stored(tree.meet(homes, first, schema).mapInArrow(filled, schema))


def by_tree(queries: DataFrame, tree: PivotTree, k: int, exclude_self: bool) -> DataFrame:
    """(qid, tid, distance): of every room that a query's ball reaches, its k nearest within the ball."""

    def work(rows: pa.Table, points: pa.Table) -> pa.Table:
        if not rows.num_rows or not points.num_rows:
            return _FOUND.empty_table()
        return _nearest(rows["id"].to_numpy(), matrix(rows["x"]), points["id"].to_numpy(), matrix(points["x"]), k, exclude_self, rows["bound"].to_numpy())

    def nearest(found: pa.Table) -> pa.Table:
        qid, tid, distance = (found[c].to_numpy() for c in ("qid", "tid", "distance"))
        by = np.lexsort((tid, distance, qid))
        start = np.searchsorted(qid[by], qid[by])
        return found.take(pa.array(by[np.arange(len(by)) - start < k]))

    return tree.search(search_bounds(queries, tree, k, exclude_self), work, FOUND, nearest)
