"""Embedding near-dedup by a subspace pigeonhole join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.llm.common import mix, small, written
from abacist.plans.components import connected_components

#: Dimensions of a block; pairs are sought in each block with its share of the squared distance.
BLOCK_DIMS = 16
#: Vectors that one cell is meant for, and the most cells of a block.
CELL_ROWS = 8192
MAX_CELLS = 512
#: Vectors from which the cells' pivots are taken, picked by a hash; only the cells' shapes depend on them.
PIVOT_SAMPLE = 4096
SLACK = 1e-6


class Space:
    """A rotation, its blocks, and the cells around pivots in each block."""

    def __init__(self, dims: int, threshold: float, sample: np.ndarray, rows: int):
        self.turn = np.linalg.qr(np.random.default_rng(7).standard_normal((dims, dims)))[0] if dims else np.zeros((0, 0))
        self.blocks = np.array_split(np.arange(dims), max(1, round(dims / BLOCK_DIMS)))
        # |x - y|^2 = 2 - 2 cos for unit vectors; some block has at most its share.
        self.budget = [(2 - 2 * threshold) * len(b) / max(dims, 1) + 1e-9 for b in self.blocks]
        self.threshold = threshold
        cells = int(min(MAX_CELLS, max(1, -(-rows // CELL_ROWS)), max(1, len(sample))))
        turned = self.turned(scaled(sample))
        self.pivots = [turned[np.linspace(0, len(sample) - 1, cells).astype(int)][:, b] if len(sample) else np.zeros((1, len(b))) for b in self.blocks]

    def turned(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
        # Not a BLAS product: a vector's coordinates must not depend on the rows beside it.
        return np.einsum("ij,kj->ik", unit, self.turn)

    def cells(self, x: np.ndarray, block: int):
        """Home cell of each vector, and the later cells that may hold partners (rows, cells)."""
        part, p = x[:, self.blocks[block]], self.pivots[block]
        square = ((part[:, None, :] - p[None]) ** 2).sum(axis=2)
        home = square.argmin(axis=1)
        gap = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
        # A partner in another cell lies beyond the plane half way between the two pivots.
        plane = (square - square[np.arange(len(x)), home][:, None]) / (2 * gap[home] + 1e-12)
        near = (plane <= np.sqrt(self.budget[block]) + SLACK) & (np.arange(len(p))[None] > home[:, None])
        return home, np.nonzero(near)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to 0.5 to 1: squares neither overflow nor vanish, angles stay."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return scaled(values.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def _spread(shared):
    """Copies of vectors for the tiles in which they meet others."""

    def run(batches):
        spaces, splits = shared.value
        for batch in batches:
            ids, weight, vectors = batch.columns
            length = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(length):
                own = np.flatnonzero(length == dims)
                for s in range(0, len(own), 1024):
                    k = own[s : s + 1024]
                    yield from send(spaces[int(dims)], splits, int(dims), ids.take(pa.array(k)), weight.take(pa.array(k)), vectors.take(pa.array(k)))

    def send(space, splits, dims, ids, weight, vectors):
        x = space.turned(_matrix(vectors))
        part = (mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(20)).astype(np.int64)
        rows, names, sides = [], [], []
        for b in range(len(space.blocks)):
            home, (visitor, to) = space.cells(x, b)
            for r, c in enumerate(home.tolist()):
                k, guests = splits.get((dims, b, c), (1, 1))
                i = int(part[r] % k)
                for j in range(k):
                    rows.append(r), names.append(f"{dims}:{b}:{c}:h:{min(i, j)}:{max(i, j)}"), sides.append(int(i > j))
                for j in range(guests if len(space.pivots[b]) > 1 else 0):
                    rows.append(r), names.append(f"{dims}:{b}:{c}:v:{i}:{j}"), sides.append(0)
            for r, c in zip(visitor.tolist(), to.tolist()):
                k, guests = splits.get((dims, b, c), (1, 1))
                j = int(part[r] % guests)
                for i in range(k):
                    rows.append(r), names.append(f"{dims}:{b}:{c}:v:{i}:{j}"), sides.append(1)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sides, pa.int32()), ids.take(at), weight.take(at), vectors.take(at)], names=["tile", "side", "id", "weight", "vector"])

    return run


def _joined(shared):
    """Links of each tile: how many each vector has, and a forest that joins the same vectors."""

    def tile(name, t):
        dims, b, _, kind, i, j = name.split(":")
        space, b = shared.value[0][int(dims)], int(b)
        raw = _matrix(t["vector"].combine_chunks())
        ids, weight, side = (t[c].to_numpy() for c in ("id", "weight", "side"))
        left = np.flatnonzero(side == 0)
        alone = kind == "h" and i == j
        right = left if alone else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return
        x = space.turned(raw)
        part = x[:, space.blocks[b]].astype(np.float32)
        square = (part * part).sum(axis=1)
        norm = np.sqrt((raw * raw).sum(axis=1))
        links = np.zeros(len(ids), np.int64)
        tops = np.arange(len(ids))
        step = max(1, (1 << 22) // len(right))
        for s in range(0, len(left), step):
            a = left[s : s + step]
            gap = square[a][:, None] + square[right][None] - 2 * (part[a] @ part[right].T)
            p, q = np.nonzero(gap <= space.budget[b] + 1e-4)
            p, q = a[p], right[q]
            if alone:
                p, q = p[p < q], q[p < q]
            for z in range(0, len(p), 1 << 18):
                links, tops = settle(space, b, x, raw, norm, p[z : z + (1 << 18)], q[z : z + (1 << 18)], weight, links, tops)
        some = np.flatnonzero(links)
        yield ids[some], ids[tops[some]], links[some]

    def settle(space, b, x, raw, norm, p, q, weight, links, tops):
        cos = np.einsum("ij,ij->i", raw[p], raw[q]) / (norm[p] * norm[q])
        p, q = p[cos >= space.threshold], q[cos >= space.threshold]
        # The first block that has the pair within its budget counts it.
        for k in range(b + 1):
            d = x[p][:, space.blocks[k]] - x[q][:, space.blocks[k]]
            within = np.einsum("ij,ij->i", d, d) <= space.budget[k]
            p, q = (p[within], q[within]) if k == b else (p[~within], q[~within])
        links += np.bincount(p, weight[q], len(links)).astype(np.int64) + np.bincount(q, weight[p], len(links)).astype(np.int64)
        while True:
            low = np.minimum(tops[p], tops[q])
            if (tops[p] == low).all() and (tops[q] == low).all():
                return links, tops
            np.minimum.at(tops, tops[p], low)
            np.minimum.at(tops, tops[q], low)
            np.minimum.at(tops, p, low)
            np.minimum.at(tops, q, low)
            tops = tops[tops]

    def run(batches):
        held, name = [], None
        for batch in batches:
            names = batch.column(0)
            cut = [0] + [k for k in range(1, len(names)) if names[k] != names[k - 1]] + [len(names)] if len(names) else [0]
            for a, z in zip(cut, cut[1:]):
                if held and names[a].as_py() != name:
                    yield from out(name, held)
                    held = []
                name = names[a].as_py()
                held.append(batch.slice(a, z - a))
        if held:
            yield from out(name, held)

    def out(name, held):
        for ids, tops, links in tile(name, pa.Table.from_batches(held)):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tops), pa.array(links)], names=["id", "top", "links"])

    return run


def similar_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector: id, n_links, component_id, kept, for links of cosine >= threshold.

    Unit vectors are rotated and cut in blocks of dimensions.  Of two vectors
    that link, some block keeps its proportional share of the squared distance;
    each block is joined by cells around pivots, where a vector visits those
    cells whose border is near enough, and the candidates' whole vectors decide
    in double precision.  A pair counts in the first block that finds it.
    Identical vectors are one class with a weight; crowded cells are cut in
    tiles, by their own vectors and by their visitors; tiles return counts and a forest, never pairs.

    Null, empty and zero vectors and those with null or non-finite components
    have no links and are their own component; vectors of different length do
    not link.  Ids are integers, unique but for repeated rows, which are linked
    as equal vectors.  Other columns are ignored; an empty table gives an empty
    result.  threshold is above 0 and at most 1.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.coalesce(good, F.lit(False)) & F.exists("vector", lambda x: x != 0) & F.col("id").isNotNull()
    rows = rows.withColumn("vector", F.when(some, F.col("vector")))
    valid = rows.filter("vector IS NOT NULL")
    classes = written(valid.groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")))
    sizes = {r["dims"]: r["rows"] for r in classes.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    total = max(1, sum(sizes.values()))
    picked = classes.filter(F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1_000_000)) < F.lit(1_000_000 * PIVOT_SAMPLE / total)).orderBy("id").limit(2 * PIVOT_SAMPLE).collect()
    spaces = {d: Space(d, threshold, np.array([r["vector"] for r in picked if len(r["vector"]) == d], float).reshape(-1, d), n) for d, n in sizes.items()}

    alone = spark.sparkContext.broadcast((spaces, {}))

    def homes(batches):
        for batch in batches:
            length = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(length):
                space = alone.value[0][int(d)]
                own = batch.column(0).filter(pa.array(length == d))
                for s in range(0, len(own), 1024):
                    x = space.turned(_matrix(own.slice(s, 1024)))
                    for b in range(len(space.blocks)):
                        home, (_, to) = space.cells(x, b)
                        n, guests = (np.bincount(c, minlength=len(space.pivots[b])) for c in (home, to))
                        cell = np.flatnonzero(n + guests)
                        yield pa.RecordBatch.from_arrays([pa.array([int(d)] * len(cell)), pa.array([b] * len(cell)), pa.array(cell), pa.array(n[cell]), pa.array(guests[cell])], names=["d", "b", "c", "n", "guests"])

    # One row for each cell of each block: their number is bounded by MAX_CELLS.
    crowd = classes.select("vector").mapInArrow(homes, "d long, b long, c long, n long, guests long").groupBy("d", "b", "c").agg(F.sum("n").alias("n"), F.sum("guests").alias("guests")).collect()
    splits = {(r["d"], r["b"], r["c"]): tuple(max(1, -(-r[x] // (2 * CELL_ROWS))) for x in ("n", "guests")) for r in crowd}
    shared = spark.sparkContext.broadcast((spaces, splits))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    tiles = classes.select("id", "weight", "vector").mapInArrow(_spread(shared), "tile string, side int, id long, weight long, vector array<double>")
    tiles = tiles.repartition(parts, "tile").sortWithinPartitions("tile")
    found = written(tiles.mapInArrow(_joined(shared), "id long, top long, links long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.filter("id <> top").select(F.col("id").alias("src"), F.col("top").alias("dst"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    roots = connected_components(nodes, edges).withColumnRenamed("node", "id")
    known = written(links.join(roots, "id", "left").select(F.col("id").alias("rep"), "links", F.coalesce("root", "id").alias("root")))

    many = written(classes.filter("weight > 1").select(F.col("vector").alias("v"), F.col("id").alias("rep_"), "weight"))
    out = rows.join(many, F.col("vector") == F.col("v"), "left").select("id", F.coalesce("rep_", "id").alias("rep"), F.coalesce("weight", F.lit(1)).alias("weight"))
    out = out.join(small(known), "rep", "left")
    component = F.coalesce("root", "rep")
    return out.select(
        F.col("id").alias(id_col),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
