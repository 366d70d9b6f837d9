"""Anomaly detection.  Predictions are -1 for anomalies and 1 otherwise."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.operators.evaluate import classification_metrics
from abacist.plans.moments import moments
from abacist.plans.neighbours import nearest_neighbours, points
from abacist.plans.quantiles import clean_double, complete_rows, exact_quantiles
from abacist.plans.session import durable, stored
from abacist.plans.skew import skew_join


def _cut(scores: DataFrame, share: float) -> float:
    return exact_quantiles(scores, ["score"], (share,))["score"][0]


def _average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    value = 2.0 * (np.log(safe - 1.0) + 0.5772156649015329) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """One isolation tree as nodes `(feature, threshold, left, right, path length at a leaf)`."""
    nodes: list = [None]
    work = [(0, np.arange(len(x)), 0)]
    while work:
        at, rows, depth = work.pop()
        part = x[rows]
        spread = np.flatnonzero(part.max(0) > part.min(0)) if len(rows) > 1 and depth < limit else []
        if not len(spread):
            nodes[at] = (-1, 0.0, -1, -1, depth + float(_average_path(len(rows))))
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        left = part[:, f] <= cut
        a, b = len(nodes), len(nodes) + 1
        nodes += [None, None]
        nodes[at] = (f, cut, a, b, 0.0)
        work += [(a, rows[left], depth + 1), (b, rows[~left], depth + 1)]
    return nodes


def _flat(tree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """A tree as (feature, cut, children by place, path, steps to its deepest leaf); a leaf is its own child."""
    leaf, own = tree[:, 0] < 0, np.arange(len(tree))
    child = np.where(leaf[:, None], own[:, None], tree[:, 2:4]).astype(np.int32)
    depth, at = 0, np.zeros(1, np.int32)
    while not leaf[at].all():
        depth, at = depth + 1, np.unique(child[at])
    return np.where(leaf, 0, tree[:, 0]).astype(np.int32), np.where(leaf, np.inf, tree[:, 1]), child.ravel(), tree[:, 4], depth


def _path_sums(trees: list, x: np.ndarray) -> np.ndarray:
    """Path lengths of each row, summed over the trees."""
    values, first, total = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
    for feature, cut, child, path, depth in trees:
        at = np.zeros(len(x), np.int32)
        for _ in range(depth):
            at = child[2 * at + ~(values[first + feature[at]] <= cut[at])]
        total += path[at]
    return total


class IsolationForest:
    """Trees on small hash samples, built one per group; scoring is one map over the rows."""

    def __init__(self, trees: int = 100, sample: int = 256, contamination: float | None = 0.1, seed: int = 42):
        self.trees, self.sample, self.contamination, self.seed = trees, sample, contamination, seed

    def fit(self, df: DataFrame, features: Sequence[str], key: str) -> IsolationForest:
        self.features = list(features)
        data = complete_rows(df.select(F.col(key).alias("_key"), *[clean_double(c).alias(f"f{i}") for i, c in enumerate(features)]))
        n = data.count()
        span = 1 << 30
        # Enough candidates per tree that the smallest `sample` hashes are among them.
        bound = span if n <= 4 * self.sample else int(span * 4.0 * self.sample / n)
        draw = lambda t: F.pmod(F.xxhash64("_key", t, F.lit(self.seed)), F.lit(span))
        wanted = F.filter(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: draw(t) < bound)
        picked = data.withColumn("tree", F.explode(wanted))
        order = Window.partitionBy("tree").orderBy(draw(F.col("tree")), "_key")
        picked = picked.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= self.sample)
        names, seed, size = [f"f{i}" for i in range(len(features))], self.seed, min(self.sample, n)
        limit = math.ceil(math.log2(max(size, 2)))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            rows = pdf.sort_values("_r")[names].to_numpy(dtype=float)
            nodes = _grow(rows, limit, np.random.default_rng([seed, tree]))
            out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "path"])
            out.insert(0, "node", range(len(out)))
            out.insert(0, "tree", tree)
            return out

        table = picked.groupBy("tree").applyInPandas(build, "tree int, node int, feature int, cut double, left int, right int, path double")
        # At most trees x (2 x sample - 1) rows.
        nodes = table.toPandas().sort_values(["tree", "node"])
        self.forest = [g[["feature", "cut", "left", "right", "path"]].to_numpy() for _, g in nodes.groupby("tree")]
        self.unit = float(_average_path(size))
        self.offset = 0.5
        if self.contamination is not None:
            # The search for the cut reads the scores several times: the trees run once.
            self.offset = _cut(stored(self.scores(df).select("score")), 1.0 - self.contamination)
        return self

    def scores(self, df: DataFrame) -> DataFrame:
        """Rows with an anomaly `score` in (0, 1], larger is more isolated."""
        trees, unit, names = [_flat(t) for t in self.forest], self.unit, self.features
        score = lambda total, n=len(trees): 2.0 ** (-(total / n) / max(unit, 1e-12))
        known, one = trees, len(names) == 1
        if one:
            # All trees of one feature are one step function: a value up to steps[i] scores as steps[i] does.
            steps = np.unique(np.concatenate([cut[cut < np.inf] for _, cut, *_ in trees]))
            known = steps, score(_path_sums(trees, np.append(steps, np.inf)[:, None]))
        shared = df.sparkSession.sparkContext.broadcast(known)
        data = complete_rows(df.withColumns({f"_f{i}": clean_double(c) for i, c in enumerate(names)}), [f"_f{i}" for i in range(len(names))])

        def run(batches):
            known = shared.value
            for columns in batches:
                if one:  # a lone column comes as it is, not in a tuple
                    yield pd.Series(known[1][np.searchsorted(known[0], columns.to_numpy(dtype=float))])
                else:
                    yield pd.Series(score(_path_sums(known, np.column_stack([c.to_numpy(dtype=float) for c in columns]))))

        rows = pd.Series if one else tuple[pd.Series, ...]
        run.__annotations__ = {"batches": Iterator[rows], "return": Iterator[pd.Series]}
        scored = F.pandas_udf(run, "double")
        return data.withColumn("score", scored(*[f"_f{i}" for i in range(len(names))])).drop(*[f"_f{i}" for i in range(len(names))])

    def transform(self, df: DataFrame) -> DataFrame:
        return self.scores(df).withColumn("prediction", F.when(F.col("score") > F.lit(self.offset), -1).otherwise(1))


class LocalOutlierFactor:
    """Density of a row against the density of its neighbours."""

    def __init__(self, neighbours: int = 20, threshold: float = 1.5, broadcast_points: int | None = None):
        self.k, self.threshold = neighbours, threshold
        self.options = {} if broadcast_points is None else {"broadcast_points": broadcast_points}

    def fit(self, df: DataFrame, features: Sequence[str], key: str) -> LocalOutlierFactor:
        self.features, self.key = list(features), key
        self.train = durable(points(df, key, features))
        near = durable(nearest_neighbours(self.train, self.train, self.k, exclude_self=True, **self.options))
        reach = near.groupBy("qid").agg(F.max("distance").alias("k_distance")).withColumnRenamed("qid", "tid")
        self.k_distance = durable(reach)
        self.density = durable(self._local_density(near).withColumnRenamed("qid", "tid"))
        return self

    def _local_density(self, near: DataFrame) -> DataFrame:
        joined = skew_join(near.select("tid", "qid", "distance"), self.k_distance, ["tid"])
        return joined.groupBy("qid").agg((F.lit(1.0) / (F.avg(F.greatest("distance", "k_distance")) + F.lit(1e-10))).alias("density"))

    def scores(self, df: DataFrame, key: str | None = None) -> DataFrame:
        """`(id, score)`: neighbours' mean density over the row's own."""
        near = durable(nearest_neighbours(points(df, key or self.key, self.features), self.train, self.k, **self.options))
        own = self._local_density(near).withColumnRenamed("density", "own")
        theirs = skew_join(near.select("tid", "qid"), self.density, ["tid"]).groupBy("qid").agg(F.avg("density").alias("theirs"))
        return own.join(theirs, "qid").select(F.col("qid").alias("id"), (F.col("theirs") / F.col("own")).alias("score"))

    def transform(self, df: DataFrame, key: str | None = None) -> DataFrame:
        key = key or self.key
        s = self.scores(df, key)
        out = df.join(s.withColumnRenamed("id", "_id"), F.col(key) == F.col("_id")).drop("_id")
        return out.withColumn("prediction", F.when(F.col("score") > self.threshold, -1).otherwise(1))


class EllipticEnvelope:
    """Robust Mahalanobis distance: covariance of the most concentrated rows."""

    def __init__(self, contamination: float = 0.1, support: float | None = None, max_iter: int = 30):
        self.contamination, self.support, self.max_iter = contamination, support, max_iter

    def _distance(self, mean: np.ndarray, precision: np.ndarray) -> Column:
        x = [clean_double(c) - F.lit(float(m)) for c, m in zip(self.features, mean)]
        d = F.lit(0.0)
        for i in range(len(x)):
            for j in range(len(x)):
                d = d + F.lit(float(precision[i, j])) * x[i] * x[j]
        return d

    def fit(self, df: DataFrame, features: Sequence[str]) -> EllipticEnvelope:
        from abacist.functions import dist

        self.features = list(features)
        data = complete_rows(df.select(*[clean_double(c).alias(c) for c in features])).persist()
        try:
            n, p = data.count(), len(features)
            share = self.support or (n + p + 1) / (2.0 * n)
            med = exact_quantiles(data, self.features, (0.5,))
            mean = np.array([med[c][0] for c in features])
            dev = data.select(*[F.abs(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(features, mean)])
            mad = np.array([exact_quantiles(dev, self.features, (0.5,))[c][0] or 1.0 for c in features])
            precision, last = np.diag(1.0 / mad**2), math.inf
            for _ in range(self.max_iter):
                d = data.withColumn("score", self._distance(mean, precision))
                keep = d.filter(F.col("score") <= F.lit(_cut(d, min(share, 1.0))))
                m = moments(keep, self.features)
                cov = m.cross / m.n
                mean, precision = m.mean, np.linalg.pinv(cov, hermitian=True)
                det = float(np.linalg.slogdet(cov)[1])
                if last - det < 1e-9:
                    break
                last = det
            d = data.withColumn("score", self._distance(mean, precision))
            # Scale so that the median distance is that of a normal sample.
            target, lo, hi = 0.5, 0.0, 10.0 * p + 100.0
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if dist.chi2_sf(mid, p) > target else (lo, mid)
            factor = _cut(d, 0.5) / lo
            self.mean, self.precision = mean, precision / factor
            self.offset = _cut(data.withColumn("score", self._distance(self.mean, self.precision)), 1.0 - self.contamination)
        finally:
            data.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("score", self._distance(self.mean, self.precision)).filter(F.col("score").isNotNull())
        return out.withColumn("prediction", F.when(F.col("score") > F.lit(self.offset), -1).otherwise(1))


def anomaly_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == -1).alias("anomalies"), F.avg((F.col("prediction") == -1).cast("double")).alias("ratio")
    )


def anomaly_metrics(scored: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Scores against known labels, where -1 (or a true value) marks an anomaly."""
    data = scored.select(
        (F.col(label).cast("int") == -1).cast("int").alias("label"), (F.col(prediction) == -1).cast("int").alias("prediction")
    )
    return classification_metrics(data, "label", "prediction", average="binary", positive=1)
