"""Dimension reduction beyond principal components: LDA, NMF, ICA."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.operators.multivariate import Projection, oriented
from abacist.plans.moments import complete, grouped_moments, moments
from abacist.plans.quantiles import complete_rows


def discriminant(df: DataFrame, features: Sequence[str], target: str, n_components: int | None = None) -> Projection:
    """Linear discriminants from the per-class products: within against between scatter."""
    by = grouped_moments(df.filter(F.col(target).isNotNull()), target, features)
    n = sum(m.n for m in by.values())
    grand = sum(m.n * m.mean for m in by.values()) / n
    within = sum(m.cross for m in by.values()) / n
    between = sum(m.n * np.outer(m.mean - grand, m.mean - grand) for m in by.values()) / n
    values, basis = np.linalg.eigh(within)
    keep = values > values.max() * 1e-12
    root = basis[:, keep] / np.sqrt(values[keep])
    lam, vec = np.linalg.eigh(root.T @ between @ root)
    k = min(n_components or len(by) - 1, len(by) - 1, len(lam))
    order = np.argsort(lam)[::-1][:k]
    p = len(features)
    return Projection(list(features), grand, np.ones(p), oriented(root @ vec[:, order]), lam[order], float(np.clip(lam, 0, None).sum()), df, "ld")


def _weights(x: np.ndarray, h: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative weights of each row for fixed parts, from a fixed start."""
    top, gram = x @ h.T, h @ h.T
    w = np.full(top.shape, 1.0)
    for _ in range(steps):
        w *= top / np.maximum(w @ gram, 1e-12)
    return w


@dataclass
class Parts:
    """Non-negative parts `h`; row weights are a function of the row and `h`."""

    features: list[str]
    h: np.ndarray
    error: float
    steps: int
    source: DataFrame = field(repr=False)

    def components(self) -> DataFrame:
        rows = [(f"nmf{i + 1}", c, float(self.h[i, j])) for i in range(len(self.h)) for j, c in enumerate(self.features)]
        return self.source.sparkSession.createDataFrame(rows, "component string, column string, weight double")

    def transform(self, df: DataFrame) -> DataFrame:
        h, steps = self.h, self.steps

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(list(_weights(np.vstack(s.to_numpy()), h, steps))) if len(s) else pd.Series([], dtype=object)

        udf = F.pandas_udf(run, "array<double>")
        data = complete_rows(df, self.features).withColumn("_w", udf(F.array(*[F.col(c).cast("double") for c in self.features])))
        return data.withColumns({f"nmf{i + 1}": F.col("_w")[i] for i in range(len(h))}).drop("_w")


def nmf(df: DataFrame, features: Sequence[str], n_components: int = 2, max_iter: int = 50, steps: int = 50, tol: float = 1e-5, seed: int = 42) -> Parts:
    """Multiplicative updates.  Row weights are recomputed inside the pass that needs
    them, so nothing per row is stored and each round is one pass of small sums."""
    data = complete(df, features).persist()
    p, k = len(features), n_components
    try:
        s = data.agg(*[F.min(c).alias(f"n{i}") for i, c in enumerate(features)], *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)]).first()
        if min(s[:p]) < 0:
            raise ValueError("non-negative factorisation needs non-negative values")
        h = np.random.default_rng(seed).uniform(0.5, 1.5, (k, p)) * np.maximum(np.array(s[p:]), 1e-12)
        last = np.inf
        for _ in range(max_iter):

            def sums(batches: Iterator[pd.DataFrame], h=h) -> Iterator[pd.DataFrame]:
                wx, ww, xx = np.zeros((k, p)), np.zeros((k, k)), 0.0
                for pdf in batches:
                    x = pdf.to_numpy(dtype=float)
                    w = _weights(x, h, steps)
                    wx += w.T @ x
                    ww += w.T @ w
                    xx += float((x * x).sum())
                flat = np.concatenate([wx.ravel(), ww.ravel(), [xx]])
                yield pd.DataFrame({"i": np.arange(len(flat)), "s": flat})

            rows = data.mapInPandas(sums, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
            flat = np.array([r["s"] for r in rows])
            wx, ww, xx = flat[: k * p].reshape(k, p), flat[k * p : k * p + k * k].reshape(k, k), flat[-1]
            error = float(xx - 2 * (wx * h).sum() + (ww @ h * h).sum())
            if last - error <= tol * max(xx, 1e-12) * 1e-2:
                break
            last = error
            for _ in range(20):
                h = h * wx / np.maximum(ww @ h, 1e-12)
        return Parts(list(features), h, float(np.sqrt(max(error, 0.0))), steps, df)
    finally:
        data.unpersist()


def ica(df: DataFrame, features: Sequence[str], n_components: int = 2, max_iter: int = 100, tol: float = 1e-4, seed: int = 42) -> Projection:
    """Symmetric fixed-point ICA (log-cosh) on whitened rows; one small sum per round."""
    m = moments(df, features)
    values, vectors = np.linalg.eigh(m.cross / m.n)
    order = np.argsort(values)[::-1][:n_components]
    white = vectors[:, order] / np.sqrt(values[order])
    k = len(order)
    data = complete(df, features).persist()
    mean, n = m.mean, m.n

    def orthogonal(a):
        u, _, vt = np.linalg.svd(a)
        return u @ vt

    w = orthogonal(np.random.default_rng(seed).normal(size=(k, k)))
    try:
        for _ in range(max_iter):

            def sums(batches: Iterator[pd.DataFrame], w=w) -> Iterator[pd.DataFrame]:
                zg, gp = np.zeros((k, k)), np.zeros(k)
                for pdf in batches:
                    z = (pdf.to_numpy(dtype=float) - mean) @ white
                    g = np.tanh(z @ w.T)
                    zg += g.T @ z
                    gp += (1 - g * g).sum(0)
                flat = np.concatenate([zg.ravel(), gp])
                yield pd.DataFrame({"i": np.arange(len(flat)), "s": flat})

            rows = data.mapInPandas(sums, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
            flat = np.array([r["s"] for r in rows]) / n
            new = orthogonal(flat[: k * k].reshape(k, k) - flat[k * k :][:, None] * w)
            gap = float(np.max(np.abs(np.abs((new * w).sum(1)) - 1)))
            w = new
            if gap < tol:
                break
    finally:
        data.unpersist()
    return Projection(list(features), m.mean, np.ones(len(features)), oriented(white @ w.T), np.ones(k), float(k), df, "ic")
