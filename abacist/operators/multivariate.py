"""Principal components, factors, canonical correlation and their pre-checks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.operators.hypothesis import one_row
from abacist.plans.moments import Moments, moments
from abacist.plans.quantiles import clean_double


def oriented(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive."""
    top = np.argmax(np.abs(vectors), axis=0)
    return vectors * np.where(vectors[top, range(vectors.shape[1])] < 0, -1.0, 1.0)


@dataclass
class Projection:
    """Linear scores `(x - mean) / scale @ weights` as Columns."""

    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    values: np.ndarray
    total: float
    source: DataFrame = field(repr=False)
    prefix: str = "pc"

    def summary(self) -> DataFrame:
        """Variance, share and cumulative share per component."""
        share = self.values / self.total
        rows = [
            (f"{self.prefix}{i + 1}", float(v), float(s), float(c))
            for i, (v, s, c) in enumerate(zip(self.values, share, np.cumsum(share)))
        ]
        return self.source.sparkSession.createDataFrame(rows, "component string, variance double, ratio double, cumulative double")

    def loadings(self) -> DataFrame:
        rows = [
            (f"{self.prefix}{j + 1}", c, float(self.weights[i, j]))
            for j in range(self.weights.shape[1])
            for i, c in enumerate(self.columns)
        ]
        return self.source.sparkSession.createDataFrame(rows, "component string, column string, loading double")

    def score_columns(self) -> dict[str, Column]:
        out = {}
        for j in range(self.weights.shape[1]):
            terms = [
                (clean_double(c) - F.lit(float(m))) * F.lit(float(w / s))
                for c, m, s, w in zip(self.columns, self.mean, self.scale, self.weights[:, j])
            ]
            out[f"{self.prefix}{j + 1}"] = sum(terms[1:], terms[0])
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.score_columns())

    def reconstruction_error(self) -> float:
        """Mean squared error per value of the kept components."""
        return float((self.total - self.values.sum()) / len(self.columns))


def _scaling(m: Moments, standardize: bool) -> np.ndarray:
    sd = np.sqrt(np.diag(m.cross) / m.n)
    return np.where(sd > 0, sd, 1.0) if standardize else np.ones(len(m.names))


def pca(df: DataFrame, columns: Sequence[str], n_components: int | None = None, standardize: bool = True) -> Projection:
    """Eigenvectors of the covariance (correlation) matrix from one pass."""
    m = moments(df, columns)
    k = min(n_components or min(len(columns), 5), len(columns))
    scale = _scaling(m, standardize)
    values, vectors = np.linalg.eigh(m.cov / np.outer(scale, scale))
    order = np.argsort(values)[::-1][:k]
    return Projection(list(columns), m.mean, scale, oriented(vectors[:, order]), values[order], float(values.sum()), df)


def truncated_svd(df: DataFrame, columns: Sequence[str], n_components: int = 2) -> Projection:
    """Singular vectors of the uncentred data, from its product matrix."""
    m = moments(df, columns)
    values, vectors = np.linalg.eigh(m.raw)
    order = np.argsort(values)[::-1][:n_components]
    p = len(columns)
    return Projection(list(columns), np.zeros(p), np.ones(p), oriented(vectors[:, order]), values[order], float(values.sum()), df, "svd")


def bartlett_sphericity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    m = moments(df, columns)
    p = len(columns)
    chi = -(m.n - 1 - (2 * p + 5) / 6) * np.linalg.slogdet(m.corr)[1]
    dof = p * (p - 1) // 2
    return one_row(df, {"n": int(m.n), "chi2": float(chi), "df": dof, "p": dist.chi2_sf(chi, dof)})


def kmo(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sampling adequacy per column, and overall in the row `overall`."""
    r = moments(df, columns).corr
    inv = np.linalg.pinv(r)
    part = -inv / np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    r2, p2 = r**2, part**2
    np.fill_diagonal(r2, 0.0)
    np.fill_diagonal(p2, 0.0)
    rows = [(c, float(r2[i].sum() / (r2[i].sum() + p2[i].sum()))) for i, c in enumerate(columns)]
    rows.append(("overall", float(r2.sum() / (r2.sum() + p2.sum()))))
    return df.sparkSession.createDataFrame(rows, "column string, kmo double")


def varimax(loadings: np.ndarray, max_iter: int = 1000, tol: float = 1e-8) -> np.ndarray:
    """Orthogonal rotation with row normalisation."""
    h = np.sqrt((loadings**2).sum(1))
    h = np.where(h > 0, h, 1.0)
    x = loadings / h[:, None]
    p, k = x.shape
    rot, last = np.eye(k), 0.0
    for _ in range(max_iter):
        y = x @ rot
        u, s, vt = np.linalg.svd(x.T @ (y**3 - y * (y**2).sum(0) / p))
        rot = u @ vt
        if s.sum() < last * (1 + tol):
            break
        last = s.sum()
    return (x @ rot) * h[:, None]


@dataclass
class FactorModel:
    columns: list[str]
    loadings_: np.ndarray
    eigenvalues_: np.ndarray
    corr: np.ndarray
    source: DataFrame = field(repr=False)

    def loadings(self) -> DataFrame:
        rows = [
            (f"factor{j + 1}", c, float(self.loadings_[i, j]))
            for j in range(self.loadings_.shape[1])
            for i, c in enumerate(self.columns)
        ]
        return self.source.sparkSession.createDataFrame(rows, "factor string, column string, loading double")

    def communalities(self) -> DataFrame:
        h = (self.loadings_**2).sum(1)
        return self.source.sparkSession.createDataFrame(
            [(c, float(v), float(1 - v)) for c, v in zip(self.columns, h)], "column string, communality double, uniqueness double"
        )

    def variance(self) -> DataFrame:
        ss = (self.loadings_**2).sum(0)
        share = ss / len(self.columns)
        rows = [(f"factor{i + 1}", float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(ss, share, np.cumsum(share)))]
        return self.source.sparkSession.createDataFrame(rows, "factor string, ss_loadings double, ratio double, cumulative double")

    def eigenvalues(self) -> DataFrame:
        return self.source.sparkSession.createDataFrame(
            [(i + 1, float(v)) for i, v in enumerate(self.eigenvalues_)], "number int, eigenvalue double"
        )


def factor_analysis(
    df: DataFrame, columns: Sequence[str], n_factors: int = 3, rotation: str | None = "varimax", max_iter: int = 5000, tol: float = 1e-10
) -> FactorModel:
    """Minimum-residual factors of the correlation matrix, by iterated principal axes."""
    r = moments(df, columns).corr
    k = min(n_factors, len(columns))
    h = 1 - 1 / np.diag(np.linalg.pinv(r))
    load = np.zeros((len(columns), k))
    for _ in range(max_iter):
        reduced = r.copy()
        np.fill_diagonal(reduced, h)
        values, vectors = np.linalg.eigh(reduced)
        top = np.argsort(values)[::-1][:k]
        load = vectors[:, top] * np.sqrt(np.clip(values[top], 0, None))
        new = np.clip((load**2).sum(1), 0.0, 1.0 - 1e-6)
        if np.max(np.abs(new - h)) < tol:
            break
        h = new
    load = oriented(load)
    if rotation == "varimax" and k > 1:
        load = oriented(varimax(load))
    elif rotation not in (None, "varimax"):
        raise ValueError(f"unknown rotation: {rotation}")
    return FactorModel(list(columns), load, np.sort(np.linalg.eigvalsh(r))[::-1], r, df)


def canonical_correlation(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Canonical correlations with Wilks' lambda and Bartlett's chi-square."""
    m = moments(df, [*left, *right])
    p, q = len(left), len(right)
    r = m.corr
    rxx, ryy, rxy = r[:p, :p], r[p:, p:], r[:p, p:]
    prod = np.linalg.pinv(rxx) @ rxy @ np.linalg.pinv(ryy) @ rxy.T
    lam = np.sort(np.clip(np.real(np.linalg.eigvals(prod)), 0, 1))[::-1][: min(p, q)]
    rows = []
    for i in range(len(lam)):
        wilks = float(np.prod(1 - lam[i:]))
        dof = (p - i) * (q - i)
        chi = -(m.n - 1 - (p + q + 1) / 2) * math.log(wilks) if wilks > 0 else math.inf
        rows.append((i + 1, float(math.sqrt(lam[i])), wilks, float(chi), dof, float(dist.chi2_sf(chi, dof))))
    return df.sparkSession.createDataFrame(rows, "number int, correlation double, wilks double, chi2 double, df int, p double")
