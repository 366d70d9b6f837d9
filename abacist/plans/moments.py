"""Means and centred cross products: the one pass behind every linear model."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacist.plans.quantiles import clean_double, complete_rows

# Above this width the products are summed by numpy per Arrow batch instead of
# one generated aggregate per pair of columns.
NARROW = 14


@dataclass(frozen=True)
class Moments:
    """`n` rows, column means and the matrix of centred sums of products."""

    names: tuple[str, ...]
    n: float
    mean: np.ndarray
    cross: np.ndarray

    def at(self, names: Sequence[str]) -> Moments:
        ix = [self.names.index(c) for c in names]
        return Moments(tuple(names), self.n, self.mean[ix], self.cross[np.ix_(ix, ix)])

    @property
    def cov(self) -> np.ndarray:
        return self.cross / (self.n - 1)

    @property
    def corr(self) -> np.ndarray:
        sd = np.sqrt(np.diag(self.cross))
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.cross / np.outer(sd, sd)

    @property
    def raw(self) -> np.ndarray:
        """Uncentred sums of products."""
        return self.cross + self.n * np.outer(self.mean, self.mean)


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles, rows with any missing value dropped."""
    return complete_rows(df.select(*[clean_double(f"`{c}`").alias(c) for c in columns]))


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """List-wise complete moments of `columns`."""
    data = complete(df, columns)
    return _narrow(data, columns) if len(columns) <= NARROW else _wide(data, columns)


def _narrow(data: DataFrame, columns: Sequence[str]) -> Moments:
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = data.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    n = row["n"]
    mean = np.array([row[f"m{i}"] if n else np.nan for i in range(p)], dtype=float)
    cross = np.zeros((p, p))
    for i, j in pairs:
        value = row[f"c{i}_{j}"]
        cross[i, j] = cross[j, i] = n * value if value is not None else np.nan
    return Moments(tuple(columns), n, mean, cross)


def _wide(data: DataFrame, columns: Sequence[str]) -> Moments:
    """Per-partition shifted products, added up by (i, j)."""
    p = len(columns)
    row = data.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    n = row["n"]
    mean = np.array([row[f"m{i}"] if n else np.nan for i in range(p)], dtype=float)
    upper = np.triu_indices(p)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - mean
            total += x.T @ x
        yield pd.DataFrame({"i": upper[0], "j": upper[1], "s": total[upper]})

    sums = data.mapInPandas(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    cross = np.zeros((p, p))
    for r in sums.collect():  # p(p+1)/2 rows
        cross[r["i"], r["j"]] = cross[r["j"], r["i"]] = r["s"]
    return Moments(tuple(columns), n, mean, cross)


def grouped_moments(df: DataFrame, by: str, columns: Sequence[str], max_levels: int = 1000) -> dict:
    """Moments per level of `by`, for a number of levels checked first."""
    data = complete_rows(df.select(F.col(by), *[clean_double(c).alias(c) for c in columns]))
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    rows = (
        data.groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)],
            *[F.covar_pop(columns[i], columns[j]).alias(f"_c{i}_{j}") for i, j in pairs],
        )
        .limit(max_levels + 1)
        .collect()
    )
    if len(rows) > max_levels:
        raise ValueError(f"{by} has more than {max_levels} levels")
    out = {}
    for r in sorted(rows, key=lambda r: r[by]):
        cross = np.zeros((p, p))
        for i, j in pairs:
            cross[i, j] = cross[j, i] = r["_n"] * r[f"_c{i}_{j}"]
        out[r[by]] = Moments(tuple(columns), r["_n"], np.array([r[f"_m{i}"] for i in range(p)]), cross)
    return out


def weighted_sums(df: DataFrame, features: Sequence[Column], target: Column, weight: Column) -> tuple[np.ndarray, np.ndarray]:
    """`(XᵀWX, XᵀWz)` in one aggregate, for iteratively reweighted fits."""
    p = len(features)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = df.agg(
        *[F.sum(weight * features[i] * features[j]).alias(f"a{i}_{j}") for i, j in pairs],
        *[F.sum(weight * features[i] * target).alias(f"b{i}") for i in range(p)],
    ).first()
    a, b = np.zeros((p, p)), np.zeros(p)
    for i, j in pairs:
        a[i, j] = a[j, i] = row[f"a{i}_{j}"]
    for i in range(p):
        b[i] = row[f"b{i}"]
    return a, b
