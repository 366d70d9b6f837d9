"""Correlation: Pearson, Spearman, Kendall, partial."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.plans.kendall import kendall_counts
from abacist.plans.moments import moments
from abacist.plans.quantiles import clean_double
from abacist.plans.ranks import average_ranks

PAIRS_PER_JOB = 30


def _pair_sums(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> dict[tuple[str, str], tuple[int, float | None]]:
    """`(n, r)` per pair over its complete rows; NULL r for a constant column."""
    out = {}
    for start in range(0, len(pairs), PAIRS_PER_JOB):
        part = pairs[start : start + PAIRS_PER_JOB]
        aggs = []
        for k, (a, b) in enumerate(part):
            x, y = clean_double(a), clean_double(b)
            both = x.isNotNull() & y.isNotNull()
            x, y = F.when(both, x), F.when(both, y)
            aggs.append(
                F.struct(
                    F.count(x).alias("n"), F.covar_pop(x, y).alias("xy"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy")
                ).alias(f"p{k}")
            )
        row = df.agg(*aggs).first()
        for k, pair in enumerate(part):
            s = row[f"p{k}"]
            spread = (s["xx"] or 0.0) * (s["yy"] or 0.0)
            out[pair] = (s["n"], s["xy"] / math.sqrt(spread) if spread > 0 else None)
    return out


def pair_p_value(r: float | None, n: int) -> float | None:
    if r is None or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    return dist.t_two_sided(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)


def _spearman(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> dict[tuple[str, str], tuple[int, float | None]]:
    """Pearson correlation of average ranks, per pair.

    Without missing values each column is ranked once for all pairs; otherwise
    ranks depend on the pair and are taken over its own complete rows.
    """
    columns = sorted({c for p in pairs for c in p})
    data = df.select(*[clean_double(c).alias(c) for c in columns])
    counts = data.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_n_{c}") for c in columns]).first()
    if all(v == counts["_rows"] for v in counts):
        joined = data
        for c in columns:
            joined = average_ranks(joined, c, None, f"_rank_{c}", source=data)
        ranked = joined.select(*[F.col(f"_rank_{c}").alias(c) for c in columns])
        return _pair_sums(ranked, pairs)
    out = {}
    for a, b in pairs:
        pair = data.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
        ranked = average_ranks(average_ranks(pair, "x", None, "rx"), "y", None, "ry", source=pair)
        out[a, b] = _pair_sums(ranked, [("rx", "ry")])["rx", "ry"]
    return out


def _kendall(df: DataFrame, a: str, b: str) -> tuple[int, float | None, float | None]:
    pair = df.select(clean_double(a).alias("x"), clean_double(b).alias("y")).dropna()
    k = kendall_counts(pair, "x", "y")
    n, n0 = k["n"], k["n"] * (k["n"] - 1) // 2
    d1, d2 = n0 - k["ties_x"], n0 - k["ties_y"]
    if d1 <= 0 or d2 <= 0:
        return n, None, None
    s = k["concordant"] - k["discordant"]
    tau = s / math.sqrt(d1) / math.sqrt(d2)
    # Normal approximation with tie corrections.
    v0 = n * (n - 1) * (2 * n + 5)
    v = (v0 - k["vx"] - k["vy"]) / 18.0
    v += 2.0 * k["ties_x"] * k["ties_y"] / (n * (n - 1)) if n > 1 else 0.0
    if n > 2:
        v += k["tx3"] * k["ty3"] / (9.0 * n * (n - 1) * (n - 2))
    p = dist.norm_two_sided(s / math.sqrt(v)) if v > 0 else None
    return n, tau, p


def correlation(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "pearson",
    *,
    min_periods: int = 1,
    confidence: float = 0.95,
    include_p_values: bool = True,
) -> DataFrame:
    """Long correlation matrix over pairwise complete rows.

    Columns: a, b, n, r, p, ci_low, ci_high; both triangles and the diagonal.
    """
    pairs = list(combinations(columns, 2))
    found: dict[tuple[str, str], tuple] = {}
    if method == "pearson":
        found = {p: (n, r, pair_p_value(r, n)) for p, (n, r) in _pair_sums(df, pairs).items()}
    elif method == "spearman":
        found = {p: (n, r, pair_p_value(r, n)) for p, (n, r) in _spearman(df, pairs).items()}
    elif method == "kendall":
        found = {p: _kendall(df, *p) for p in pairs}
    else:
        raise ValueError(f"unknown correlation method: {method}")
    own = df.agg(*[F.struct(F.count(clean_double(c)).alias("n"), F.var_pop(clean_double(c)).alias("v")).alias(c) for c in columns]).first()
    z = dist.norm_ppf(0.5 + confidence / 2)
    rows = []
    for a in columns:
        for b in columns:
            if a == b:
                rows.append((a, b, own[a]["n"], 1.0 if own[a]["v"] else None, None, None, None))
                continue
            n, r, p = found.get((a, b)) or found[(b, a)]
            if n < min_periods:
                r = None
            lo = hi = None
            if r is not None and n > 3 and abs(r) < 1:
                half = z / math.sqrt(n - 3)
                lo, hi = math.tanh(math.atanh(r) - half), math.tanh(math.atanh(r) + half)
            rows.append((a, b, n, r, p if include_p_values and r is not None else None, lo, hi))
    return df.sparkSession.createDataFrame(
        rows, "a string, b string, n long, r double, p double, ci_low double, ci_high double"
    )


def strong_pairs(matrix: DataFrame, threshold: float = 0.5, order: Sequence[str] | None = None) -> DataFrame:
    """Each pair once with `threshold < |r|`, strongest first."""
    once = matrix.filter(F.col("a") < F.col("b"))
    return once.filter(F.abs("r") > threshold).select("a", "b", "r").orderBy(F.desc(F.abs("r")), "a", "b")


def partial_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of each pair given all other columns."""
    m = moments(df, columns)
    precision = np.linalg.pinv(m.corr)
    scale = np.sqrt(np.diag(precision))
    part = -precision / np.outer(scale, scale)
    k = len(columns) - 2
    rows = []
    for i, j in combinations(range(len(columns)), 2):
        r, dof = float(part[i, j]), m.n - 2 - k
        p = None
        if dof > 0 and abs(r) < 1:
            p = dist.t_two_sided(r * math.sqrt(dof / (1 - r * r)), dof)
        rows.append((columns[i], columns[j], m.n, r, p))
    return df.sparkSession.createDataFrame(rows, "a string, b string, n long, r double, p double")
