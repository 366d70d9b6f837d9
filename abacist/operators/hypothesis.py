"""t tests, variance tests, ANOVA and tests on counts.

Spark reduces the data to group, cell or covariance tables; what is left for
the driver has one entry per level, and the number of levels is checked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacist.functions import dist, tails
from abacist.functions.columns import effect_size_label, eta_label, significance_label
from abacist.operators.frequency import MAX_LEVELS, levels
from abacist.plans.moments import moments
from abacist.plans.quantiles import clean_double, grouped_quantiles
from abacist.plans.session import durable
from abacist.plans.skew import skew_join


def _tail_p(t: Column, df: Column, alternative: str) -> Column:
    if alternative == "two-sided":
        return tails.t_two_sided(t, df)
    if alternative == "greater":
        return tails.t_sf(t, df)
    if alternative == "less":
        return tails.t_sf(-t, df)
    raise ValueError(f"unknown alternative: {alternative}")


def _one_sample(summary: DataFrame, mu: float, alternative: str, level: float, alpha: float) -> DataFrame:
    """Test table from `(n, mean, std)` rows; any grouping columns stay."""
    sem = F.col("std") / F.sqrt("n")
    out = summary.withColumns(
        {
            "t": F.try_divide(F.col("mean") - F.lit(float(mu)), sem),
            "df": (F.col("n") - 1).cast("double"),
            "cohens_d": F.try_divide(F.col("mean") - F.lit(float(mu)), F.col("std")),
            "_half": tails.t_ppf(F.lit(0.5 + level / 2), F.col("n") - 1) * sem,
        }
    )
    out = out.withColumns(
        {
            "p": _tail_p(F.col("t"), F.col("df"), alternative),
            "ci_low": F.col("mean") - F.col("_half"),
            "ci_high": F.col("mean") + F.col("_half"),
            "effect": effect_size_label(F.col("cohens_d")),
        }
    )
    return out.withColumn("decision", significance_label(F.col("p"), alpha)).drop("_half")


def one_sample_t(
    df: DataFrame,
    column: str,
    mu: float = 0.0,
    *,
    alternative: str = "two-sided",
    level: float = 0.95,
    alpha: float = 0.05,
    by: Sequence[str] = (),
) -> DataFrame:
    """One-sample t test, one row per group of `by` (or one row)."""
    v = clean_double(column)
    summary = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    return _one_sample(summary, mu, alternative, level, alpha)


def paired_t(
    df: DataFrame, before: str, after: str, *, alternative: str = "two-sided", level: float = 0.95, alpha: float = 0.05
) -> DataFrame:
    """Paired t test on `after - before` over complete pairs."""
    pairs = df.select(clean_double(before).alias("b"), clean_double(after).alias("a")).dropna()
    delta = F.col("a") - F.col("b")
    summary = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("b").alias("mean_before"),
        F.avg("a").alias("mean_after"),
        F.avg(delta).alias("mean"),
        F.stddev_samp(delta).alias("std"),
    )
    return _one_sample(summary, 0.0, alternative, level, alpha)


@dataclass(frozen=True)
class Group:
    level: object
    n: int
    mean: float
    var: float


def _groups(df: DataFrame, value: str, group: str) -> DataFrame:
    """`(g, n, mean, var)` per level; rows with a missing side are dropped."""
    v = clean_double(value)
    data = df.filter(F.col(group).isNotNull() & v.isNotNull())
    return data.groupBy(F.col(group).alias("g")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("var"))


def f_of_groups(df: DataFrame, value: str, group: str) -> dict[str, float]:
    """One-way sums of squares, F and p for any number of levels: the group table stays in Spark."""
    table = durable(_groups(df, value, group))
    t = table.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand")).first()
    if not t["n"]:
        return {"n": 0, "ss_between": math.nan, "ss_within": math.nan, "df_between": -1, "df_within": 0, "f": math.nan, "p": math.nan}
    gap = F.col("mean") - F.lit(t["grand"])
    s = table.agg(F.sum(F.col("n") * gap * gap).alias("b"), F.sum((F.col("n") - 1) * F.col("var")).alias("w")).first()
    d1, d2 = t["k"] - 1, t["n"] - t["k"]
    f = (s["b"] / d1) / (s["w"] / d2) if d1 > 0 and d2 > 0 and s["w"] > 0 else math.nan
    return {"n": t["n"], "ss_between": s["b"], "ss_within": s["w"], "df_between": d1, "df_within": d2, "f": f, "p": dist.f_sf(f, d1, d2)}


def group_table(df: DataFrame, value: str, group: str, max_levels: int = MAX_LEVELS) -> list[Group]:
    """The table of levels on the driver, in level order, for results that name every level."""
    rows = _groups(df, value, group).limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"{group} has more than {max_levels} levels")
    return [Group(r["g"], r["n"], r["mean"], r["var"] or 0.0) for r in sorted(rows, key=lambda r: r["g"])]


def f_from_groups(groups: Sequence[Group]) -> dict[str, float]:
    """One-way sums of squares, F and p."""
    n = sum(g.n for g in groups)
    grand = sum(g.n * g.mean for g in groups) / n
    ssb = sum(g.n * (g.mean - grand) ** 2 for g in groups)
    ssw = sum((g.n - 1) * g.var for g in groups)
    d1, d2 = len(groups) - 1, n - len(groups)
    f = (ssb / d1) / (ssw / d2) if d1 > 0 and d2 > 0 and ssw > 0 else math.nan
    return {"n": n, "ss_between": ssb, "ss_within": ssw, "df_between": d1, "df_within": d2, "f": f, "p": dist.f_sf(f, d1, d2)}


def _null(v):
    """Plain Python number, NaN as None."""
    v = v.item() if isinstance(v, np.generic) else v
    return None if isinstance(v, float) and math.isnan(v) else v


def one_row(df: DataFrame, values: dict) -> DataFrame:
    """A result row as DataFrame, NaN as NULL."""
    kinds = {bool: "boolean", int: "long", str: "string"}
    plain = {k: v.item() if isinstance(v, np.generic) else v for k, v in values.items()}
    ddl = ", ".join(f"`{k}` {kinds.get(type(v), 'double')}" for k, v in plain.items())
    row = tuple(_null(v) for v in plain.values())
    return df.sparkSession.createDataFrame([row], ddl)


def deviations_from_median(df: DataFrame, value: str, group: str) -> DataFrame:
    """`(group, |value - median of the group|)`."""
    data = df.select(F.col(group), clean_double(value).alias("_x")).dropna()
    medians = grouped_quantiles(data, [group], "_x", (0.5,), ("_med",))
    joined = skew_join(data, medians, [group])
    return joined.select(group, F.abs(F.col("_x") - F.col("_med")).alias("deviation"))


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """Equality of variances, centred on the medians."""
    s = f_of_groups(deviations_from_median(df, value, group), "deviation", group)
    return one_row(df, {"w": s["f"], "df1": s["df_between"], "df2": s["df_within"], "p": s["p"]})


def independent_t(
    df: DataFrame,
    value: str,
    group: str,
    *,
    equal_var: bool | None = None,
    alternative: str = "two-sided",
    level: float = 0.95,
    alpha: float = 0.05,
) -> DataFrame:
    """Two-sample t test; the variance test picks pooled or Welch unless told."""
    groups = group_table(df, value, group, 2)
    if len(groups) != 2:
        raise ValueError(f"{group} must have exactly two levels")
    a, b = groups
    levene_p = None
    if equal_var is None:
        levene_p = levene(df, value, group).first()["p"]
        equal_var = levene_p is None or levene_p > 0.05
    pooled_var = ((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)
    if equal_var:
        se, dof = math.sqrt(pooled_var * (1 / a.n + 1 / b.n)), a.n + b.n - 2.0
    else:
        va, vb = a.var / a.n, b.var / b.n
        se = math.sqrt(va + vb)
        dof = (va + vb) ** 2 / (va**2 / (a.n - 1) + vb**2 / (b.n - 1)) if se > 0 else math.nan
    diff = a.mean - b.mean
    t = diff / se if se > 0 else math.nan
    p = {"two-sided": dist.t_two_sided(t, dof), "greater": dist.t_sf(t, dof), "less": dist.t_sf(-t, dof)}[alternative]
    half = dist.t_ppf(0.5 + level / 2, dof) * se
    d = diff / math.sqrt(pooled_var) if pooled_var > 0 else math.nan
    out = one_row(
        df,
        {
            "group1": str(a.level), "group2": str(b.level), "n1": a.n, "n2": b.n, "mean1": a.mean, "mean2": b.mean,
            "std1": math.sqrt(a.var), "std2": math.sqrt(b.var), "sem1": math.sqrt(a.var / a.n), "sem2": math.sqrt(b.var / b.n),
            "equal_var": bool(equal_var), "levene_p": math.nan if levene_p is None else levene_p,
            "t": t, "df": dof, "p": p, "ci_low": diff - half, "ci_high": diff + half, "cohens_d": d,
        },
    )
    return out.withColumns({"effect": effect_size_label(F.col("cohens_d")), "decision": significance_label(F.col("p"), alpha)})


def independent_t_columns(df: DataFrame, first: str, second: str, **options) -> DataFrame:
    """Two-sample t test between two numeric columns."""
    long = df.select(clean_double(first).alias(first), clean_double(second).alias(second)).unpivot([], [first, second], "group", "value")
    return independent_t(long, "value", "group", **options)


def one_way_anova(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    """F test over the levels of `group`, with eta squared."""
    s = f_of_groups(df, value, group)
    s["groups"] = int(s["df_between"] + 1)
    total = s["ss_between"] + s["ss_within"]
    s["eta_sq"] = s["ss_between"] / total if total > 0 else math.nan
    out = one_row(df, s)
    return out.withColumns({"effect": eta_label(F.col("eta_sq")), "decision": significance_label(F.col("p"), alpha)})


def two_way_anova(df: DataFrame, value: str, a: str, b: str, interaction: bool = True, max_cells: int = 10_000) -> DataFrame:
    """Type II sums of squares from the cell table `(n, mean, var)`.

    Every nested model is a weighted fit to at most `max_cells` cell means.
    """
    v = clean_double(value)
    cells = (
        df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & v.isNotNull())
        .groupBy(F.col(a).alias("a"), F.col(b).alias("b"))
        .agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("s2"))
        .limit(max_cells + 1)
        .collect()
    )
    if len(cells) > max_cells:
        raise ValueError(f"{a} x {b} has more than {max_cells} cells")
    la, lb = sorted({r["a"] for r in cells}), sorted({r["b"] for r in cells})
    n = np.array([r["n"] for r in cells], dtype=float)
    m = np.array([r["m"] for r in cells])
    pure = float(sum((r["n"] - 1) * r["s2"] for r in cells))
    one = np.ones((len(cells), 1))
    da = np.array([[float(r["a"] == x) for x in la[1:]] for r in cells]).reshape(len(cells), -1)
    db = np.array([[float(r["b"] == x) for x in lb[1:]] for r in cells]).reshape(len(cells), -1)

    def rss(*blocks):
        x = np.hstack([one, *blocks])
        w = np.sqrt(n)[:, None]
        beta, *_ = np.linalg.lstsq(x * w, m * w[:, 0], rcond=None)
        return pure + float(np.sum(n * (m - x @ beta) ** 2))

    both, total = rss(da, db), n.sum()
    df_a, df_b = len(la) - 1, len(lb) - 1
    df_ab = len(cells) - 1 - df_a - df_b
    error, df_error = (pure, total - len(cells)) if interaction else (both, total - 1 - df_a - df_b)
    terms = [(a, rss(db) - both, df_a), (b, rss(da) - both, df_b)]
    if interaction:
        terms.append((f"{a}:{b}", both - pure, df_ab))
    rows = []
    for name, ss, dof in terms:
        f = (ss / dof) / (error / df_error) if dof > 0 and error > 0 else math.nan
        rows.append((name, float(ss), float(dof), _null(f), _null(dist.f_sf(f, dof, df_error)), float(ss / (ss + error))))
    rows.append(("Residual", float(error), float(df_error), None, None, None))
    return df.sparkSession.createDataFrame(rows, "term string, ss double, df double, f double, p double, partial_eta_sq double")


def _wide_levels(df: DataFrame, subject: str, within: str, value: str, max_levels: int = 50) -> tuple[DataFrame, list[str]]:
    """One row per subject, one column per level; subjects without every level go."""
    data = df.select(subject, within, clean_double(value).alias("_v")).dropna()
    names = levels(data, within, max_levels)
    wide = data.groupBy(subject).pivot(within, names).agg(F.avg("_v"))
    cols = [f"c{i}" for i in range(len(names))]
    return wide.select(subject, *[F.col(f"`{n}`").alias(c) for n, c in zip(names, cols)]).dropna(), cols


def repeated_measures_anova(df: DataFrame, subject: str, within: str, value: str) -> DataFrame:
    """Within-subject F, sphericity test and Greenhouse-Geisser correction.

    Everything follows from the level means and the level covariance matrix.
    """
    wide, cols = _wide_levels(df, subject, within, value)
    m = moments(wide, cols)
    n, k, s = m.n, len(cols), m.cov
    ss_within = n * float(np.sum((m.mean - m.mean.mean()) ** 2))
    ss_error = (n - 1) * float(np.trace(s) - s.sum() / k)
    d1, d2 = k - 1, (k - 1) * (n - 1)
    f = (ss_within / d1) / (ss_error / d2)
    contrasts = np.linalg.svd(np.eye(k) - 1.0 / k)[0][:, : k - 1]
    v = contrasts.T @ s @ contrasts
    eps = float(np.trace(v) ** 2 / ((k - 1) * np.trace(v @ v)))
    w = float(np.linalg.det(v) / (np.trace(v) / (k - 1)) ** (k - 1))
    chi_df = k * (k - 1) / 2 - 1
    factor = n - 1 - (2 * (k - 1) ** 2 + (k - 1) + 2) / (6 * (k - 1))
    chi = -factor * math.log(w) if w > 0 and chi_df > 0 else math.nan
    return one_row(
        df,
        {
            "subjects": int(n), "levels": k, "ss_within": ss_within, "ss_error": ss_error, "df1": float(d1), "df2": float(d2), "f": f,
            "p": dist.f_sf(f, d1, d2), "eps_gg": eps, "p_gg": dist.f_sf(f, d1 * eps, d2 * eps), "mauchly_w": w,
            "sphericity_chi2": chi, "sphericity_p": dist.chi2_sf(chi, chi_df), "spherical": bool(math.isnan(chi) or dist.chi2_sf(chi, chi_df) > 0.05),
            "partial_eta_sq": ss_within / (ss_within + ss_error),
        },
    )


def _crosstab(df: DataFrame, a: str, b: str, max_levels: int) -> tuple[list, list, np.ndarray]:
    data = df.select(a, b).dropna()
    la, lb = levels(data, a, max_levels), levels(data, b, max_levels)
    table = np.zeros((len(la), len(lb)))
    ia, ib = {v: i for i, v in enumerate(la)}, {v: i for i, v in enumerate(lb)}
    # Not more than levels x levels cells, both checked.
    for r in data.groupBy(a, b).agg(F.count(F.lit(1)).alias("_n")).collect():
        table[ia[r[0]], ib[r[1]]] = r[2]
    return la, lb, table


def chi_square(df: DataFrame, a: str, b: str, *, correction: bool = True, alpha: float = 0.05) -> DataFrame:
    """Independence of two categorical columns, with continuity correction for 2 x 2.

    Works on the cells that occur: the others add their expected counts, which
    are what the occurring cells leave of all rows.
    """
    cells = durable(df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().groupBy("a", "b").agg(F.count(F.lit(1)).alias("o")))
    rows = cells.groupBy("a").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("c"))
    la, lb, n = rows.count(), cols.count(), cells.agg(F.sum("o")).first()[0] or 0
    dof, small = (la - 1) * (lb - 1), min(la, lb) - 1
    if dof == 1 and correction:
        _, _, obs = _crosstab(df, a, b, 2)
        expected = np.outer(obs.sum(1), obs.sum(0)) / n
        gap = np.abs(obs - expected)
        gap = gap - np.minimum(0.5, gap)
        chi = float((gap**2 / expected).sum())
        v = math.sqrt(chi / n)
    elif n:
        e = F.col("r") * F.col("c") / F.lit(float(n))
        met = cells.join(rows, "a").join(cols, "b").agg(F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("x"), F.sum(e).alias("e")).first()
        chi = met["x"] + max(0.0, n - met["e"])
        v = math.sqrt(chi / (n * small)) if small > 0 else math.nan
    else:
        chi = v = math.nan
    out = one_row(df, {"n": int(n), "chi2": chi, "df": dof, "p": dist.chi2_sf(chi, dof), "cramers_v": v})
    return out.withColumn("decision", significance_label(F.col("p"), alpha))


def expected_counts(df: DataFrame, a: str, b: str, max_levels: int = MAX_LEVELS) -> DataFrame:
    la, lb, obs = _crosstab(df, a, b, max_levels)
    exp = np.outer(obs.sum(1), obs.sum(0)) / obs.sum()
    rows = [(str(x), str(y), int(obs[i, j]), float(exp[i, j])) for i, x in enumerate(la) for j, y in enumerate(lb)]
    return df.sparkSession.createDataFrame(rows, f"`{a}` string, `{b}` string, observed long, expected double")


def goodness_of_fit(df: DataFrame, column: str, expected: dict | None = None) -> DataFrame:
    """Counts against expected shares (equal shares by default)."""
    names = levels(df, column)
    counts = {r[0]: r[1] for r in df.filter(F.col(column).isNotNull()).groupBy(column).count().collect()}
    n = sum(counts.values())
    if expected is None:
        shares = {v: 1.0 / len(names) for v in names}
    else:
        total = sum(expected.values())
        shares = {v: s / total for v, s in expected.items()}
        missing = set(names) - set(shares)
        if missing:
            raise ValueError(f"no expected share for {sorted(missing)}")
    chi = sum((counts.get(v, 0) - n * s) ** 2 / (n * s) for v, s in shares.items())
    dof = len(shares) - 1
    return one_row(df, {"n": n, "chi2": float(chi), "df": dof, "p": dist.chi2_sf(chi, dof)})


def fisher_exact(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two-sided exact test of a 2 x 2 table and the odds ratio."""
    la, lb, t = _crosstab(df, a, b, 2)
    if t.shape != (2, 2):
        raise ValueError("Fisher's exact test needs a 2 x 2 table")
    r1, c1, n = t[0].sum(), t[:, 0].sum(), t.sum()
    lo, hi = max(0.0, r1 + c1 - n), min(r1, c1)
    # Probabilities beyond 40 standard deviations of the mode add nothing to a double.
    mean = r1 * c1 / n
    sd = math.sqrt(max(mean * (1 - c1 / n) * (n - r1) / max(n - 1, 1), 1.0))
    k = np.arange(max(lo, math.floor(mean - 40 * sd)), min(hi, math.ceil(mean + 40 * sd)) + 1)
    lg = np.vectorize(math.lgamma)

    def log_choose(x, y):
        return lg(x + 1.0) - lg(y + 1.0) - lg(x - y + 1.0)

    logs = log_choose(np.full_like(k, r1), k) + log_choose(np.full_like(k, n - r1), c1 - k) - log_choose(np.array([n]), np.array([c1]))
    at = t[0, 0]
    p_obs = float(log_choose(np.array([r1]), np.array([at]))[0] + log_choose(np.array([n - r1]), np.array([c1 - at]))[0] - log_choose(np.array([n]), np.array([c1]))[0])
    p = float(np.exp(logs[logs <= p_obs + 1e-7]).sum())
    cross = t[0, 1] * t[1, 0]
    odds = float(t[0, 0] * t[1, 1] / cross) if cross > 0 else math.inf
    return one_row(df, {"odds_ratio": odds, "p": min(1.0, p)})


def mcnemar(df: DataFrame, a: str, b: str, exact: bool | None = None) -> DataFrame:
    """Change between two binary columns."""
    la, lb, t = _crosstab(df, a, b, 2)
    if la != lb or len(la) != 2:
        raise ValueError("McNemar's test needs the same two levels on both sides")
    x, y = int(t[0, 1]), int(t[1, 0])
    exact = x + y < 25 if exact is None else exact
    if exact:
        return one_row(df, {"b": x, "c": y, "statistic": float(min(x, y)), "p": dist.binom_two_sided_half(x, x + y), "exact": True})
    chi = max(abs(x - y) - 1, 0) ** 2 / (x + y) if x + y else 0.0
    return one_row(df, {"b": x, "c": y, "statistic": float(chi), "p": dist.chi2_sf(chi, 1), "exact": False})


def cochran_q(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Equality of success shares over repeated 0/1 columns."""
    data = df.select(*[clean_double(c).alias(c) for c in columns]).dropna()
    row_sum = sum((F.col(c) for c in columns), F.lit(0.0))
    r = data.agg(*[F.sum(c).alias(c) for c in columns], F.sum(row_sum).alias("_t"), F.sum(row_sum * row_sum).alias("_t2"), F.count(F.lit(1)).alias("_n")).first()
    k = len(columns)
    num = (k - 1) * (k * sum(r[c] ** 2 for c in columns) - r["_t"] ** 2)
    den = k * r["_t"] - r["_t2"]
    q = num / den if den else math.nan
    return one_row(df, {"n": r["_n"], "q": q, "df": k - 1, "p": dist.chi2_sf(q, k - 1)})


# ---- comparisons after an ANOVA ----------------------------------------

def adjust_p(p: Sequence[float], method: str) -> list[float]:
    """Bonferroni, Holm or Sidak adjusted p values."""
    m = len(p)
    if method == "bonferroni":
        return [min(1.0, v * m) for v in p]
    if method == "sidak":
        return [1.0 - (1.0 - v) ** m for v in p]
    if method == "holm":
        order = sorted(range(m), key=lambda i: p[i])
        out, worst = [0.0] * m, 0.0
        for step, i in enumerate(order):
            worst = max(worst, min(1.0, (m - step) * p[i]))
            out[i] = worst
        return out
    raise ValueError(f"unknown adjustment: {method}")


def post_hoc(df: DataFrame, value: str, group: str, method: str = "tukey", alpha: float = 0.05, max_levels: int = 200) -> DataFrame:
    """Pairwise comparisons of group means from the group table."""
    groups = group_table(df, value, group, max_levels)
    s = f_from_groups(groups)
    mse, dof, k = s["ss_within"] / s["df_within"], s["df_within"], len(groups)
    pairs = list(combinations(groups, 2))
    rows = []
    if method in ("bonferroni", "holm", "sidak"):
        ts = [(a.mean - b.mean) / math.sqrt(mse * (1 / a.n + 1 / b.n)) for a, b in pairs]
        ps = adjust_p([dist.t_two_sided(t, dof) for t in ts], method)
        stats = list(zip(ts, ps))
    else:
        stats = []
        for a, b in pairs:
            diff, se2 = a.mean - b.mean, mse * (1 / a.n + 1 / b.n)
            if method == "tukey":
                q = abs(diff) / math.sqrt(se2 / 2)
                stats.append((q, dist.studentized_range_sf(q, k, dof)))
            elif method == "scheffe":
                f = diff**2 / se2 / (k - 1)
                stats.append((f, dist.f_sf(f, k - 1, dof)))
            elif method == "games-howell":
                va, vb = a.var / a.n, b.var / b.n
                q = abs(diff) / math.sqrt((va + vb) / 2)
                nu = (va + vb) ** 2 / (va**2 / (a.n - 1) + vb**2 / (b.n - 1))
                stats.append((q, dist.studentized_range_sf(q, k, nu)))
            else:
                raise ValueError(f"unknown post-hoc method: {method}")
    for (a, b), (stat, p) in zip(pairs, stats):
        rows.append((str(a.level), str(b.level), float(a.mean - b.mean), float(stat), float(p), bool(p < alpha)))
    return df.sparkSession.createDataFrame(
        rows, "group1 string, group2 string, mean_diff double, statistic double, p double, reject boolean"
    )
