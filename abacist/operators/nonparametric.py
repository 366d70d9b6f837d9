"""Rank tests and tests of normality.

All of them work on the table of distinct values with counts, so equal values
collapse before the shuffle and ties are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.functions.columns import norm_cdf, norm_ppf
from abacist.operators.frequency import levels
from abacist.operators.hypothesis import _wide_levels, one_row
from abacist.plans.ordering import with_row_index
from abacist.plans.quantiles import clean_double
from abacist.plans.ranks import value_ranks
from abacist.plans.session import durable



def _tie_sum(c: str):
    w = F.col(c).cast("double")
    return F.sum(w * w * w - w)


def mann_whitney(df: DataFrame, value: str, group: str, continuity: bool = True) -> DataFrame:
    """Two-sample rank test with tie and continuity corrections."""
    data = df.select(F.col(group).alias("g"), clean_double(value).alias("x")).dropna()
    names = levels(data, "g", 2)
    if len(names) != 2:
        raise ValueError(f"{group} must have exactly two levels")
    values = data.groupBy("x").agg(F.count_if(F.col("g") == F.lit(names[0])).alias("n1"), F.count(F.lit(1)).alias("w"))
    r = value_ranks(values, "x", "w").agg(
        F.sum("n1").alias("n1"), F.sum("w").alias("n"), F.sum(F.col("n1") * F.col("avg_rank")).alias("r1"), _tie_sum("w").alias("ties")
    ).first()
    n1, n = r["n1"], r["n"]
    n2 = n - n1
    u1 = r["r1"] - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * (n + 1 - r["ties"] / (n * (n - 1)))
    gap = abs(u1 - n1 * n2 / 2) - (0.5 if continuity else 0.0)
    z = max(gap, 0.0) / math.sqrt(var) if var > 0 else math.nan
    return one_row(df, {"n1": int(n1), "n2": int(n2), "u": float(u1), "z": z, "p": dist.norm_two_sided(z), "rank_biserial": 2 * u1 / (n1 * n2) - 1})


def wilcoxon(df: DataFrame, before: str, after: str) -> DataFrame:
    """Signed-rank test on complete pairs, zero differences dropped."""
    pairs = df.select((clean_double(after) - clean_double(before)).alias("d")).filter(F.col("d").isNotNull() & (F.col("d") != 0))
    values = pairs.groupBy(F.abs("d").alias("x")).agg(F.count_if(F.col("d") > 0).alias("up"), F.count(F.lit(1)).alias("w"))
    r = value_ranks(values, "x", "w").agg(
        F.sum("w").alias("n"),
        F.sum(F.col("up") * F.col("avg_rank")).alias("plus"),
        F.sum((F.col("w") - F.col("up")) * F.col("avg_rank")).alias("minus"),
        _tie_sum("w").alias("ties"),
    ).first()
    n = r["n"] or 0
    if not n:
        return one_row(df, {"n": 0, "w_plus": math.nan, "w_minus": math.nan, "z": math.nan, "p": math.nan})
    var = n * (n + 1) * (2 * n + 1) / 24 - r["ties"] / 48
    z = (min(r["plus"], r["minus"]) - n * (n + 1) / 4) / math.sqrt(var) if var > 0 else math.nan
    return one_row(df, {"n": int(n), "w_plus": float(r["plus"]), "w_minus": float(r["minus"]), "z": z, "p": dist.norm_two_sided(z)})


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """Rank test over any number of groups, corrected for ties; NULL when all values are tied."""
    data = df.select(F.col(group).alias("g"), clean_double(value).alias("x")).dropna()
    cells = durable(data.groupBy("x", "g").agg(F.count(F.lit(1)).alias("n")))
    ranks = durable(value_ranks(cells.groupBy("x").agg(F.sum("n").alias("w")), "x", "w").select("x", "w", "avg_rank"))
    groups = durable(cells.join(ranks, "x").groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("avg_rank")).alias("r")))
    t = ranks.agg(F.sum("w").alias("n"), _tie_sum("w").alias("ties")).first()
    n = t["n"] or 0
    middle = (n + 1) / 2
    gap = F.col("r") / F.col("n") - F.lit(middle)
    s = groups.agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * gap * gap).alias("b")).first()
    k, free = s["k"], n**3 - n - (t["ties"] or 0)
    h = 12 / (n * (n + 1)) * s["b"] * (n**3 - n) / free if n > 1 and free > 0 else math.nan
    p = dist.chi2_sf(h, k - 1) if k > 1 and not math.isnan(h) else math.nan
    return one_row(df, {"n": int(n), "groups": k, "h": h, "df": k - 1, "p": p, "eps_sq": h / (n - 1) if n > 1 else math.nan})


def friedman(df: DataFrame, subject: str, within: str, value: str) -> DataFrame:
    """Rank test over repeated measures; ranks are taken inside each subject's row."""
    wide, cols = _wide_levels(df, subject, within, value)
    k = len(cols)

    def rank(c):
        smaller = sum((F.when(F.col(o) < F.col(c), 1.0).otherwise(0.0) for o in cols if o != c), F.lit(1.0))
        return sum((F.when(F.col(o) == F.col(c), 0.5).otherwise(0.0) for o in cols if o != c), smaller)

    # For a row, the sum of t^3 - t over tie groups equals the sum over values of t^2 - 1.
    cube = sum(
        (F.pow(sum((F.when(F.col(o) == F.col(c), 1.0).otherwise(0.0) for o in cols), F.lit(0.0)), 2) - 1 for c in cols), F.lit(0.0)
    )
    r = wide.agg(*[F.sum(rank(c)).alias(c) for c in cols], F.sum(cube).alias("_t"), F.count(F.lit(1)).alias("_n")).first()
    n = r["_n"]
    free = n * k * (k * k - 1) - (r["_t"] or 0)
    if not n or k < 2 or free <= 0:
        # No subjects, or every subject ties all levels.
        return one_row(df, {"subjects": int(n), "levels": k, "chi2": math.nan, "df": k - 1, "p": math.nan, "kendall_w": math.nan})
    stat = 12 / (n * k * (k + 1)) * sum(r[c] ** 2 for c in cols) - 3 * n * (k + 1)
    stat *= n * k * (k * k - 1) / free
    return one_row(df, {"subjects": int(n), "levels": k, "chi2": stat, "df": k - 1, "p": dist.chi2_sf(stat, k - 1), "kendall_w": stat / (n * (k - 1))})


def _standardised_values(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Distinct values with counts, running totals and z by the sample mean and sd."""
    v = clean_double(column)
    s = df.agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s")).first()
    values = df.filter(v.isNotNull()).groupBy(v.alias("x")).agg(F.count(F.lit(1)).alias("w"))
    spread = s["s"] or None
    z = (F.col("x") - F.lit(s["m"])) / F.lit(spread)
    return value_ranks(values, "x", "w").withColumn("z", z), s["n"]


def ks_normal(df: DataFrame, column: str) -> DataFrame:
    """Kolmogorov distance to the normal law with the sample mean and sd."""
    run, n = _standardised_values(df, column)
    f = norm_cdf(F.col("z"))
    d = run.agg(F.max(F.greatest(F.col("upto") / n - f, f - (F.col("upto") - F.col("w")) / n)).alias("d")).first()["d"] if n else None
    d = math.nan if d is None else d
    return one_row(df, {"n": n, "d": d, "p": dist.kolmogorov_sf(math.sqrt(n) * d)})


def anderson_darling(df: DataFrame, column: str) -> DataFrame:
    """A-squared for normality with estimated parameters, and its p value."""
    run, n = _standardised_values(df, column)
    hi, lo = F.col("upto").cast("double"), (F.col("upto") - F.col("w")).cast("double")
    # Sums of (2i - 1) and (2n + 1 - 2i) over the ranks that share one value.
    low_weight = hi * hi - lo * lo
    high_weight = F.col("w") * (2.0 * n + 1.0) - (hi * (hi + 1) - lo * (lo + 1))
    s = run.agg(F.sum(low_weight * F.ln(norm_cdf(F.col("z"))) + high_weight * F.ln(norm_cdf(-F.col("z")))).alias("s")).first()["s"]
    a2 = -n - s / n if s is not None else math.nan
    star = a2 * (1 + 0.75 / n + 2.25 / n**2)
    # The published p-value fit for estimated mean and variance.
    if star >= 0.6:
        p = math.exp(1.2937 - 5.709 * star + 0.0186 * star**2) if star < 153.467 else 0.0
    elif star >= 0.34:
        p = math.exp(0.9177 - 4.279 * star - 1.38 * star**2)
    elif star >= 0.2:
        p = 1 - math.exp(-8.318 + 42.796 * star - 59.938 * star**2)
    else:
        p = 1 - math.exp(-13.436 + 101.14 * star - 223.73 * star**2)
    return one_row(df, {"n": n, "a2": a2, "p": p})


def jarque_bera(df: DataFrame, column: str) -> DataFrame:
    v = clean_double(column)
    s = df.agg(F.count(v).alias("n"), F.skewness(v).alias("s"), F.kurtosis(v).alias("k")).first()
    if s["s"] is None:
        return one_row(df, {"n": s["n"], "jb": math.nan, "p": math.nan})
    jb = s["n"] / 6 * (s["s"] ** 2 + s["k"] ** 2 / 4)
    return one_row(df, {"n": s["n"], "jb": jb, "p": dist.chi2_sf(jb, 2)})


def shapiro_wilk(df: DataFrame, column: str, key: str | None = None, sample: int | None = None) -> DataFrame:
    """W and p by Royston's 1995 approximation.

    W is over all rows, however many.  The fit behind p was made for up to 5000
    rows and is carried on beyond.  To test a sample, name its size and a key:
    the `sample` rows whose key hashes come first count.
    """
    v = clean_double(column)
    data = df.filter(v.isNotNull())
    if sample is not None:
        data = data.orderBy(F.xxhash64(key), key).limit(sample)
    n = data.count()
    if n < 3:
        return one_row(df, {"n": n, "w": math.nan, "p": math.nan})
    ordered = with_row_index(data.select(v.alias("x")), ["x"], "i").withColumn("i", F.col("i") + 1)
    scored = ordered.withColumn("m", norm_ppf((F.col("i") - 0.375) / (n + 0.25)))
    s = scored.agg(
        F.sum(F.col("m") * F.col("m")).alias("mm"),
        F.sum(F.col("m") * F.col("x")).alias("mx"),
        (F.var_pop("x") * n).alias("ss"),
        F.min_by("x", "i").alias("x1"),
        F.max_by("x", "i").alias("xn"),
        F.max(F.when(F.col("i") == 2, F.col("x"))).alias("x2"),
        F.max(F.when(F.col("i") == n - 1, F.col("x"))).alias("xn1"),
        F.max("m").alias("mn"),
        F.max(F.when(F.col("i") == n - 1, F.col("m"))).alias("mn1"),
    ).first()
    if not s["ss"]:
        return one_row(df, {"n": n, "w": math.nan, "p": math.nan})
    u, root = 1 / math.sqrt(n), math.sqrt(s["mm"])
    # Royston's polynomial corrections of the extreme weights.
    an = s["mn"] / root + sum(c * u**i for i, c in enumerate((0.221157, -0.147981, -2.07119, 4.434685, -2.706056), 1))
    if n == 3:
        an = math.sqrt(0.5)
        num = an * (s["xn"] - s["x1"])
    elif n <= 5:
        phi = (s["mm"] - 2 * s["mn"] ** 2) / (1 - 2 * an**2)
        inner = s["mx"] - s["mn"] * (s["xn"] - s["x1"])
        num = an * (s["xn"] - s["x1"]) + inner / math.sqrt(phi)
    else:
        an1 = s["mn1"] / root + sum(c * u**i for i, c in enumerate((0.042981, -0.293762, -1.752461, 5.682633, -3.582633), 1))
        phi = (s["mm"] - 2 * s["mn"] ** 2 - 2 * s["mn1"] ** 2) / (1 - 2 * an**2 - 2 * an1**2)
        inner = s["mx"] - s["mn"] * (s["xn"] - s["x1"]) - s["mn1"] * (s["xn1"] - s["x2"])
        num = an * (s["xn"] - s["x1"]) + an1 * (s["xn1"] - s["x2"]) + inner / math.sqrt(phi)
    w = min(1.0, num**2 / s["ss"])
    return one_row(df, {"n": n, "w": w, "p": _shapiro_p(w, n)})


def _shapiro_p(w: float, n: int) -> float:
    if w >= 1.0:
        return 1.0
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    # Royston's normalising fits.
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        y = math.log(1 - w)
        if y >= gamma:
            return 0.0
        y = -math.log(gamma - y)
        mu = 0.544 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sd = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        y, x = math.log(1 - w), math.log(n)
        mu = -1.5861 - 0.31082 * x - 0.083751 * x**2 + 0.0038915 * x**3
        sd = math.exp(-0.4803 - 0.082676 * x + 0.0030302 * x**2)
    return dist.norm_sf((y - mu) / sd)


def normality(df: DataFrame, column: str, method: str = "ks") -> DataFrame:
    """The named test over all rows: `ks` (Kolmogorov distance) or `shapiro` (its p is a fit for up to 5000 rows, carried on beyond)."""
    out, stat = {"ks": (ks_normal, "d"), "shapiro": (shapiro_wilk, "w")}[method]
    return out(df, column).select(F.lit(method).alias("test"), "n", F.col(stat).alias("statistic"), "p", (F.col("p") > 0.05).alias("is_normal"))


def qq_points(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Sample quantiles against normal quantiles at evenly spread ranks."""
    from abacist.plans.quantiles import exact_quantiles

    probs = [(i + 0.5) / points for i in range(points)]
    q = exact_quantiles(df, [column], probs)[column]
    return df.sparkSession.createDataFrame(
        [(p, dist.norm_ppf(p), v) for p, v in zip(probs, q)], "p double, theoretical double, sample double"
    )


def check_assumptions(
    df: DataFrame, test: str, *, variable: str | None = None, group: str | None = None, predictors: Sequence[str] = ()
) -> DataFrame:
    """Assumption checks before a test: normality or size, equal variances, collinearity."""
    from abacist.operators.hypothesis import levene
    from abacist.operators.regression import vif

    rows = []
    if test in ("t_test", "anova") and variable:
        s = normality(df, variable).first()
        n = s["n"]
        rows.append(("normality", float(s["statistic"]), s["p"], bool((s["p"] or 0) > 0.05 or n >= 30)))
        rows.append(("sample_size", float(n), None, n >= 30))
    if test in ("t_test", "anova") and variable and group:
        s = levene(df, variable, group).first()
        rows.append(("equal_variances", s["w"], s["p"], s["p"] is None or s["p"] > 0.05))
    if test == "regression" and len(predictors) > 1:
        for r in vif(df, predictors).collect():
            rows.append((f"vif:{r['term']}", r["vif"], None, r["vif"] is not None and r["vif"] < 10))
    return df.sparkSession.createDataFrame(rows, "assumption string, statistic double, p double, met boolean")
