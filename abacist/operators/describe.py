"""Univariate statistics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.functions.columns import columns_of, missing, nan_to_null
from abacist.sources.readers import upload_summary
from abacist.plans.distinct import exact_counts
from abacist.plans.quantiles import clean_double, column_spans, exact_quantiles, grouped_quantiles, ranked_summary

#: Share of the rows that a trimmed mean leaves out at each end.
TRIMMED = 0.1
PERCENTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
# Aggregates per job stay well below what one generated class can hold.
COLUMNS_PER_JOB = 12


def skewness(c: Column) -> Column:
    """Bias-corrected G1 from the population skewness."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def kurtosis(c: Column) -> Column:
    """Bias-corrected excess G2 from the population kurtosis."""
    n = F.count(c)
    return F.when(n > 3, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def value_counts(df: DataFrame, columns: Sequence[str], as_type: str = "string") -> DataFrame:
    """`(column, value, n)` over values that are not missing; copies collapse before the shuffle."""
    floats = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("float", "double")}
    return (
        # Adding zero turns -0.0 into 0.0.
        nan_to_null(df, columns)
        .select(*[(F.col(c) + 0.0 if c in floats else F.col(c)).cast(as_type).alias(c) for c in columns])
        .unpivot([], list(columns), "column", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def modes(df: DataFrame, columns: Sequence[str], as_type: str = "double") -> DataFrame:
    """Most frequent value per column, the smallest one on ties."""
    counts = value_counts(df, columns, as_type)
    top = counts.groupBy("column").agg(F.max("n").alias("mode_count"))
    return (
        counts.join(F.broadcast(top), "column")  # one row per column
        .filter(F.col("n") == F.col("mode_count"))
        .groupBy("column")
        .agg(F.min("value").alias("mode"), F.max("mode_count").alias("mode_count"))
    )


def _basic(c: str) -> Column:
    v = clean_double(c)
    positive = F.when(v > 0, v)
    return F.struct(
        F.count(v).alias("count"),
        F.count(F.lit(1)).alias("rows"),
        F.avg(v).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count(positive).alias("positive"),
        F.sum(F.ln(positive)).alias("logs"),
        F.sum(F.lit(1.0) / positive).alias("inverses"),
    ).alias(c)


def _central(c: str, mean: float | None) -> Column:
    """Sums of powers of the deviation from a known mean: plain sums, no cancellation."""
    d = clean_double(c) - F.lit(mean).cast("double")
    d2 = d * d
    return F.struct(
        F.sum(d2).alias("s2"), F.sum(d2 * d).alias("s3"), F.sum(d2 * d2).alias("s4"), F.avg(F.abs(d)).alias("mad")
    ).alias(c)


def _moment_statistics(b, m) -> dict:
    """Statistics of one column from its two aggregate rows."""
    n, mean, s2 = b["count"], b["mean"], m["s2"]
    out = {
        "count": n, "missing": b["rows"] - n, "missing_pct": 100.0 * (b["rows"] - n) / b["rows"] if b["rows"] else None,
        "mean": mean, "min": b["min"], "max": b["max"], "range": b["max"] - b["min"] if n else None, "mad": m["mad"],
        "variance": s2 / (n - 1) if n > 1 else None,
        "geometric_mean": math.exp(b["logs"] / b["positive"]) if b["positive"] else None,
        "harmonic_mean": b["positive"] / b["inverses"] if b["positive"] else None,
    }
    out["std"] = math.sqrt(out["variance"]) if n > 1 else None
    out["sem"] = out["std"] / math.sqrt(n) if n > 1 else None
    out["cv"] = 100.0 * out["std"] / mean if n > 1 and mean else None
    spread = n > 0 and s2 > 0
    g1 = (m["s3"] / n) / (s2 / n) ** 1.5 if spread else None
    g2 = (m["s4"] / n) / (s2 / n) ** 2 - 3.0 if spread else None
    out["skewness"] = g1 * math.sqrt(n * (n - 1)) / (n - 2) if spread and n > 2 else None
    out["kurtosis"] = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if spread and n > 3 else None
    return out


_FIRST = ("mean", "std", "variance", "min", "max", "range")
_ADVANCED = ("sem", "cv", "skewness", "kurtosis", "geometric_mean", "harmonic_mean", "mad")


def _chunks(columns: Sequence[str], size: int = COLUMNS_PER_JOB):
    return [list(columns[i : i + size]) for i in range(0, len(columns), size)]


def trimmed_means(df: DataFrame, columns: Sequence[str], share: float = TRIMMED) -> dict[str, float | None]:
    """Mean without the `int(share * n)` smallest and largest values.

    Only values near the two cut-offs are listed; all between them are summed
    in the pass that finds them.
    """
    spans = column_spans(df, columns)
    return ranked_summary(df, columns, {c: (spans[c]["n"], spans[c]["lo"], spans[c]["hi"]) for c in columns}, (), share).trimmed


def mean_absolute_deviations(df: DataFrame, means: Mapping[str, float | None]) -> dict[str, float | None]:
    known = {c: m for c, m in means.items() if m is not None}
    if not known:
        return dict(means)
    row = df.agg(*[F.avg(F.abs(clean_double(c) - F.lit(m))).alias(c) for c, m in known.items()]).first()
    return {c: row[c] if c in known else None for c in means}


def confidence_interval(mean, sem, n, level: float) -> tuple[float | None, float | None]:
    if mean is None or sem is None or n < 2:
        return None, None
    half = dist.t_ppf(0.5 + level / 2, n - 1) * sem
    return mean - half, mean + half


def describe_numeric(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    include_advanced: bool = True,
    include_mode: bool = True,
    levels: Sequence[float] = (0.95, 0.99),
    percentiles: Sequence[float] = PERCENTILES,
) -> DataFrame:
    """One row per numeric column: location, spread, shape, quantiles, intervals, outliers."""
    columns = list(columns) if columns else columns_of(df, "numeric")
    probs = sorted({0.25, 0.5, 0.75, *percentiles})
    basic, quant, trim = {}, {}, {}
    for part in _chunks(columns):
        first = df.agg(*[_basic(c) for c in part]).first()
        spans = {c: (first[c]["count"], first[c]["min"], first[c]["max"]) for c in part}
        central = [_central(c, first[c]["mean"]) for c in part]
        ranked = ranked_summary(df, part, spans, probs, TRIMMED if include_advanced else None, central)
        basic |= {c: _moment_statistics(first[c], ranked.extra[c]) for c in part}
        quant |= ranked.quantiles
        trim |= ranked.trimmed
    mode = {r["column"]: r["mode"] for r in modes(df, columns).collect()} if include_mode else {}
    bounds = {}
    for c in columns:
        q = dict(zip(probs, quant[c]))
        if q[0.25] is not None:
            iqr = q[0.75] - q[0.25]
            bounds[c] = (q[0.25] - 1.5 * iqr, q[0.75] + 1.5 * iqr)
    outliers = {}
    if include_advanced and bounds:
        outliers = df.agg(
            *[F.count_if((clean_double(c) < lo) | (clean_double(c) > hi)).alias(c) for c, (lo, hi) in bounds.items()]
        ).first().asDict()
    rows, fields = [], None
    for c in columns:
        b, q = basic[c], dict(zip(probs, quant[c]))
        out = {"column": c, "count": b["count"], "missing": b["missing"], "missing_pct": b["missing_pct"]}
        out |= {k: b[k] for k in _FIRST}
        out |= {"median": q[0.5], "q1": q[0.25], "q2": q[0.5], "q3": q[0.75]}
        out["iqr"] = q[0.75] - q[0.25] if q[0.25] is not None else None
        out |= {f"p{round(p * 100, 6):g}": q[p] for p in percentiles}
        if include_mode:
            out["mode"] = mode.get(c)
        if include_advanced:
            out |= {k: b[k] for k in _ADVANCED}
            out["trimmed_mean"] = trim[c]
            for level in levels:
                tag = f"{level * 100:g}".replace(".", "_")
                out[f"ci{tag}_low"], out[f"ci{tag}_high"] = confidence_interval(b["mean"], b["sem"], b["count"], level)
            lo, hi = bounds.get(c, (None, None))
            out |= {"outlier_low": lo, "outlier_high": hi, "outliers": outliers.get(c, 0)}
            out["outlier_pct"] = 100.0 * out["outliers"] / b["count"] if b["count"] else None
        fields = fields or list(out)
        rows.append(tuple(_plain(out[k]) for k in fields))
    types = {"column": "string", "count": "long", "missing": "long", "outliers": "long"}
    ddl = ", ".join(f"`{k}` {types.get(k, 'double')}" for k in fields)
    return df.sparkSession.createDataFrame(rows, ddl)


def _plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def describe_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column, with exact quartiles."""
    full = describe_numeric(df, columns, include_advanced=False, include_mode=False, percentiles=(0.25, 0.5, 0.75))
    return full.select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def iqr_bounds(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> dict[str, tuple[float, float]]:
    out = {}
    for c, (q1, q3) in exact_quantiles(df, columns, (0.25, 0.75)).items():
        if q1 is not None:
            out[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return out


def describe_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: counts, distinct values, mode and entropy (natural log)."""
    totals = {r["column"]: r for r in _missing(df, columns).collect()}
    counts = value_counts(df, columns)
    sizes = counts.groupBy("column").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique"), F.max("n").alias("top"))
    p = F.col("n") / F.col("total")
    joined = counts.join(F.broadcast(sizes), "column")  # one row per column
    stats = joined.groupBy("column").agg(
        F.max("total").alias("count"),
        F.max("unique").alias("unique"),
        F.min(F.when(F.col("n") == F.col("top"), F.col("value"))).alias("mode"),
        F.max("top").alias("mode_freq"),
        (-F.sum(p * F.ln(p))).alias("entropy"),
    )
    by_col = {r["column"]: r for r in stats.collect()}
    rows = []
    for c in columns:
        t, s = totals[c], by_col.get(c)
        rows.append(
            (
                c,
                s["count"] if s else 0,
                t["missing"],
                100.0 * t["missing"] / t["rows"] if t["rows"] else None,
                s["unique"] if s else 0,
                100.0 * s["unique"] / t["rows"] if s else None,
                s["mode"] if s else None,
                s["mode_freq"] if s else 0,
                100.0 * s["mode_freq"] / s["count"] if s else None,
                s["entropy"] + 0.0 if s else None,
            )
        )
    return df.sparkSession.createDataFrame(
        rows,
        "column string, count long, missing long, missing_pct double, unique long, unique_pct double, "
        "mode string, mode_freq long, mode_pct double, entropy double",
    )


def _missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(missing(df, c)).alias(f"_m{i}") for i, c in enumerate(columns)])
    entries = [
        F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"_m{i}").alias("missing"))
        for i, c in enumerate(columns)
    ]
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, missing values and missing share per column."""
    m = _missing(df, columns or df.columns)
    return m.withColumn("missing_pct", F.try_divide(F.col("missing"), F.col("rows")) * 100)


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values with their share; equal counts in value order."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(column).alias("t")).first()["t"]
    share = F.col("n") * (100.0 / total) if total else F.lit(None).cast("double")
    return counts.select(F.col(column).alias("value"), "n", share.alias("pct")).orderBy(F.desc("n"), "value").limit(k)


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-null values and their ratio to the non-null rows, per column."""
    if approx:
        one = nan_to_null(df, columns).agg(*[F.struct(F.approx_count_distinct(c).alias("d"), F.count(c).alias("n")).alias(c) for c in columns])
        entries = [F.struct(F.lit(c).alias("column"), F.col(c)["d"].alias("unique"), F.col(c)["n"].alias("count")) for c in columns]
        out = one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    else:
        # A column without values has no row.
        out = exact_counts(df, columns).filter(F.col("unique") > 0)
    return out.withColumn("unique_ratio", F.try_divide(F.col("unique"), F.col("count")))


def group_summary(df: DataFrame, by: Sequence[str], value: str, quantiles: bool = False) -> DataFrame:
    """Size, mean, std, sem (and quartiles) of `value` per group, null groups dropped."""
    data = df.dropna(subset=list(by))
    v = clean_double(value)
    out = data.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        (F.stddev_samp(v) / F.sqrt(F.when(F.count(v) > 0, F.count(v)))).alias("sem"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    if quantiles:
        out = out.join(grouped_quantiles(data, by, value, (0.25, 0.5, 0.75), ("q1", "median", "q3")), list(by), "left")
    return out


_AGGREGATES = {
    "sum": F.sum,
    "mean": F.avg,
    "avg": F.avg,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "nunique": F.count_distinct,
    "skew": lambda c: skewness(F.col(c)),
    "kurtosis": lambda c: kurtosis(F.col(c)),
}


def aggregate(df: DataFrame, group_by: Sequence[str], aggs: Mapping[str, Sequence[str]], dropna: bool = True) -> DataFrame:
    """`{column: [operations]}` per group; columns come out as `{column}_{operation}`."""
    out = [_AGGREGATES[op](c).alias(f"{c}_{op}") for c, ops in aggs.items() for op in ops]
    return (df.dropna(subset=list(group_by)) if dropna else df).groupBy(*group_by).agg(*out)


def summary_report(df: DataFrame) -> dict[str, DataFrame]:
    """Shape, column types, numeric and categorical summaries of a table."""
    numeric, text = columns_of(df, "numeric"), columns_of(df, "categorical")
    out = {"columns": upload_summary(df)}
    if numeric:
        out["numeric"] = describe_numeric(df, numeric)
    if text:
        out["categorical"] = describe_categorical(df, text)
    return out
