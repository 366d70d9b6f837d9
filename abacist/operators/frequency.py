"""Frequency tables, histograms, contingency tables, pivots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.operators.describe import _AGGREGATES
from abacist.plans.ordering import with_running_totals
from abacist.plans.quantiles import clean_double

MAX_LEVELS = 1000
SINGLE_TASK_LEVELS = 100_000


def levels(df: DataFrame, column: str, max_levels: int = MAX_LEVELS) -> list:
    """Sorted distinct non-null values, refusing columns with too many."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} levels")
    return sorted(r[0] for r in rows)


def categorical_frequency(df: DataFrame, column: str) -> DataFrame:
    """Counts, shares and cumulative shares in order of falling count."""
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_neg", -F.col("n"))
    )
    sizes = counts.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("levels")).first()
    order = ["_neg", "value"]
    if sizes["levels"] <= SINGLE_TASK_LEVELS:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        run = counts.withColumn("cumulative", F.sum("n").over(w))
    else:
        run = with_running_totals(counts, order, {"cumulative": "n"})
    share = F.lit(100.0) / F.lit(sizes["t"] or 1)
    return run.select(
        "value", "n", (F.col("n") * share).alias("pct"), "cumulative", (F.col("cumulative") * share).alias("cumulative_pct")
    )


def auto_bins(n: int) -> int:
    return max(1, min(50, int(math.sqrt(n))))


def bin_number(c: Column, lo: float, hi: float, k: int) -> Column:
    """0-based equal-width bin, the last bin closed on the right."""
    return F.least(F.width_bucket(c, F.lit(lo), F.lit(hi), F.lit(k)), F.lit(k)).cast("int") - 1


def histogram(df: DataFrame, column: str, bins: int | str = "auto") -> DataFrame:
    """Equal-width bins with counts, relative and cumulative shares; empty bins included."""
    v = clean_double(column)
    r = df.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    n, lo, hi = r["n"], r["lo"], r["hi"]
    spark = df.sparkSession
    if n == 0:
        return spark.createDataFrame(
            [], "bin int, low double, high double, center double, n long, relative double, cumulative long, cumulative_pct double, label string"
        )
    k = auto_bins(n) if bins == "auto" else int(bins)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    counts = df.filter(v.isNotNull()).groupBy(bin_number(v, lo, hi, k).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    step = (hi - lo) / k
    frame = spark.range(k).select(F.col("id").cast("int").alias("bin")).coalesce(1)
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # k rows
    low, high = F.lit(lo) + F.col("bin") * step, F.lit(lo) + (F.col("bin") + 1) * step
    out = frame.join(counts, "bin", "left").select("bin", low.alias("low"), high.alias("high"), F.coalesce("n", F.lit(0)).alias("n"))
    return out.select(
        "bin",
        "low",
        "high",
        ((F.col("low") + F.col("high")) / 2).alias("center"),
        "n",
        (F.col("n") / n).alias("relative"),
        F.sum("n").over(w).alias("cumulative"),
        (F.sum("n").over(w) * (100.0 / n)).alias("cumulative_pct"),
        F.format_string("%.2f-%.2f", "low", "high").alias("label"),
    )


def contingency(df: DataFrame, a: str, b: str, zeros: bool = True, max_levels: int = MAX_LEVELS) -> DataFrame:
    """Long contingency table `(a, b, n)` over complete pairs.

    With `zeros` every pair of levels has a row, so the levels of `b` are
    limited; without, the pairs that occur, for any number of levels.
    """
    pairs = df.select(a, b).dropna()
    if not zeros:
        return pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    cols = levels(pairs, b, max_levels)
    wide = pairs.groupBy(a).pivot(b, cols).agg(F.count(F.lit(1))) if cols else None
    if wide is None:
        return pairs.withColumn("n", F.lit(0).cast("bigint")).limit(0)
    entries = [F.struct(F.lit(v).alias(b), F.coalesce(F.col(f"`{_pivot_name(v)}`"), F.lit(0)).alias("n")) for v in cols]
    return wide.select(a, F.explode(F.array(*entries)).alias("e")).select(a, "e.*")


def _pivot_name(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def pivot_table(
    df: DataFrame,
    index: Sequence[str],
    columns: str,
    values: str,
    aggfunc: str = "mean",
    fill_value: float | None = None,
    margins: bool = False,
    margins_name: str = "All",
    max_levels: int = MAX_LEVELS,
) -> DataFrame:
    """Spreadsheet pivot.  Margins come from the data itself, not from other cells."""
    data = df.dropna(subset=[*index, columns])
    cols = levels(data, columns, max_levels)
    agg = _AGGREGATES[aggfunc]
    if not margins:
        wide = data.groupBy(*index).pivot(columns, cols).agg(agg(values))
    else:
        text = data.select(*[F.col(i).cast("string").alias(i) for i in index], F.col(columns).cast("string").alias(columns), values)
        cube = text.cube(*index, columns).agg(agg(values).alias("_v"), F.grouping_id().alias("_g"))
        full = (1 << (len(index) + 1)) - 1
        keep = cube.filter(F.col("_g").isin(0, 1, full, full - 1))
        named = keep.withColumns({c: F.coalesce(F.col(c), F.lit(margins_name)) for c in [*index, columns]})
        wide = named.groupBy(*index).pivot(columns, [*[str(c) for c in cols], margins_name]).agg(F.max("_v"))
    return wide.fillna(fill_value) if fill_value is not None else wide


def mean_by(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean of `y` for each value of `x`."""
    return df.filter(F.col(x).isNotNull()).groupBy(x).agg(F.avg(y).alias(y))
