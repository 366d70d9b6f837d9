"""Data behind charts, aggregated on Spark and ready to draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.functions.columns import columns_of
from abacist.operators.correlation import correlation
from abacist.operators.describe import iqr_bounds
from abacist.operators.frequency import bin_number, histogram, mean_by
from abacist.plans.quantiles import clean_double, exact_quantiles


def histogram_data(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    return histogram(df, column, bins).select("bin", "low", "high", "n")


def scatter_points(df: DataFrame, x: str, y: str, key: str, share: float | None = None) -> DataFrame:
    """All complete points, or a repeatable sample of a stated share of them by a hash of the key."""
    data = df.select(key, x, y).dropna()
    return data if share is None else data.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * share))


def scatter_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """The correlation shown with a scatter plot, over all rows."""
    return correlation(df, [x, y]).filter((F.col("a") == x) & (F.col("b") == y)).select("n", "r")


def box_data(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles, whisker ends (most extreme values within 1.5 IQR) and outlier counts."""
    q = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
    bounds = iqr_bounds(df, columns)
    rows = []
    usable = [c for c in columns if c in bounds]
    one = df.agg(
        *[
            F.struct(
                F.min(F.when(clean_double(c) >= bounds[c][0], clean_double(c))).alias("low"),
                F.max(F.when(clean_double(c) <= bounds[c][1], clean_double(c))).alias("high"),
                F.count_if((clean_double(c) < bounds[c][0]) | (clean_double(c) > bounds[c][1])).alias("out"),
            ).alias(c)
            for c in usable
        ]
    ).first()
    for c in usable:
        rows.append((c, *q[c], one[c]["low"], one[c]["high"], one[c]["out"]))
    return df.sparkSession.createDataFrame(
        rows, "column string, q1 double, median double, q3 double, whisker_low double, whisker_high double, outliers long"
    )


def box_outliers(df: DataFrame, column: str) -> DataFrame:
    lo, hi = iqr_bounds(df, [column])[column]
    v = clean_double(column)
    return df.filter((v < lo) | (v > hi)).select(v.alias("value"))


def bar_data(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean of y by x for text x, the plain pairs otherwise."""
    if x in columns_of(df, "categorical"):
        return mean_by(df, x, y)
    return df.select(x, y)


def line_data(df: DataFrame, x: str, ys: Sequence[str]) -> DataFrame:
    """Series in x order."""
    return df.select(x, *ys).orderBy(x)


def line_averaged(df: DataFrame, x: str, ys: Sequence[str], bins: int) -> DataFrame:
    """Means over equal x intervals, each at its smallest x; empty intervals are left out."""
    data = df.select(x, *ys)
    position = F.unix_micros(F.col(x).cast("timestamp")).cast("double") if x in columns_of(df, "datetime") else F.col(x).cast("double")
    r = data.agg(F.min(position).alias("lo"), F.max(position).alias("hi")).first()
    if r["lo"] == r["hi"]:
        return data.groupBy(x).agg(*[F.avg(y).alias(y) for y in ys])
    part = bin_number(position, r["lo"], r["hi"], bins)
    return data.groupBy(part.alias("part")).agg(F.min(x).alias(x), *[F.avg(y).alias(y) for y in ys]).orderBy("part").drop("part")


def heatmap_data(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    return correlation(df, columns, method).select("a", "b", "r")


def grid_2d(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Counts on an equal grid, the data of a contour or density plot."""
    data = df.select(clean_double(x).alias("x"), clean_double(y).alias("y")).dropna()
    r = data.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")).first()
    if r["a"] is None:
        return data.select(F.lit(0).alias("bx"), F.lit(0).alias("by"), F.lit(0).alias("n")).limit(0)
    spans = []
    for lo, hi in ((r["a"], r["b"]), (r["c"], r["d"])):
        spans.append((lo - 0.5, hi + 0.5) if lo == hi else (lo, hi))
    return data.groupBy(
        bin_number(F.col("x"), *spans[0], bins).alias("bx"), bin_number(F.col("y"), *spans[1], bins).alias("by")
    ).agg(F.count(F.lit(1)).alias("n"))
