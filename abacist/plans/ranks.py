"""Average ranks with ties, through the ordered table of distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abacist.plans.ordering import with_running_totals
from abacist.plans.skew import HOT_SHARE, SPREAD_ROWS, skew_join

# Up to this many distinct values one sorted task computes the running totals.
SINGLE_TASK_VALUES = 1_000_000


def _few(values: DataFrame) -> bool:
    return values.limit(SINGLE_TASK_VALUES + 1).count() <= SINGLE_TASK_VALUES


def value_ranks(values: DataFrame, value: str, weight: str, few: bool | None = None) -> DataFrame:
    """Distinct values with `weight` copies each -> average rank and `upto` (running total)."""
    if _few(values) if few is None else few:
        w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        run = values.withColumn("upto", F.sum(weight).over(w))
    else:
        run = with_running_totals(values, [value], {"upto": weight})
    return run.withColumn("avg_rank", F.col("upto") - F.col(weight) + (F.col(weight) + 1) / F.lit(2.0))


def average_ranks(
    df: DataFrame, value: str, weight: str | None, name: str, source: DataFrame | None = None
) -> DataFrame:
    """Add the average rank of `value` to each row; rows stand for `weight` copies.

    The rank table has one row per distinct value; adaptive execution
    broadcasts it when it is small, and hot values are salted.  `source` holds
    the same values as `df` with a shorter plan, when `df` was joined before.
    """
    copies = F.sum(weight) if weight else F.count(F.lit(1))
    totals = (df if source is None else source).groupBy(value).agg(copies.alias("_w"), F.count(F.lit(1)).alias("_rows"))
    size = totals.agg(F.count(F.lit(1)).alias("values"), F.sum("_rows").alias("rows")).first()
    hot = []
    if (size["rows"] or 0) >= SPREAD_ROWS:
        # Fewer than 256 values can pass.
        hot = [(r[0],) for r in totals.filter(F.col("_rows") > size["rows"] // HOT_SHARE).select(value).collect()]
    ranks = value_ranks(totals, value, "_w", size["values"] <= SINGLE_TASK_VALUES)
    return skew_join(df, ranks.select(value, F.col("avg_rank").alias(name)), [value], "left", hot=hot)
