"""Exact counts of concordant and discordant pairs without forming pairs.

Two values of x differ first in one bit of their dense ranks.  For each bit
position, rows that share the higher bits form a group, and every pair in that
group with different bits is ordered in x.  How many of those pairs are also
ordered in y follows from running totals in y order: n log n rows, no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.plans.ordering import with_running_totals
from abacist.plans.ranks import SINGLE_TASK_VALUES
from abacist.plans.session import durable
from abacist.plans.skew import skew_join


def _wide(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def _ties(cells: DataFrame, column: str) -> dict[str, int]:
    t = _wide("t")
    row = (
        cells.groupBy(column)
        .agg(F.sum("w").alias("t"))
        .agg(
            F.sum(t * (t - 1)).alias("t2"),
            F.sum(t * (t - 1) * (t - 2)).alias("t3"),
            F.sum(t * (t - 1) * (2 * t + 5)).alias("v"),
            F.count(F.lit(1)).alias("values"),
        )
        .first()
    )
    return {k: int(row[k] or 0) for k in ("t2", "t3", "v", "values")}


def kendall_counts(pairs: DataFrame, x: str, y: str) -> dict[str, int]:
    """n, concordant and discordant pairs, and tie sums for tau-b and its variance."""
    cells = durable(pairs.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("w")))
    n = cells.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n")).first()["n"]
    tx, ty = _ties(cells, "x"), _ties(cells, "y")
    out = {
        "n": int(n), "ties_x": tx["t2"] // 2, "ties_y": ty["t2"] // 2,
        "vx": tx["v"], "vy": ty["v"], "tx3": tx["t3"], "ty3": ty["t3"], "concordant": 0, "discordant": 0,
    }
    # Split on the column with fewer values: fewer bits, fewer copies.
    a, b = ("x", "y") if tx["values"] <= ty["values"] else ("y", "x")
    distinct_a = min(tx["values"], ty["values"])
    if distinct_a < 2:
        return out
    values = cells.select(a).distinct().withColumn("one", F.lit(1).cast("bigint"))
    if distinct_a <= SINGLE_TASK_VALUES:
        ranked = values.withColumn("code", F.row_number().over(Window.orderBy(a)).cast("bigint") - 1).drop("one")
    else:
        ranked = with_running_totals(values, [a], {"code": "one"}).withColumn("code", F.col("code") - 1).drop("one")
    coded = skew_join(cells, ranked, [a])
    bits = int(distinct_a - 1).bit_length()
    level = F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))
    split = coded.select(F.col(b).alias("v"), "w", "code", level.alias("level")).select(
        "level", F.expr("shiftright(code, level + 1)").alias("prefix"), F.expr("shiftright(code, level) & 1").alias("bit"), "v", "w"
    )
    merged = split.groupBy("level", "prefix", "v").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("w")).otherwise(0)).alias("lo"),
        F.sum(F.when(F.col("bit") == 1, F.col("w")).otherwise(0)).alias("hi"),
    )
    run = with_running_totals(merged, ["level", "prefix", "v"], {"upto": "lo"})
    before = F.col("upto") - F.col("lo")
    groups = run.groupBy("level", "prefix").agg(
        F.sum(_wide("hi") * _wide(before)).alias("under"),
        F.sum(_wide("hi") * _wide("upto")).alias("upto"),
        F.min(before).alias("base"),
        F.sum("hi").alias("hi"),
        F.sum("lo").alias("lo"),
    )
    row = groups.agg(
        F.sum(F.col("under") - _wide("base") * _wide("hi")).alias("c"),
        F.sum(_wide("hi") * _wide("lo") - F.col("upto") + _wide("base") * _wide("hi")).alias("d"),
    ).first()
    out["concordant"], out["discordant"] = int(row["c"] or 0), int(row["d"] or 0)
    return out
