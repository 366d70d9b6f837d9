"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abacist.llm.common import small, written

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source that share a range of keys, on average.
RANGE_ROWS = 4096


def targets(sizes: DataFrame, weights: Sequence[float], epochs: int) -> DataFrame:
    """Words to take from each source; `sizes` has `source` and `source_size`.

    Weights go round the sources in order of code points, null last.  The
    sources share the sum of all sizes by weight; none gets more than `epochs`
    times its size, and what is left over goes to the others by weight.  That
    is one common level: target = least(epochs * size, level * weight).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ring = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("w", ring[(F.row_number().over(order) - 1) % len(weights)])
    ranked = ranked.withColumn("most", F.col("source_size") * float(epochs))
    by_room = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    stepped = ranked.withColumn("at", F.row_number().over(by_room)).withColumn("fair", left / weight)
    level = F.min(F.when(F.col("most") / F.col("w") >= F.col("fair"), F.struct("at", "fair"))).over(every)["fair"]
    return stepped.withColumn("level", level).select("source", "source_size", F.least(F.col("most"), F.col("level") * F.col("w")).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    epochs: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """Words that the mix takes from each row: id, source, size, source_size, target, taken.

    A key made of the id's hash puts each source's rows in random order.  Every
    row is taken as many whole times as its source fits in the target, and the
    rest of the target goes to the first rows by key, the last one of them in
    part.  Sums over ranges of keys find the range in which a source's target
    ends; only that range is sorted row by row, so no source meets in one task.

    Null text and text without words have size 0 and give nothing.  Null is a
    source of its own.  Rows with one id follow each other by size; copies of a
    row are taken apart, in any order.  The result depends on the rows only.
    An empty table gives an empty result; other columns are ignored.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, epochs)
    total = F.round("target").cast("long")
    plan = plan.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(total / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", total - F.col("rounds") * F.col("source_size"))
    plan = written(plan)

    bits = max(0, min(28, math.ceil(math.log2(max(1, rows.count() / RANGE_ROWS)))))
    span = F.shiftright(F.conv(F.substring("key", 1, 7), 16, 10).cast("long"), 28 - bits)
    rows = rows.withColumn("span", span)
    ranges = rows.groupBy("source", "span").agg(F.sum("size").alias("words"))
    until = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(until), F.lit(0)))
    ends = ranges.join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    ends = ends.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    ends = ends.select("s", F.col("span").alias("cut"), "before")
    plan = plan.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # A source without words has no cut.
    plan = small(written(plan.withColumnRenamed("source", "s")))

    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    again = F.when(F.col("span") < F.col("cut"), F.col("size")).otherwise(F.lit(0))
    clear = placed.filter(F.col("cut").isNull() | (F.col("span") != F.col("cut"))).withColumn("part", again)
    inside = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    edge = placed.filter(F.col("span") == F.col("cut")).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - ahead)))
    return clear.unionByName(edge).select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        (F.col("rounds") * F.col("size") + F.col("part")).cast("long").alias("taken"),
    )
