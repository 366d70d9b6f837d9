"""Global order without a single-task window.

`Window.orderBy` without `partitionBy` moves every row to one task, and with
`partitionBy` a hot key does the same.  Everything here instead sorts by range
(which splits even when one leading key is hot, as long as the whole key tells
rows apart), writes the sorted chunks once, and combines the chunks through a
table that has one row per chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.plans.session import durable

CHUNK = "_chunk"
_POS = "_pos"
_LOW_BITS = (1 << 33) - 1
BLOCK_ROWS = 1 << 20


def sorted_chunks(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    """`df` range-sorted and written out, with its chunk number and position.

    Range bounds come from sampling, so two runs of the sort may cut at other
    places; the durable copy fixes them for every later job.
    """
    tagged = df.orderBy(*order_by).withColumn(_POS, F.monotonically_increasing_id())
    return durable(tagged.withColumn(CHUNK, F.shiftright(_POS, 33).cast("int")))


def _before_chunk(chunk_totals: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exclusive prefix sums over the chunk table (one row per sort partition)."""
    w = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return chunk_totals.select(
        CHUNK, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_before_{n}") for n in names]
    )


def with_row_index(df: DataFrame, order_by: Sequence[str | Column], name: str = "row_index") -> DataFrame:
    """Add the 0-based position of each row in the order of `order_by`."""
    chunks = sorted_chunks(df, order_by)
    sizes = chunks.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("rows"))
    # As many rows as the sort had partitions.
    before = F.broadcast(_before_chunk(sizes, ["rows"]))
    return (
        chunks.join(before, CHUNK)
        .withColumn(name, F.col("_before_rows") + F.col(_POS).bitwiseAND(F.lit(_LOW_BITS)))
        .drop(CHUNK, _POS, "_before_rows")
    )


def with_running_totals(
    df: DataFrame, order_by: Sequence[str | Column], totals: Mapping[str, str]
) -> DataFrame:
    """Add inclusive running sums: `totals` maps new column -> summed column."""
    chunks = sorted_chunks(df, order_by)
    sums = chunks.groupBy(CHUNK).agg(*[F.sum(src).alias(out) for out, src in totals.items()])
    before = F.broadcast(_before_chunk(sums, list(totals)))
    w = Window.partitionBy(CHUNK).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    local = chunks.select(
        *[c for c in chunks.columns], *[F.sum(src).over(w).alias(f"_local_{out}") for out, src in totals.items()]
    )
    out = local.join(before, CHUNK)
    return out.select(
        *df.columns, *[(F.col(f"_before_{o}") + F.col(f"_local_{o}")).alias(o) for o in totals]
    )


def windowed(
    indexed: DataFrame,
    index: str,
    build,
    back: int = 0,
    ahead: int = 0,
    partition_by: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Window expressions over an indexed frame, in blocks of bounded size.

    Each block also receives copies of the `back` rows before it and the
    `ahead` rows after it, so frames that reach no further are exact.
    `build(window)` returns `{name: Column}`.
    """
    size = max(block_rows, back + ahead + 1)
    block = F.expr(f"`{index}` div {size}")
    offset = F.col(index) % size
    homes = F.array_compact(
        F.array(
            block,
            F.when(offset >= size - back, block + 1) if back else F.lit(None).cast("bigint"),
            F.when((offset < ahead) & (block > 0), block - 1) if ahead else F.lit(None).cast("bigint"),
        )
    )
    copies = indexed.withColumn("_home", block).withColumn("_block", F.explode(homes))
    w = Window.partitionBy("_block", *partition_by).orderBy(index)
    return (
        copies.withColumns(build(w))
        .filter(F.col("_home") == F.col("_block"))
        .drop("_home", "_block")
    )


def carried(
    indexed: DataFrame,
    index: str,
    columns: Sequence[str],
    partition_by: Sequence[str] = (),
    forward: bool = True,
    suffix: str = "_carried",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Nearest non-null value at or before (`forward`) or after each row.

    Adds `{c}{suffix}` as a struct `(value, at)` with the position it came
    from.  Rows must be indexed in the order `partition_by`, then time, so the
    last non-null value overall is the group's own or the group has none.
    """
    frame = indexed.withColumn("_block", F.expr(f"`{index}` div {block_rows}"))
    keys = [F.col(k) for k in partition_by]

    def holder(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col(index).alias("at"), F.col(c).alias("value"), *keys))

    # Always a growing frame from the near end: Spark recomputes a frame that
    # is unbounded on the far side for every row.
    way = F.asc if forward else F.desc
    edge = F.max_by if forward else F.min_by
    inside = Window.partitionBy("_block").orderBy(way(index)).rowsBetween(Window.unboundedPreceding, 0)
    local = frame.withColumns({f"_in_{c}": F.last(holder(c), ignorenulls=True).over(inside) for c in columns})
    # One row per block; then the nearest block on that side that holds a value.
    edges = frame.groupBy("_block").agg(
        *[edge(holder(c), F.when(F.col(c).isNotNull(), F.col(index))).alias(f"_edge_{c}") for c in columns]
    )
    outside = Window.orderBy(way("_block")).rowsBetween(Window.unboundedPreceding, -1)
    reach = edges.select(
        "_block", *[F.last(F.col(f"_edge_{c}"), ignorenulls=True).over(outside).alias(f"_far_{c}") for c in columns]
    )
    joined = local.join(reach, "_block", "left")
    out = {}
    for c in columns:
        best = F.coalesce(F.col(f"_in_{c}"), F.col(f"_far_{c}"))
        same = best.isNotNull()
        for k in partition_by:
            same = same & best[k].eqNullSafe(F.col(k))
        out[f"{c}{suffix}"] = F.when(same, F.struct(best["value"].alias("value"), best["at"].alias("at")))
    return joined.withColumns(out).select(*indexed.columns, *out)
