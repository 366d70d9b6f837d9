"""Distinct counts: sketches settle what is far from a threshold, exact counts only what is near."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from abacist.functions.columns import nan_to_null

#: Relative standard deviation of the sketches, and how many of them an estimate may be off.
DEVIATION = 0.01
MARGIN = 7
#: Columns that look to have at most so many values are always counted: partial aggregates keep that exchange tiny.
FEW = 200
COLUMNS_PER_JOB = 40


@dataclass(frozen=True)
class Distinct:
    """Rows and distinct values that are not missing; `low` to `high` surely holds the number of distinct ones."""

    count: int
    low: float
    high: float

    @property
    def exact(self) -> bool:
        return self.low == self.high


def _values(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    return F.to_json(F.col(f"`{column}`")) if isinstance(kind, (MapType, VariantType)) else F.col(f"`{column}`")


def exact_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`(column, unique, count)`: every column by its own values in their own type, read from its own scan."""
    clean = nan_to_null(df, columns)
    parts = []
    for c in columns:
        values = clean.select(_values(clean, c).alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        parts.append(values.agg(F.count(F.lit(1)).alias("unique"), F.coalesce(F.sum("n"), F.lit(0)).alias("count")).select(F.lit(c).alias("column"), "unique", "count"))
    return reduce(DataFrame.unionAll, parts)


def settled_counts(df: DataFrame, columns: Sequence[str], open_: Callable[[str, Distinct], bool]) -> dict[str, Distinct]:
    """Per column what is known of its distinct values: a range from a sketch, exact where `open_` asks for more.

    One pass sketches all columns, each in its own type; only columns whose
    range leaves the caller's question open have their values shuffled.
    """
    clean = nan_to_null(df, columns)
    out: dict[str, Distinct] = {}
    for s in range(0, len(columns), COLUMNS_PER_JOB):
        part = columns[s : s + COLUMNS_PER_JOB]
        row = clean.agg(*[F.struct(F.count(F.col(f"`{c}`")).alias("n"), F.approx_count_distinct(_values(clean, c), DEVIATION).alias("d")).alias(f"c{i}") for i, c in enumerate(part)]).first()
        for i, c in enumerate(part):
            n, d = row[f"c{i}"]["n"], row[f"c{i}"]["d"]
            out[c] = Distinct(n, min(n, d * (1 - MARGIN * DEVIATION)), min(n, d * (1 + MARGIN * DEVIATION)))
    unsure = [c for c in columns if out[c].count and (out[c].low <= FEW or open_(c, out[c]))]
    if unsure:
        out |= {r["column"]: Distinct(r["count"], r["unique"], r["unique"]) for r in exact_counts(df, unsure).collect()}
    return out | {c: Distinct(0, 0, 0) for c in columns if not out[c].count}
