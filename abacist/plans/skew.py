"""Joins that keep working when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 256
SALTS = 64
SPREAD_ROWS = 200_000


def hot_keys(df: DataFrame, on: Sequence[str]) -> list[tuple]:
    """Keys that hold more than 1/256 of the rows: never more than 255 of them.

    Inputs that one task handles easily have none worth the extra count.
    """
    total = df.count()
    if total < SPREAD_ROWS:
        return []
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.filter(F.col("_n") > total // HOT_SHARE).drop("_n").collect()
    return [tuple(r) for r in rows]


def _is_hot(df: DataFrame, on: Sequence[str], hot: list[tuple]) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    tests = [
        reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v).cast(types[k])) for k, v in zip(on, key)])
        for key in hot
    ]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def skew_join(
    big: DataFrame,
    other: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    null_safe: bool = False,
    hot: list[tuple] | None = None,
) -> DataFrame:
    """`inner` or `left` equi-join that spreads the hot keys of `big` over salts.

    Rows of a hot key get a salt from their own content and the matching rows
    of `other` are repeated once per salt; all other keys join as usual, and
    adaptive execution may still turn the join into a broadcast by size.  The
    salt is a function of the row, so a retried task routes it the same way;
    copies of one whole row stay together and are left to the adaptive skew
    join, which splits by map output.
    """
    if how not in ("inner", "left"):
        raise ValueError("skew_join supports inner and left joins")
    hot = hot_keys(big, on) if hot is None else hot
    right_keys = [f"_r_{k}" for k in on]
    renamed = other.select(
        *[F.col(k).alias(r) for k, r in zip(on, right_keys)], *[c for c in other.columns if c not in on]
    )
    pairs = [
        F.col(k).eqNullSafe(F.col(r)) if null_safe else F.col(k) == F.col(r) for k, r in zip(on, right_keys)
    ]
    if not hot:
        joined = big.join(renamed, reduce(lambda a, b: a & b, pairs), how)
        return joined.drop(*right_keys)
    salted = big.withColumn(
        "_salt", F.when(_is_hot(big, on, hot), F.pmod(F.xxhash64(*big.columns), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint"))
    )
    right_hot = _is_hot(other, on, hot)
    spread = (
        other.withColumn("_rsalt", F.explode(F.when(right_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    )
    spread = spread.select(
        *[F.col(k).alias(r) for k, r in zip(on, right_keys)],
        F.col("_rsalt").cast("bigint").alias("_rsalt"),
        *[c for c in other.columns if c not in on],
    )
    cond = reduce(lambda a, b: a & b, [*pairs, F.col("_salt") == F.col("_rsalt")])
    return salted.join(spread, cond, how).drop("_salt", "_rsalt", *right_keys)
