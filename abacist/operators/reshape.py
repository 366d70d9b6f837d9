"""Joins and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.plans.quantiles import complete_rows
from abacist.plans.skew import hot_keys, skew_join


def merge(
    left: DataFrame,
    right: DataFrame,
    *,
    how: str = "inner",
    on: Sequence[str] | None = None,
    left_on: Sequence[str] | None = None,
    right_on: Sequence[str] | None = None,
    suffixes: tuple[str, str] = ("_x", "_y"),
    indicator: bool = False,
    spread_hot_keys: bool = False,
) -> DataFrame:
    """Spreadsheet-style merge: missing keys match each other, shared names get suffixes.

    With `spread_hot_keys` the keys that hold over 1/256 of the left rows are
    salted before the join (one extra count over the keys); without it the
    adaptive skew join is the only protection.
    """
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"unsupported join type: {how}")
    lk = list(on or left_on or [])
    rk = list(on or right_on or [])
    if not lk or len(lk) != len(rk):
        raise ValueError("give the same number of left and right keys")
    same = on is not None
    clash = (set(left.columns) & set(right.columns)) - (set(lk) if same else set())
    l_names = {c: f"{c}{suffixes[0]}" if c in clash else c for c in left.columns}
    r_names = {c: f"{c}{suffixes[1]}" if c in clash else c for c in right.columns}
    keys = [f"_k{i}" for i in range(len(lk))]
    a = left.select(*[F.col(c).alias(k) for c, k in zip(lk, keys)], *[F.col(c).alias(l_names[c]) for c in left.columns if not (same and c in lk)], F.lit(True).alias("_in_left"))
    b = right.select(*[F.col(c).alias(k) for c, k in zip(rk, keys)], *[F.col(c).alias(r_names[c]) for c in right.columns if not (same and c in rk)], F.lit(True).alias("_in_right"))
    out = _join(a, b, keys, how, spread_hot_keys)
    final = [F.col(k).alias(c) for c, k in zip(lk, keys)] if same else []
    final += [F.col(l_names[c]) for c in left.columns if not (same and c in lk)]
    final += [F.col(r_names[c]) for c in right.columns if not (same and c in rk)]
    if indicator:
        both = F.col("_in_left").isNotNull() & F.col("_in_right").isNotNull()
        final.append(F.when(both, "both").when(F.col("_in_left").isNotNull(), "left_only").otherwise("right_only").alias("_merge"))
    return out.select(*final)


def _join(a: DataFrame, b: DataFrame, keys: list[str], how: str, spread: bool) -> DataFrame:
    if spread:
        if how in ("inner", "left"):
            return skew_join(a, b, keys, how, null_safe=True)
        if how == "right":
            return skew_join(b, a, keys, "left", null_safe=True)
        # Every left row once, then the right rows that no left row matches.
        kept = skew_join(a, b, keys, "left", null_safe=True, hot=hot_keys(a, keys))
        present = a.select(*[F.col(k).alias(f"_l{k}") for k in keys]).distinct()
        alone = b.join(present, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_l{k}")) for k in keys]), "left_anti")
        return kept.unionByName(alone, allowMissingColumns=True)
    right_keys = [f"_r{k}" for k in keys]
    renamed = b.withColumnsRenamed(dict(zip(keys, right_keys)))
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(r)) for k, r in zip(keys, right_keys)])
    joined = a.join(renamed, cond, how)
    return joined.withColumns({k: F.coalesce(F.col(k), F.col(r)) for k, r in zip(keys, right_keys)}).drop(*right_keys)


def merge_request(
    left: DataFrame, right: DataFrame, how: str = "inner", left_on: Sequence[str] = (), right_on: Sequence[str] = ()
) -> DataFrame:
    """Merge with the `_left` / `_right` suffix convention."""
    if list(left_on) == list(right_on):
        return merge(left, right, how=how, on=left_on, suffixes=("_left", "_right"))
    return merge(left, right, how=how, left_on=left_on, right_on=right_on, suffixes=("_left", "_right"))


def melt(
    df: DataFrame,
    id_vars: Sequence[str],
    value_vars: Sequence[str] | None = None,
    var_name: str = "variable",
    value_name: str = "value",
) -> DataFrame:
    """Wide to long, missing values kept."""
    values = list(value_vars) if value_vars else [c for c in df.columns if c not in id_vars]
    return df.unpivot(list(id_vars), values, var_name, value_name)


def align(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows complete in the features and the target."""
    return complete_rows(df, [*features, target])
