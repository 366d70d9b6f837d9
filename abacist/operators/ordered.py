"""Operators that depend on row order.  The order is always an argument."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.functions.columns import nan_to_null
from abacist.plans.ordering import carried, windowed, with_row_index

_IX = "_ix"


def _indexed(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str]) -> DataFrame:
    if not order_by:
        raise ValueError("order_by is required: Spark rows have no order of their own")
    return with_row_index(nan_to_null(df), [*partition_by, *order_by], _IX)


def difference(
    df: DataFrame, columns: Sequence[str], periods: int = 1, *, order_by: Sequence[str], partition_by: Sequence[str] = ()
) -> DataFrame:
    """`{column}_diff`: the value minus the value `periods` rows earlier."""
    back, ahead = max(periods, 0), max(-periods, 0)
    out = windowed(
        _indexed(df, order_by, partition_by),
        _IX,
        lambda w: {f"{c}_diff": F.col(c) - F.lag(c, periods).over(w) for c in columns},
        back,
        ahead,
        partition_by,
    )
    return out.drop(_IX)


def lag_features(
    df: DataFrame, columns: Sequence[str], lags: Sequence[int], *, order_by: Sequence[str], partition_by: Sequence[str] = ()
) -> DataFrame:
    out = windowed(
        _indexed(df, order_by, partition_by),
        _IX,
        lambda w: {f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in lags},
        max([*lags, 0]),
        max([-k for k in lags] + [0]),
        partition_by,
    )
    return out.drop(_IX)


def rolling(
    df: DataFrame,
    column: str,
    window: int,
    functions: Sequence[str] = ("mean", "std", "sum"),
    *,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Trailing statistics over `window` rows; NULL until a full window of values exists."""
    table = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max}

    def build(w):
        frame = w.rowsBetween(-(window - 1), 0)
        full = F.count(column).over(frame) == window
        return {f"{column}_roll_{f}": F.when(full, table[f](column).over(frame)) for f in functions}

    return windowed(_indexed(df, order_by, partition_by), _IX, build, window - 1, 0, partition_by).drop(_IX)


def forward_fill(df: DataFrame, columns: Sequence[str], *, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    out = carried(_indexed(df, order_by, partition_by), _IX, columns, partition_by, forward=True)
    return out.withColumns({c: F.col(f"{c}_carried")["value"] for c in columns}).select(*df.columns)


def backward_fill(df: DataFrame, columns: Sequence[str], *, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    out = carried(_indexed(df, order_by, partition_by), _IX, columns, partition_by, forward=False)
    return out.withColumns({c: F.col(f"{c}_carried")["value"] for c in columns}).select(*df.columns)


def interpolate(df: DataFrame, columns: Sequence[str], *, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Linear by position; leading gaps stay, trailing gaps repeat the last value."""
    indexed = _indexed(df, order_by, partition_by)
    both = carried(indexed, _IX, columns, partition_by, forward=True, suffix="_prev")
    both = carried(both, _IX, columns, partition_by, forward=False, suffix="_next")
    out = {}
    for c in columns:
        prev, nxt = F.col(f"{c}_prev"), F.col(f"{c}_next")
        share = (F.col(_IX) - prev["at"]) / F.when(nxt["at"] > prev["at"], nxt["at"] - prev["at"])
        between = prev["value"] + (nxt["value"] - prev["value"]) * share
        out[c] = F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(nxt.isNull(), prev["value"].cast("double")).otherwise(between)
    return both.withColumns(out).select(*df.columns)


def row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_index") -> DataFrame:
    return with_row_index(df, order_by, name)
