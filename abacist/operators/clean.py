"""Filters, column selection, cleaning and rule checks."""

from __future__ import annotations

import operator
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from abacist.functions.columns import columns_of
from abacist.plans.quantiles import complete_rows

_COMPARE = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}


def subset(
    df: DataFrame, columns: Sequence[str] | None = None, rows: int | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """Column subset with an optional row limit in a stated order."""
    out = df.orderBy(*order_by) if order_by else df
    out = out.limit(rows) if rows is not None else out
    return out.select(*columns) if columns else out


def select_kind(df: DataFrame, kind: str) -> DataFrame:
    """Keep the columns of one kind: numeric, categorical, datetime, boolean."""
    return df.select(*columns_of(df, kind))


def predicate(spec: Mapping) -> Column:
    """One filter `{column, op, value}` as a Column."""
    c, op, value = F.col(spec["column"]), spec["op"], spec.get("value")
    if op in _COMPARE:
        return _COMPARE[op](c, F.lit(value))
    if op == "in":
        return c.isin(list(value))
    if op == "between":
        return c.between(*value)
    if op == "like":
        return c.like(value)
    if op == "isnull":
        return c.isNull()
    if op == "notnull":
        return c.isNotNull()
    raise ValueError(f"unknown filter operator: {op}")


def filter_rows(df: DataFrame, filters: Sequence[Mapping], logic: str = "and") -> DataFrame:
    """All (`and`) or any (`or`) of the filters, as one pushed-down predicate."""
    if not filters:
        return df
    join = {"and": operator.and_, "or": operator.or_}[logic]
    return df.filter(reduce(join, [predicate(f) for f in filters]))


def outside(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """Rows whose value lies outside [lo, hi]."""
    return df.filter((F.col(column) < lo) | (F.col(column) > hi))


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return complete_rows(df, columns)


def clean_names(names: Sequence[str]) -> list[str]:
    """Identifier-safe, unique versions of column names."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        new = re.sub(r"[^0-9A-Za-z_]", "", re.sub(r"\s+", "_", name.strip()))
        if not new or new[0].isdigit():
            new = f"col_{new}"
        count = seen.get(new, 0)
        seen[new] = count + 1
        out.append(f"{new}_{count}" if count else new)
    return out


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def column_name_report(df: DataFrame) -> DataFrame:
    """`(name, valid, cleaned)` for every column."""
    rows = [
        (n, bool(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", n)), c) for n, c in zip(df.columns, clean_names(df.columns))
    ]
    return df.sparkSession.createDataFrame(rows, "name string, valid boolean, cleaned string")


def clean_table(df: DataFrame) -> DataFrame:
    """Drop `Unnamed` index columns, trim strings, make all-numeric text columns double.

    A text column turns into double only when every non-null value parses; the
    test is one aggregate over all text columns.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("Unnamed")])
    text = [f.name for f in kept.schema.fields if isinstance(f.dataType, StringType)]
    if not text:
        return kept
    trimmed = kept.withColumns({c: F.trim(F.col(f"`{c}`")) for c in text})
    numbers = {c: F.nanvl(F.col(f"`{c}`").try_cast("double"), F.lit(None)) for c in text}
    tests = trimmed.agg(
        *[
            (F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()) == 0).alias(f"t{i}")
            for i, c in enumerate(text)
        ]
    ).first()
    return trimmed.withColumns({c: numbers[c] for i, c in enumerate(text) if tests[f"t{i}"]})


def replace_values(df: DataFrame, column: str, pattern: str, replacement: str) -> DataFrame:
    return df.withColumn(column, F.regexp_replace(column, pattern, replacement))


def validate_rules(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """Violations per rule: `range`, `pattern`, `not_null` in one pass, `unique` by grouping."""
    spark = df.sparkSession
    row_rules = [(i, r) for i, r in enumerate(rules) if r["rule"] != "unique"]
    failing = []
    for i, r in row_rules:
        c = F.col(r["column"])
        if r["rule"] == "range":
            low, high = r.get("min"), r.get("max")
            bad = F.lit(False)
            bad = bad | (c < low) if low is not None else bad
            bad = bad | (c > high) if high is not None else bad
        elif r["rule"] == "pattern":
            bad = ~c.rlike(r["pattern"])
        elif r["rule"] == "not_null":
            bad = c.isNull()
        else:
            raise ValueError(f"unknown rule: {r['rule']}")
        failing.append(F.count_if(bad).alias(f"v{i}"))
    found = df.agg(*failing).first() if failing else None
    rows = []
    for i, r in enumerate(rules):
        if r["rule"] == "unique":
            groups = df.filter(F.col(r["column"]).isNotNull()).groupBy(r["column"]).agg(F.count(F.lit(1)).alias("n"))
            violations = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("v")).first()["v"]
        else:
            violations = found[f"v{i}"]
        rows.append((r["column"], r["rule"], int(violations), violations == 0))
    return spark.createDataFrame(rows, "column string, rule string, violations long, passed boolean")
