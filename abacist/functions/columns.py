"""Scalar Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)

KINDS = {
    "numeric": NUMERIC,
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "categorical": (T.StringType, T.VarcharType, T.CharType),
    "datetime": DATETIME,
    "boolean": (T.BooleanType,),
    "timedelta": (T.DayTimeIntervalType,),
}


def columns_of(df: DataFrame, kind: str) -> list[str]:
    """Names of the columns of one kind, read from the schema alone."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, KINDS[kind])]


def column_types(df: DataFrame) -> dict[str, str]:
    """Column -> integer / numeric / categorical / boolean / datetime / timedelta / other."""
    order = ("integer", "numeric", "categorical", "boolean", "datetime", "timedelta")
    return {
        f.name: next((k for k in order if isinstance(f.dataType, KINDS[k])), "other") for f in df.schema.fields
    }


def missing(df: DataFrame, c: str) -> Column:
    """NULL, or NaN in a floating column."""
    col = F.col(f"`{c}`")
    return col.isNull() | F.isnan(col) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else col.isNull()


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn NaN into NULL in the floating columns, or in those of `columns`."""
    wanted = df.columns if columns is None else columns
    floats = [f.name for f in df.schema.fields if f.name in wanted and isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in floats}) if floats else df


def safe_divide(numerator: Column, denominator: Column, default: float | None = 0.0) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(default))


def log_offset(c: str, offset: float = 1.0) -> Column:
    """ln(c + offset); NULL where the argument is not positive."""
    return F.ln(F.col(c) + F.lit(offset))


def sqrt_of(c: str) -> Column:
    return F.when(F.col(c) >= 0, F.sqrt(F.col(c)))


def powers(c: str, degree: int) -> dict[str, Column]:
    return {f"{c}^{i}": F.pow(F.col(c), F.lit(i)) for i in range(1, degree + 1)}


def product(names: tuple[str, ...]) -> Column:
    """Product of columns; a missing factor counts as one."""
    return reduce(lambda a, b: a * b, [F.coalesce(F.col(n), F.lit(1)) for n in names])


def row_hash(df: DataFrame) -> Column:
    """sha256 of the row content."""
    return F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content fingerprint of a table: row count and two hash folds."""
    h = F.xxhash64(*df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(h).alias("hash_xor"),
        F.sum(h.cast("decimal(38,0)")).alias("hash_sum"),
    )


def effect_size_label(d: Column) -> Column:
    """Cohen's d in words."""
    a = F.abs(d)
    return (
        F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").when(a.isNotNull(), "large")
    )


def eta_label(eta: Column) -> Column:
    """Eta squared in words."""
    return (
        F.when(eta < 0.01, "negligible").when(eta < 0.06, "small").when(eta < 0.14, "medium").when(eta.isNotNull(), "large")
    )


def significance_label(p: Column, alpha: float = 0.05) -> Column:
    return F.when(p < alpha, "significant").when(p.isNotNull(), "not significant")


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution function inside generated code.

    Built on the Chebyshev fit of erfc from Numerical Recipes (relative error
    below 1.2e-7 everywhere), as Spark has no erf.
    """
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    # Coefficients of the published fit.
    coefficients = (
        -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
    )
    poly = reduce(lambda acc, c: F.lit(c) + t * acc, reversed(coefficients[:-1]), F.lit(coefficients[-1]))
    half = F.lit(0.5) * t * F.exp(-x * x + poly)
    return F.when(z >= 0, F.lit(1.0) - half).otherwise(half)


def norm_ppf(p: Column) -> Column:
    """Standard normal quantile inside generated code.

    Acklam's rational approximation (relative error below 1.15e-9).
    """
    # Coefficients of the published approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def horner(coef, x):
        return reduce(lambda acc, k: acc * x + F.lit(k), coef[1:], F.lit(coef[0]))

    q = p - F.lit(0.5)
    r = q * q
    middle = horner(a, r) * q / horner(b, r)
    low_p = F.least(p, F.lit(1.0) - p)
    s = F.sqrt(F.lit(-2.0) * F.ln(low_p))
    tail = horner(c, s) / horner(d, s)
    return F.when(low_p >= 0.02425, middle).when(p < 0.5, tail).otherwise(-tail)
