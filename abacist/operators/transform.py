"""Scaling, encoding, imputation, binning and derived columns.

Statistics that a transform needs are bounded by the number of columns, are
computed in one aggregate and enter the plan as literals.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacist.functions.columns import columns_of, log_offset, nan_to_null, powers, product, sqrt_of
from abacist.operators.describe import modes
from abacist.operators.frequency import MAX_LEVELS, levels
from abacist.operators.ordered import backward_fill, difference, forward_fill, interpolate
from abacist.plans.ordering import with_row_index
from abacist.plans.quantiles import clean_double, complete_rows, exact_quantiles
from abacist.plans.skew import skew_join


def _stats(df: DataFrame, columns: Sequence[str]) -> dict:
    return df.agg(
        *[
            F.struct(
                F.avg(clean_double(c)).alias("mean"),
                F.stddev_pop(clean_double(c)).alias("sd"),
                F.min(clean_double(c)).alias("min"),
                F.max(clean_double(c)).alias("max"),
            ).alias(c)
            for c in columns
        ]
    ).first().asDict()


def _scaled(c: str, centre, scale) -> Column:
    v = clean_double(c)
    if centre is None:
        return v
    # A column without spread scales to zero.
    return (v - F.lit(centre)) / F.lit(scale) if scale else v - v


def normalize(df: DataFrame, columns: Sequence[str], method: str = "zscore") -> DataFrame:
    """`zscore` (population sd), `minmax` to [0, 1] or `robust` (median and IQR)."""
    if method == "robust":
        q = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
        plan = {c: (q[c][1], q[c][2] - q[c][0] if q[c][1] is not None else None) for c in columns}
    else:
        s = _stats(df, columns)
        if method == "zscore":
            plan = {c: (s[c]["mean"], s[c]["sd"]) for c in columns}
        elif method == "minmax":
            plan = {c: (s[c]["min"], None if s[c]["min"] is None else s[c]["max"] - s[c]["min"]) for c in columns}
        else:
            raise ValueError(f"unknown normalisation: {method}")
    return df.withColumns({c: _scaled(c, *plan[c]) for c in columns})


def one_hot(df: DataFrame, columns: Sequence[str], max_levels: int = MAX_LEVELS) -> DataFrame:
    """`{column}_{value}` 0/1 columns in value order; missing is all zero; the source goes."""
    out: dict[str, Column] = {}
    for c in columns:
        for v in levels(df, c, max_levels):
            out[f"{c}_{v}"] = F.when(F.col(c) == F.lit(v), 1).otherwise(0)
    return df.withColumns(out).drop(*columns)


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """0-based codes in lexicographic order; missing counts as the text `nan`."""
    df = nan_to_null(df, columns)
    for c in columns:
        data = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("nan")))
        codes = with_row_index(data.select(c).distinct(), [c], "_code")
        df = skew_join(data, codes, [c], "left").withColumn(c, F.col("_code").cast("int")).select(*df.columns)
    return df


def ordinal_encode(df: DataFrame, column: str, order: Sequence) -> DataFrame:
    """Codes by the given order; unlisted values become NULL."""
    code = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column)) - 1
    return df.withColumn(column, F.when(code >= 0, code).cast("int"))


def target_encode(df: DataFrame, column: str, target: str, smoothing: float = 0.0, output: str | None = None) -> DataFrame:
    """Mean of the target per level, shrunk towards the overall mean by `smoothing` rows."""
    overall = df.agg(F.avg(target)).first()[0]
    means = df.groupBy(column).agg(F.avg(target).alias("_m"), F.count(target).alias("_k"))
    blend = (F.col("_m") * F.col("_k") + F.lit((overall or 0.0) * smoothing)) / (F.col("_k") + F.lit(float(smoothing)))
    means = means.select(column, F.when(F.col("_k") > 0, blend).alias("_enc"))
    joined = skew_join(df, means, [column], "left", null_safe=True)
    return joined.withColumn(output or f"{column}_target", F.coalesce("_enc", F.lit(overall))).drop("_enc")


def impute(
    df: DataFrame,
    columns: Sequence[str],
    strategy: str = "mean",
    *,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    value=None,
) -> DataFrame:
    """Fill missing values: mean, median, mode, constant, forward, backward, interpolate or drop."""
    df = nan_to_null(df, columns)
    if strategy == "drop":
        return complete_rows(df, columns)
    if strategy in ("forward", "backward", "interpolate"):
        fn = {"forward": forward_fill, "backward": backward_fill, "interpolate": interpolate}[strategy]
        return fn(df, columns, order_by=order_by, partition_by=partition_by)
    if strategy == "constant":
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})
    numeric = [c for c in columns if c in columns_of(df, "numeric")]
    if strategy == "mean":
        s = _stats(df, numeric) if numeric else {}
        fill = {c: s[c]["mean"] for c in numeric}
    elif strategy == "median":
        fill = {c: q[0] for c, q in exact_quantiles(df, numeric, (0.5,)).items()} if numeric else {}
    elif strategy == "mode":
        # Numbers are compared in their own type, everything else as text.
        types = {c: df.schema[c].dataType.simpleString() if c in numeric else "string" for c in columns}
        fill = {}
        for kind in sorted(set(types.values())):
            fill |= {r["column"]: r["mode"] for r in modes(df, [c for c in columns if types[c] == kind], kind).collect()}
    else:
        raise ValueError(f"unknown imputation strategy: {strategy}")
    types = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for c, v in fill.items():
        if v is None:
            continue
        if strategy == "mode":
            out[c] = F.coalesce(F.col(c), F.lit(v).cast(types[c]))
        else:
            out[c] = F.coalesce(clean_double(c), F.lit(v))
    return df.withColumns(out) if out else df


def _edges_code(c: Column, edges: Sequence[float]) -> Column:
    """Right-closed bins, lowest edge included: count of inner edges below the value."""
    inner = edges[1:-1]
    below = F.lit(0)
    if inner:
        below = sum((F.when(c > F.lit(e), 1).otherwise(0) for e in inner), F.lit(0))
    return F.when((c >= F.lit(edges[0])) & (c <= F.lit(edges[-1])), below)


def bin_numeric(df: DataFrame, columns: Sequence[str], n_bins: int = 5, strategy: str = "quantile") -> DataFrame:
    """`{column}_binned` with codes from 0, by equal counts or equal width."""
    out = {}
    if strategy == "quantile":
        probs = [i / n_bins for i in range(n_bins + 1)]
        cuts = {c: sorted(set(q)) if q[0] is not None else [] for c, q in exact_quantiles(df, columns, probs).items()}
    elif strategy == "uniform":
        s = _stats(df, columns)
        cuts = {}
        for c in columns:
            lo, hi = s[c]["min"], s[c]["max"]
            if lo is None:
                cuts[c] = []
                continue
            if lo == hi:
                lo, hi = lo - 0.001 * abs(lo) if lo else -0.001, hi + 0.001 * abs(hi) if hi else 0.001
            step = (hi - lo) / n_bins
            cuts[c] = [lo - 0.001 * (hi - lo)] + [lo + step * i for i in range(1, n_bins)] + [hi]
    else:
        raise ValueError(f"unknown binning strategy: {strategy}")
    for c in columns:
        code = _edges_code(clean_double(c), cuts[c]) if len(cuts[c]) > 1 else F.lit(None)
        out[f"{c}_binned"] = code.cast("int")
    return df.withColumns(out)


def log_transform(df: DataFrame, columns: Sequence[str], offset: float = 1.0) -> DataFrame:
    return df.withColumns({f"{c}_log": log_offset(c, offset) for c in columns})


def sqrt_transform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_sqrt": sqrt_of(c) for c in columns})


def polynomial(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    return df.withColumns({k: v for c in columns for k, v in powers(c, degree).items() if not k.endswith("^1")})


def interactions(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    """`a_x_b` products for every combination of 2 to `degree` columns."""
    out = {}
    for size in range(2, degree + 1):
        for names in combinations(columns, size):
            out["_x_".join(names)] = product(names)
    return df.withColumns(out)


def clip_outliers(df: DataFrame, columns: Sequence[str], lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Limit each column to two of its own exact percentiles."""
    q = exact_quantiles(df, columns, (lower, upper))
    return df.withColumns(
        {c: F.greatest(F.least(clean_double(c), F.lit(q[c][1])), F.lit(q[c][0])) for c in columns if q[c][0] is not None}
    )


def _step(name: str) -> Callable[..., DataFrame]:
    table: dict[str, Callable[..., DataFrame]] = {
        "normalize": normalize,
        "standardize": normalize,
        "encode": encode,
        "impute": impute,
        "bin": bin_numeric,
        "log": log_transform,
        "sqrt": sqrt_transform,
        "polynomial": polynomial,
        "difference": difference,
        "interaction": interactions,
        "clip": clip_outliers,
    }
    if name not in table:
        raise ValueError(f"unknown transformation: {name}")
    return table[name]


def encode(df: DataFrame, columns: Sequence[str], method: str = "onehot", **options) -> DataFrame:
    if method == "onehot":
        return one_hot(df, columns, **options)
    if method == "label":
        return label_encode(df, columns, **options)
    if method == "ordinal":
        for c in columns:
            df = ordinal_encode(df, c, options["orders"][c])
        return df
    if method == "target":
        for c in columns:
            df = target_encode(df, c, **options)
        return df
    raise ValueError(f"unknown encoding: {method}")


def transform(df: DataFrame, steps: Sequence[Mapping]) -> DataFrame:
    """Apply `[{type, columns, options}]` in order; an unknown type is an error."""
    for s in steps:
        df = _step(s["type"])(df, list(s.get("columns", [])), **s.get("options", {}))
    return df
