"""Role inference, quality scores, validation and outliers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacist.functions.columns import columns_of
from abacist.operators.describe import distinct_counts, iqr_bounds, missing_counts
from abacist.plans.distinct import settled_counts
from abacist.plans.quantiles import clean_double, exact_quantiles


def _role(numeric: bool, unique: float, ratio: float) -> str:
    if unique == 2:
        return "binary"
    if numeric:
        return "ordinal" if ratio < 0.05 and unique < 20 else "numeric"
    return "categorical" if ratio < 0.5 else "text"


def infer_roles(df: DataFrame) -> DataFrame:
    """Role per column: numeric, ordinal, binary, categorical, text, datetime.

    Distinct values come from sketches where those decide the role; `unique` is
    then an estimate and `exact` false.  Columns near a threshold are counted.
    """
    numeric = set(columns_of(df, "numeric")) | set(columns_of(df, "boolean"))
    dates = set(columns_of(df, "datetime"))
    n = df.count()

    def role(c: str, unique: float) -> str:
        return _role(c in numeric, unique, unique / n if n else 1.0)

    usable = [c for c in df.columns if c not in dates]
    known = settled_counts(df, usable, lambda c, d: role(c, d.low) != role(c, d.high)) if usable else {}
    rows = []
    for i, c in enumerate(df.columns):
        d = known.get(c)
        middle = None if d is None else round((d.low + d.high) / 2)
        rows.append((i, c, "datetime" if d is None else role(c, middle), middle, None if d is None else d.exact))
    return df.sparkSession.createDataFrame(rows, "position int, column string, role string, unique long, exact boolean")


def apply_roles(df: DataFrame) -> DataFrame:
    """The same table with each role stored in the column metadata."""
    roles = {r["column"]: r["role"] for r in infer_roles(df).collect()}
    return df.select(*[F.col(c).alias(c, metadata={**df.schema[c].metadata, "role": roles[c]}) for c in df.columns])


def row_names(df: DataFrame) -> list[Column]:
    """128 bits that name a row: equal rows have equal names, NULLs and their places included."""
    floats = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("float", "double")}
    # Adding zero turns -0.0 into 0.0; hashes pass over NULL, so where they stand is hashed as well.
    cells = [F.col(f"`{c}`") + 0.0 if c in floats else F.col(f"`{c}`") for c in df.columns]
    gaps = [F.col(f"`{c}`").isNull() for c in df.columns]
    return [F.xxhash64(F.lit(seed), *cells, *gaps).alias(f"_name{seed}") for seed in (1, 2)]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row: count and rate.  Rows meet by 128-bit names, not by their whole width."""
    if any("map<" in f.dataType.simpleString() for f in df.schema.fields):
        df = df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields])
    groups = df.select(*row_names(df)).groupBy("_name1", "_name2").agg(F.count(F.lit(1)).alias("_n"))
    out = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("duplicates"), F.col("rows")), F.lit(0.0)))


def duplicate_columns(df: DataFrame) -> list[str]:
    return sorted({c for c in df.columns if df.columns.count(c) > 1})


def id_candidates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns in which every row has its own value; only those that a sketch lets be so are counted."""
    n = df.count()
    known = settled_counts(df, list(columns or df.columns), lambda c, d: d.count == n and d.high >= n)
    return df.sparkSession.createDataFrame([(c,) for c, d in known.items() if n and d.exact and d.low == n], "column string")


def mixed_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns that hold both all-digit and all-letter values."""
    columns = list(columns or columns_of(df, "categorical"))
    one = df.agg(
        *[
            F.coalesce(F.bool_or(F.col(c).rlike(r"^\d+$")) & F.bool_or(F.col(c).rlike(r"^[a-zA-Z]+$")), F.lit(False)).alias(f"m{i}")
            for i, c in enumerate(columns)
        ]
    )
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mixed")) for i, c in enumerate(columns)]
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def column_outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """IQR bounds and the number of values outside them, per column."""
    columns = list(columns or columns_of(df, "numeric"))
    bounds = iqr_bounds(df, columns)
    if not bounds:
        return df.sparkSession.createDataFrame([], "column string, low double, high double, n long, outliers long, pct double")
    one = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(lo).alias("low"),
                F.lit(hi).alias("high"),
                F.count(clean_double(c)).alias("n"),
                F.count_if((clean_double(c) < lo) | (clean_double(c) > hi)).alias("outliers"),
            ).alias(f"c{i}")
            for i, (c, (lo, hi)) in enumerate(bounds.items())
        ]
    )
    rows = one.select(F.explode(F.array(*one.columns)).alias("e")).select("e.*")
    return rows.withColumn("pct", F.try_divide(F.col("outliers"), F.col("n")) * 100)


def detect_outliers(df: DataFrame, columns: Sequence[str], key: str, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """`(key, column, value, is_outlier)` by `iqr`, `zscore` (population sd) or `mad`."""
    if method == "iqr":
        limits = {c: (lo, hi) for c, (lo, hi) in iqr_bounds(df, columns, threshold or 1.5).items()}
        flags = {c: (clean_double(c) < lo) | (clean_double(c) > hi) for c, (lo, hi) in limits.items()}
    elif method == "zscore":
        s = df.agg(*[F.struct(F.avg(clean_double(c)).alias("m"), F.stddev_pop(clean_double(c)).alias("s")).alias(c) for c in columns]).first()
        flags = {
            c: F.abs(F.try_divide(clean_double(c) - F.lit(s[c]["m"]), F.lit(s[c]["s"]))) > F.lit(threshold or 3.0) for c in columns
        }
    elif method == "mad":
        med = exact_quantiles(df, columns, (0.5,))
        dev = df.select(*[F.abs(clean_double(c) - F.lit(med[c][0])).alias(c) for c in columns])
        mad = exact_quantiles(dev, columns, (0.5,))
        # 0.6745 makes the deviation comparable with a normal z-score.
        flags = {
            c: F.abs(F.try_divide(F.lit(0.6745) * (clean_double(c) - F.lit(med[c][0])), F.lit(mad[c][0]))) > F.lit(threshold or 3.5)
            for c in columns
        }
    elif method == "isolation_forest":
        from abacist.operators.anomaly import IsolationForest

        parts = []
        for c in columns:
            data = df.select(F.col(key), clean_double(c).alias("value")).dropna()
            scored = IsolationForest(contamination=0.1).fit(data, ["value"], key).transform(data)
            parts.append(scored.select(key, F.lit(c).alias("column"), "value", (F.col("prediction") == -1).alias("is_outlier")))
        return reduce(DataFrame.unionByName, parts)
    else:
        raise ValueError(f"unknown outlier method: {method}")
    entries = [
        F.struct(F.lit(c).alias("column"), clean_double(c).alias("value"), F.coalesce(flags[c], F.lit(False)).alias("is_outlier"))
        for c in flags
    ]
    out = df.select(F.col(key), F.explode(F.array(*entries)).alias("e")).select(key, "e.*")
    return out.filter(F.col("value").isNotNull())


def outlier_summary(flagged: DataFrame) -> DataFrame:
    out = flagged.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_outlier").alias("outliers"))
    return out.withColumn("pct", F.try_divide(F.col("outliers"), F.col("n")) * 100)


def quality_scores(df: DataFrame) -> DataFrame:
    """Completeness, validity, uniqueness and consistency in [0, 1]; overall in percent."""
    miss = missing_counts(df).agg(F.sum("missing").alias("m"), F.max("rows").alias("n")).first()
    cells = (miss["n"] or 0) * len(df.columns)
    completeness = 1.0 - miss["m"] / cells if cells else 1.0
    numeric = columns_of(df, "numeric")
    validity = 1.0
    if numeric:
        bad = column_outliers(df, numeric).filter(F.col("outliers") > 0).count()
        validity = 1.0 - bad / len(numeric)
    uniqueness = 1.0 - duplicate_rows(df).first()["rate"]
    text = columns_of(df, "categorical")
    consistency = 1.0
    if text:
        consistency = 1.0 - mixed_text(df, text).filter("mixed").count() / len(text)
    overall = 100.0 * (completeness + validity + uniqueness + consistency) / 4
    return df.sparkSession.createDataFrame(
        [(completeness, validity, uniqueness, consistency, overall)],
        "completeness double, validity double, uniqueness double, consistency double, overall double",
    )


def quality_report(df: DataFrame) -> dict[str, DataFrame]:
    """Scores, per-column detail and recommendations."""
    scores = quality_scores(df)
    missing = missing_counts(df)
    outliers = column_outliers(df)
    unique = distinct_counts(df, df.columns)
    detail = (
        missing.join(unique.select("column", "unique"), "column", "left")
        .join(outliers.select("column", "outliers"), "column", "left")
        .withColumn("quality", (F.lit(1.0) - F.coalesce(F.try_divide("missing", "rows"), F.lit(0.0))) * 100)
    )
    advice = detail.select(
        "column",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("missing_pct") > 50, "drop or investigate: over half missing"),
                    F.when((F.col("missing_pct") > 0) & (F.col("missing_pct") <= 50), "impute missing values"),
                    F.when(F.col("outliers") > 0, "review outliers"),
                    F.when(F.col("unique") <= 1, "constant column"),
                )
            )
        ).alias("recommendation"),
    )
    return {"scores": scores, "columns": detail, "recommendations": advice, "duplicates": duplicate_rows(df)}


def dataset_statistics(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicated rows of a table."""
    miss = missing_counts(df).agg(F.max("rows").alias("rows"), F.sum("missing").alias("missing_cells")).first()
    dup = duplicate_rows(df).first()["duplicates"]
    n, k = miss["rows"], len(df.columns)
    return df.sparkSession.createDataFrame(
        [(n, k, miss["missing_cells"], 100.0 * miss["missing_cells"] / (n * k) if n else 0.0, dup)],
        "rows long, columns int, missing_cells long, missing_cells_pct double, duplicate_rows long",
    )


def validate_table(df: DataFrame) -> DataFrame:
    """Problems of a table as `(column, issue)` rows."""
    spark = df.sparkSession
    issues = [(c, "duplicate column name") for c in duplicate_columns(df)]
    m = {r["column"]: r for r in missing_counts(df).collect()}
    rows = max((r["rows"] for r in m.values()), default=0)
    if rows == 0:
        issues.append((None, "empty table"))
    for c, r in m.items():
        if rows and r["missing"] == rows:
            issues.append((c, "all values missing"))
        elif rows and r["missing"] > 0.5 * rows:
            issues.append((c, "more than half missing"))
    text = columns_of(df, "categorical")
    if text:
        issues += [(r["column"], "mixed content") for r in mixed_text(df, text).filter("mixed").collect()]
    return spark.createDataFrame(issues, "column string, issue string")


def validate_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite and NaN counts, zero or extreme range.  Run before NaN is turned into NULL."""
    one = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias("infinite"),
                (F.count_if(F.isnan(F.col(c).cast("double")))).alias("nan"),
                F.count_if(F.col(c).isNull()).alias("missing"),
                (F.max(clean_double(c)) - F.min(clean_double(c))).alias("range"),
            ).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )
    rows = one.select(F.explode(F.array(*one.columns)).alias("e")).select("e.*")
    return rows.withColumns({"constant": F.col("range") == 0, "extreme_range": F.col("range") > 1e10})


def validate_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """High cardinality, all-unique and empty-string checks."""
    empties = df.agg(*[F.count_if(F.col(c) == "").alias(f"e{i}") for i, c in enumerate(columns)])
    rows = empties.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"e{i}").alias("empty")) for i, c in enumerate(columns)])).alias("x")
    ).select("x.*")
    counts = distinct_counts(df, columns)
    out = rows.join(counts, "column", "left")
    return out.select(
        "column",
        F.coalesce("unique", F.lit(0)).alias("unique"),
        "unique_ratio",
        (F.col("unique_ratio") > 0.9).alias("high_cardinality"),
        (F.col("unique") == F.col("count")).alias("all_unique"),
        "empty",
    )


