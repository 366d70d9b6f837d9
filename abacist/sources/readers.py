"""Table readers."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from abacist.functions.columns import column_types, missing, nan_to_null

DELIMITERS = (",", "\t", ";", "|")


def load(spark: SparkSession, path: str, file_type: str, **options) -> DataFrame:
    """Read a table by format name; unknown formats are an error."""
    readers = {
        "csv": read_csv,
        "json": read_json,
        "parquet": read_parquet,
        "dta": read_stata,
        "stata": read_stata,
        "sas7bdat": read_sas,
        "sas": read_sas,
        "xpt": read_sas,
    }
    kind = file_type.lower().lstrip(".")
    if kind not in readers:
        raise ValueError(f"unsupported file type: {file_type}")
    return readers[kind](spark, path, **options)


def read_csv(
    spark: SparkSession,
    path: str,
    *,
    schema: StructType | str | None = None,
    delimiter: str = ",",
    encoding: str = "utf-8",
    has_header: bool = True,
    na_values: Sequence[str] = (),
    timestamp_format: str | None = None,
    **options: str,
) -> DataFrame:
    """CSV with pandas-like options.  Give a schema for large inputs: inference reads twice."""
    reader = (
        spark.read.option("header", has_header).option("sep", delimiter).option("encoding", encoding).option("mode", "PERMISSIVE")
    )
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format)
    reader = reader.options(**options)
    if na_values:
        # Several null spellings: read as text, blank them out, then type the columns.
        text = reader.csv(path)
        marks = [F.when(~F.col(f"`{c}`").isin(list(na_values)), F.col(f"`{c}`")).alias(c) for c in text.columns]
        text = text.select(*marks)
        if schema is None:
            return text
        target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        return nan_to_null(
            text.select(*[F.col(f"`{c}`").try_cast(f.dataType).alias(f.name) for c, f in zip(text.columns, target.fields)])
        )
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def read_json(spark: SparkSession, path: str, *, orient: str = "records", multi_line: bool = False, schema=None) -> DataFrame:
    """`records`: one object per line (or an array with `multi_line`); `split`: `{columns, data}`."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if orient == "records":
        return nan_to_null(reader.option("multiLine", multi_line).json(path))
    if orient != "split":
        raise ValueError(f"unsupported orient: {orient}")
    raw = spark.read.schema("columns array<string>, data array<array<string>>").option("multiLine", True).json(path)
    names = raw.select("columns").first()["columns"]
    rows = raw.select(F.explode("data").alias("r"))
    return rows.select(*[F.col("r")[i].alias(name) for i, name in enumerate(names)])


def read_parquet(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return nan_to_null(spark.read.options(**options).parquet(path))


def _read_binary_tables(spark: SparkSession, path: str, schema: StructType | str, parse) -> DataFrame:
    """Many statistical-package files at once: each file is parsed inside a task, in row chunks."""
    files = spark.read.format("binaryFile").load(path).select("content")
    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = target.fieldNames()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                for chunk in parse(io.BytesIO(content)):
                    yield chunk[names]

    return nan_to_null(files.mapInPandas(rows, target))


def read_stata(spark: SparkSession, path: str, *, schema: StructType | str, chunk_rows: int = 100_000) -> DataFrame:
    return _read_binary_tables(
        spark, path, schema, lambda f: pd.read_stata(f, chunksize=chunk_rows, convert_categoricals=False)
    )


def read_sas(spark: SparkSession, path: str, *, schema: StructType | str, sas_format: str = "sas7bdat", chunk_rows: int = 100_000) -> DataFrame:
    return _read_binary_tables(
        spark, path, schema, lambda f: pd.read_sas(f, format=sas_format, chunksize=chunk_rows, encoding="utf-8")
    )


def infer_delimiter(spark: SparkSession, path: str, sample_lines: int = 100) -> str:
    """The most frequent of comma, tab, semicolon and bar in the first lines."""
    head = spark.read.text(path).limit(sample_lines)
    v = F.col("value")
    row = head.agg(
        *[F.sum(F.length(v) - F.length(F.replace(v, F.lit(d), F.lit("")))).alias(str(i)) for i, d in enumerate(DELIMITERS)]
    ).first()
    counts = [row[str(i)] or 0 for i in range(len(DELIMITERS))]
    return DELIMITERS[counts.index(max(counts))]


def upload_summary(df: DataFrame) -> DataFrame:
    """One row per column: type, kind, rows and missing values."""
    kinds = column_types(df)
    summed = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(missing(df, c)).alias(f"_m{i}") for i, c in enumerate(df.columns)]
    )
    entries = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(kinds[f.name]).alias("kind"),
            F.col("_rows").alias("rows"),
            F.col(f"_m{i}").alias("missing"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return summed.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
