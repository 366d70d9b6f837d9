"""Table writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def export(
    df: DataFrame,
    path: str,
    file_type: str = "csv",
    *,
    columns: Sequence[str] | None = None,
    compression: str | None = None,
    encoding: str | None = None,
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
) -> None:
    """Write CSV, JSON lines or Parquet as a folder of part files."""
    if file_type not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported export format: {file_type}")
    out = (df.select(*columns) if columns else df).write.mode(mode)
    if partition_by:
        out = out.partitionBy(*partition_by)
    if compression:
        out = out.option("compression", compression)
    if encoding and file_type != "parquet":
        out = out.option("encoding", encoding)
    if file_type == "csv":
        out = out.option("header", True)
    out.format(file_type).save(path)
