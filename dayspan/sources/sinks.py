"""Writers for stage tables and name lists."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", null_value: str = "NA",
                mode: str = "overwrite") -> None:
    """Write a stage as Parquet, CSV with header (nulls as ``null_value``), JSON or text (one column)."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.options(header=True, nullValue=null_value, emptyValue="", escape='"').csv(path)
    elif fmt == "text":
        if len(df.columns) != 1:
            raise ValueError("a text list has exactly one column")
        writer.text(path)
    elif fmt in ("parquet", "json"):
        writer.format(fmt).save(path)
    else:
        raise ValueError(f"unknown format {fmt}")
