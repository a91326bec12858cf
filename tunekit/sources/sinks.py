"""Writers for study results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    """One text line per row."""
    lines.select(column).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
