"""Writers for features and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One directory of part files, written by the executors in parallel."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_forecast(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """``Date, Revenue, COGS`` in one sub-directory per forecast variant."""
    writer = df.write.mode("overwrite").partitionBy("variant").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
