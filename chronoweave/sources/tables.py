"""Readers of tables: one place that fixes time types and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table `name` of `folder`."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def millis(col: Column | str) -> Column:
    """Whole epoch milliseconds (UTC) of a TIMESTAMP column."""
    return F.unix_millis(F.col(col) if isinstance(col, str) else col)


def ntz_millis(col: Column | str) -> Column:
    """Whole epoch milliseconds of a TIMESTAMP_NTZ column read as UTC, whatever the session's time zone."""
    name = col if isinstance(col, str) else col
    c = F.col(name) if isinstance(name, str) else name
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
