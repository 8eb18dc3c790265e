"""Streaming sources."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from chronoweave.operators.series import Series


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, format: str = "parquet", files_per_batch: int | None = None, **series: Any) -> Series:
    """The files of a folder, as they come, as a streaming series; `series` are the arguments of `Series.from_frame`."""
    r = spark.readStream.schema(schema).format(format)
    if files_per_batch is not None:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return Series.from_frame(r.load(path), **series)
