"""A stream that is pushed to: rows go to files of a shared folder, which Structured Streaming reads."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.errors import PipelineError
from chronoweave.functions import timekeys as tk
from chronoweave.functions.paths import quoted
from chronoweave.operators.series import END, TIME, Series
from chronoweave.plans.scale import shared_folder


class PushStream:
    """Rows that are pushed between `start` and `stop`; others are dropped, as nobody listens.

    `add_event` holds rows until `flush`, `stop` or `HELD` of them; `add_rows` writes a whole series at once, in parallel.
    `stop` ends every series with a marker row, on which steps with state give out what they hold back.
    """

    HELD = 10_000

    def __init__(self, spark: SparkSession, schema: T.StructType | str, by: tuple[str, ...] = (), folder: str | None = None) -> None:
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        own = [T.StructField("_t", T.LongType()), T.StructField("_ord", T.LongType()), T.StructField(END, T.BooleanType())]
        lost = [b for b in by if b not in fields.names]
        if lost:
            raise PipelineError(f"no such columns: {lost}")
        self.spark, self.schema, self.by = spark, T.StructType(own + list(fields)), tuple(by)
        self.folder = folder or shared_folder(spark, "push")
        self.running, self._held, self._order = False, [], 0

    def start(self) -> PushStream:
        self.running = True
        return self

    def add_event(self, time: datetime | int, payload: Mapping[str, Any] | Any) -> bool:
        """Whether the row was taken. A plain value stands for {'value': it}."""
        ms, row = tk.to_ms(time), payload if isinstance(payload, Mapping) else {"value": payload}
        if not self.running:
            return False
        self._held.append((ms, self._order, False, *[row.get(n) for n in self.schema.names[3:]]))
        self._order += 1
        if len(self._held) >= self.HELD:
            self.flush()
        return True

    def add_rows(self, s: Series) -> bool:
        """All rows of a series of points, in the order of its own `_ord` (a whole number)."""
        if s.kind != TIME or s.df.isStreaming:
            raise PipelineError("only points in time, and no stream, can be pushed")
        if not self.running:
            return False
        self.flush()
        self._write(s.df.select("_t", F.col("_ord").cast("long").alias("_ord"), F.lit(False).alias(END), *[F.col(quoted((n,))) for n in self.schema.names[3:]]))
        return True

    def flush(self) -> None:
        """Hands over the rows held so far."""
        if self._held:
            self._write(self.spark.createDataFrame(self._held, self.schema))
            self._held = []

    def stop(self) -> None:
        """Hands over what is held and ends every series."""
        if not self.running:
            return
        self.flush()
        self.running = False
        seen = self.spark.read.schema(self.schema).parquet(self.folder) if self._written() else None
        if seen is not None:
            last = seen.groupBy(*self.by).agg(F.max("_t").alias("_t"), F.max("_ord").alias("_ord")).where("_t is not null")
            rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields[3:] if f.name not in self.by]
            self._write(last.select("_t", "_ord", F.lit(True).alias(END), *self.by, *rest).select(*self.schema.names))

    def source(self) -> Series:
        """The pushed rows as a streaming series."""
        self.spark.createDataFrame([], self.schema).write.mode("append").parquet(self.folder)
        return Series(self.spark.readStream.schema(self.schema).parquet(self.folder), TIME, {}, self.by)

    def _write(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.folder)

    def _written(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
