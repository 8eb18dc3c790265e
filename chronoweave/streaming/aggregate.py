"""Windowed aggregation of streams, and running it.

The triggers map to output modes: 'eachEvent' to update (rows of changed windows; the last per key counts), 'discard' to
append (a window comes once, when the watermark has passed it; later rows are dropped), 'flush' to complete (all windows
whenever a batch ends; with an available-now trigger, once at the end). Only 'discard' needs a watermark and gets one
where the caller set none, so `emit_on` goes before `aggregate`; with the others a late row joins its window, and all
windows stay in the state, unless the caller sets a watermark.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronoweave.errors import PipelineError
from chronoweave.functions import timekeys as tk
from chronoweave.operators.series import END, INDEX, Series

if TYPE_CHECKING:
    from chronoweave.plans.pipeline import Pipeline

MODES = {"eachEvent": "update", "discard": "append", "flush": "complete"}


def with_watermark(s: Series, delay: str = "0 seconds") -> Series:
    """Late rows, more than `delay` behind the latest time seen, may be dropped from here on."""
    df = s.df.withColumn("_wm", F.timestamp_millis("_t")).withWatermark("_wm", delay)
    return s.with_df(df)


def stream_windows(p: Pipeline, s: Series, outs: list[Column]) -> Series:
    """The aggregate of a streaming series per window and group. Calendar windows of months and years have no end that a
    watermark could pass, so they need another trigger than 'discard'; so does the global window."""
    group = p.group_key().alias("_group")
    fixed = p.window_kind == "fixed" or (p.window_kind == "daily" and p.tz == "UTC")
    if not fixed and p.emit == "discard":
        raise PipelineError(f"{p.window_kind} windows of a stream cannot be emitted on 'discard'")
    first = F.min(s._order()).alias("_ord")
    if END in s.df.columns:
        s = s.with_df(s.df.where(~F.col(END)))
    if fixed:
        if "_wm" not in s.df.columns:
            s = with_watermark(s) if p.emit == "discard" else s.with_df(s.df.withColumn("_wm", F.timestamp_millis("_t")))
        d = 86_400_000 if p.window_kind == "daily" else tk.need_duration(p.window_duration)
        df = s.df.groupBy(F.window("_wm", f"{d} milliseconds").alias("_w"), group).agg(first, *outs)
        at = F.unix_millis(F.col("_w")["start"])
        key = tk.calendar_key(at, "daily") if p.window_kind == "daily" else tk.index_string(at, p.window_duration)
        df = df.withColumn("_k", key).drop("_w")
    else:
        df = s.df.groupBy(p.window_key().alias("_k"), group).agg(first, *outs)
    b, e = tk.index_range(F.col("_k"), p.tz)
    if p.window_kind == "global":
        b = e = F.lit(None).cast("long")
    return replace(s.with_df(df.withColumn("_t", b).withColumn("_e", e), INDEX), by=())


def start(p: Pipeline, sink: str | Callable[[DataFrame, int], None], checkpoint: str | None = None, once: bool = True, mode: str | None = None) -> StreamingQuery:
    """Starts a stream pipeline into a memory table (by name) or a function of every micro-batch.

    once: process what is there and stop, else keep running. `checkpoint` is a folder that all executors share; with it a
    restarted query goes on where the last one was.
    """
    if p.mode != "stream":
        raise PipelineError("only pipelines over a stream can be started")
    df = p.series().df
    if END in df.columns:
        df = df.where(~F.col(END)).drop(END)
    w = df.drop("_wm").writeStream.outputMode(mode or MODES[p.emit])
    w = w.foreachBatch(sink) if callable(sink) else w.format("memory").queryName(sink)
    if checkpoint is not None:
        w = w.option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
