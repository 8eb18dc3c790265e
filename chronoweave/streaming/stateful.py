"""Streams of fill, align, rate and take: a step of `steps` per series, its state kept by Structured Streaming.

Rows of a micro-batch are put in time order per series before they reach the step. A row that is earlier than one of a batch
before it is late and is dropped, as its place in the output has gone. Output is in order within a batch. A row whose `_end` is
true (see `push`) ends its series: what waits is given out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import replace
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoweave.errors import PipelineError
from chronoweave.functions import timekeys as tk
from chronoweave.functions.paths import Spec, spec
from chronoweave.operators.series import END, RANGE, TIME, Series
from chronoweave.streaming.steps import AlignStep, FillStep, RateStep, TakeStep


def _plain(v: Any) -> Any:
    return None if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)) else v.item() if hasattr(v, "item") else v


def _run(s: Series, make: Any, data: list[str], fields: list[T.StructField], flush_after: str | None) -> Any:
    """The streaming frame of a step: `_key`, `_t`, then what the step gives."""
    keys = list(s.by) or ["_one"]
    df = s.df if s.by else s.df.withColumn("_one", F.lit(0))
    ends = END in df.columns
    cols = ["_t", "_ord", *([END] if ends else []), *data]
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("_t", T.LongType()), *fields])
    names = [f.name for f in fields]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, latest = pickle.loads(state.get[0])
            out = at.flush()
            state.update((pickle.dumps((at, latest)),))
        else:
            at, latest = pickle.loads(state.get[0]) if state.exists else (make(), None)
            x = pd.concat(list(frames), ignore_index=True).sort_values(["_t", "_ord"], kind="stable")
            ended = ends and bool(x[END].fillna(False).any())
            if ends:
                x = x[~x[END].fillna(False).astype(bool)]
            if latest is not None:
                x = x[x["_t"] >= latest]
            rows = [(int(r[0]), [_plain(v) for v in r[1:]]) for r in x[["_t", *data]].itertuples(index=False)]
            out = at.push(rows) + (at.flush() if ended else [])
            latest = rows[-1][0] if rows else latest
            state.update((pickle.dumps((at, latest)),))
            if flush_after is not None:
                state.setTimeoutDuration(flush_after)
        if out:
            frame = {k: [v] * len(out) for k, v in zip(keys, key, strict=True)}
            frame["_t"] = [t for t, _ in out]
            frame.update({n: [v[i] for _, v in out] for i, n in enumerate(names)})
            yield pd.DataFrame(frame).astype({n: object for n in names})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if flush_after is not None else GroupStateTimeout.NoTimeout
    return df.select(*keys, *cols).groupBy(*keys).applyInPandasWithState(step, schema, "state binary", "append", timeout)


def _numbers(s: Series, fields: Spec) -> list[str]:
    names = [".".join(p) for p in spec(fields)]
    lost = [n for n in names if n not in s.df.columns]
    if lost or not s.df.isStreaming:
        raise PipelineError(f"no top-level columns {lost}" if lost else "not a stream")
    return names


def _done(s: Series, df: Any, kind: str = TIME) -> Series:
    return s.with_df(df.drop("_one").withColumn("_ord", F.col("_t")), kind)


def stream_fill(s: Series, fields: Spec = None, method: str = "zero", fill_limit: int | None = None, flush_after: str | None = None) -> Series:
    """Fills a stream. Linear gaps wait for the next valid value; after `flush_after` (a processing time such as '10 seconds')
    without rows of the series, what waits is given out unfilled. A fill limit bounds what waits."""
    names = _numbers(s, fields)
    data = s.columns()
    data = [c for c in data if c not in s.by]
    at = [data.index(n) for n in names]
    out = [T.StructField(c, T.DoubleType() if method == "linear" and c in names else s.df.schema[c].dataType) for c in data]
    return _done(s, _run(s, lambda: FillStep(at, method, fill_limit), data, out, flush_after))


def stream_align(s: Series, fields: Spec = None, window: str = "5m", method: str = "linear", limit: int | None = None) -> Series:
    """Aligns a stream."""
    names = _numbers(s, fields)
    d = tk.need_duration(window)
    out = [T.StructField(n, s.df.schema[n].dataType if method == "hold" else T.DoubleType()) for n in names]
    return _done(s, _run(s, lambda: AlignStep(d, method, limit), names, out, None))


def stream_rate(s: Series, fields: Spec = None, allow_negative: bool = True) -> Series:
    """The rates of a stream."""
    names = _numbers(s, fields)
    out = [T.StructField("_p", T.LongType())] + [T.StructField(f"{n}_rate", T.DoubleType()) for n in names]
    df = _run(s, lambda: RateStep(allow_negative), names, out, None)
    return replace(_done(s, df.withColumn("_e", F.col("_t")).withColumn("_t", F.col("_p")).drop("_p"), RANGE))


def stream_take(s: Series, limit: int) -> Series:
    """The first rows of every series of a stream."""
    data = [c for c in s.columns() if c not in s.by]
    return _done(s, _run(s, lambda: TakeStep(limit), data, [s.df.schema[c] for c in data], None))
