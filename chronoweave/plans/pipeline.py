"""Pipeline: an immutable builder. Every step takes the window, grouping and trigger set before it and returns a new pipeline;
the plan behind it is a DataFrame's."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.errors import PipelineError
from chronoweave.functions import timekeys as tk
from chronoweave.functions.paths import Path, Spec, column, quoted, resolve
from chronoweave.functions.reducers import Reducer, reducer
from chronoweave.operators.series import INDEX, RANGE, Series
from chronoweave.streaming import stateful

EMIT = ("eachEvent", "discard", "flush")
GROUP = "_group"


@dataclass(frozen=True)
class Keyed:
    """Rows with their `_key`; one series per key on demand."""

    series: Series

    @property
    def df(self) -> DataFrame:
        return self.series.df

    def keys(self) -> list[str]:
        return sorted(r["_key"] for r in self.df.select("_key").distinct().collect())

    def __getitem__(self, key: str) -> Series:
        return self.series.with_df(self.df.where(F.col("_key") == key).drop("_key"))

    def items(self) -> Iterator[tuple[str, Series]]:
        for k in self.keys():
            yield k, self[k]

    def sizes(self) -> DataFrame:
        return self.df.groupBy("_key").agg(F.count(F.lit(1)).alias("size"))


@dataclass
class Output:
    """Where rows go; `on_emit` replaces the function, also while a stream runs."""

    callback: Callable[[dict], None]
    observer: Callable[[int | None], None] | None = None
    query: Any = None

    def on_emit(self, callback: Callable[[dict], None]) -> Output:
        self.callback = callback
        return self

    def give(self, s: Series) -> None:
        n = 0
        for e in s.iterate():
            self.callback(e)
            n += 1
        if self.observer is not None:
            self.observer(n or None)


@dataclass(frozen=True)
class Pipeline:
    """See the module."""

    source: Series | None = None
    window_kind: str = "global"
    window_duration: str | None = None
    tz: str = "UTC"
    group: Path | Column | Callable | None = None
    emit: str = "eachEvent"

    # state

    @property
    def mode(self) -> str | None:
        return None if self.source is None else "stream" if self.source.df.isStreaming else "batch"

    def from_source(self, source: Series | Pipeline) -> Pipeline:
        """Rows to work on: a series, a streaming series, or what another pipeline gives."""
        if isinstance(source, Pipeline):
            source = source.series()
        if not isinstance(source, Series):
            raise PipelineError(f"not a source: {type(source).__name__}")
        return replace(self, source=source)

    def series(self) -> Series:
        if self.source is None:
            raise PipelineError("the pipeline has no source")
        return self.source

    def window_by(self, window: str | tuple[str, str | None] | None = None, tz: str | None = None) -> Pipeline:
        """'30s', '5m', '1h', '1d' ..: fixed windows from the epoch (UTC); 'daily', 'monthly', 'yearly': of a time zone; None: one
        window for all. A pair gives kind and duration."""
        if isinstance(window, tuple):
            kind, duration = window
            if kind not in ("fixed", "global", *tk.CALENDAR):
                raise PipelineError(f"no such window: {kind!r}")
            return replace(self, window_kind=kind, window_duration=duration, tz=tz or "UTC")
        if window is None:
            return self.clear_window()
        if window in tk.CALENDAR:
            return replace(self, window_kind=window, window_duration=None, tz=tz or "UTC")
        tk.need_duration(window)
        if tz not in (None, "UTC"):
            raise PipelineError("fixed windows are counted in UTC")
        return replace(self, window_kind="fixed", window_duration=window, tz="UTC")

    def clear_window(self) -> Pipeline:
        return replace(self, window_kind="global", window_duration=None, tz="UTC")

    def group_by(self, key: Path | Column | Callable = None) -> Pipeline:
        """A column path or an expression whose values part the rows; null is a group of its own. None: no grouping. A Python
        function of the payload (a dict) gives a text, over Arrow batches."""
        return replace(self, group=key)

    def clear_group_by(self) -> Pipeline:
        return replace(self, group=None)

    def emit_on(self, trigger: str) -> Pipeline:
        """When a stream's windows are emitted: whenever they change, when they are complete, or at the end."""
        if trigger not in EMIT:
            raise PipelineError(f"no such trigger: {trigger!r}; there are {', '.join(EMIT)}")
        return replace(self, emit=trigger)

    # keys

    def window_key(self) -> Column:
        return tk.window_key(F.col("_t"), self.window_kind, self.window_duration, self.tz)

    def group_key(self) -> Column:
        s = self.series()
        if self.group is None:
            return F.lit(None).cast("string")
        if isinstance(self.group, Column):
            return self.group
        if callable(self.group):
            f = self.group

            def key(rows: pa.Array) -> pa.Array:
                return pa.array([None if (v := f(row)) is None else str(v) for row in rows.to_pylist()], pa.string())

            return F.arrow_udf(key, "string")(F.struct(*[F.col(quoted((c,))) for c in s.columns()]))
        path = resolve(s.df, self.group)
        return F.col(GROUP) if path[0] not in s.df.columns and GROUP in s.df.columns else column(s.df, path)

    # steps

    def _then(self, s: Series) -> Pipeline:
        return replace(self, source=s)

    def map(self, op: Callable[[DataFrame], DataFrame] | Mapping[str, Column]) -> Pipeline:
        return self._then(self.series().map(op))

    def filter(self, op: Column | Callable) -> Pipeline:
        return self._then(self.series().filter(op))

    def select(self, fields: Spec = None) -> Pipeline:
        return self._then(self.series().select(fields))

    def collapse(self, fields: Spec, name: str, how: Reducer | str, append: bool = True) -> Pipeline:
        return self._then(self.series().collapse(fields, name, how, append))

    def offset_by(self, by: float, fields: Spec = None) -> Pipeline:
        return self._then(self.series().offset_by(by, fields))

    def fill(self, fields: Spec = None, method: str = "zero", fill_limit: int | None = None, flush_after: str | None = None) -> Pipeline:
        """See `Series.fill`; of a stream, by state per series (`flush_after`: see `stream_fill`)."""
        if self.mode == "stream":
            return self._then(stateful.stream_fill(self.series(), fields, method, fill_limit, flush_after))
        return self._then(self.series().fill(fields, method, fill_limit))

    def align(self, fields: Spec = None, window: str = "5m", method: str = "linear", limit: int | None = None) -> Pipeline:
        if self.mode == "stream":
            return self._then(stateful.stream_align(self.series(), fields, window, method, limit))
        return self._then(self.series().align(fields, window, method, limit))

    def rate(self, fields: Spec = None, allow_negative: bool = True) -> Pipeline:
        if self.mode == "stream":
            return self._then(stateful.stream_rate(self.series(), fields, allow_negative))
        return self._then(self.series().rate(fields, allow_negative))

    def as_events(self, alignment: str = "center") -> Pipeline:
        return self._then(self.series().as_events(alignment))

    def as_time_ranges(self, duration: str | None = None, alignment: str = "center") -> Pipeline:
        return self._then(self.series().as_time_ranges(duration, alignment))

    def as_indexed(self, duration: str | None = None) -> Pipeline:
        return self._then(self.series().as_indexed(duration))

    def take(self, limit: int) -> Pipeline:
        """The first rows by arrival, per window and group. Without either that is a top-k; with them, the window function is cut
        to `limit` rows per group before the shuffle."""
        s = self.series()
        if self.mode == "stream":
            keyed = replace(s.with_df(s.df.withColumn("_wk", self.window_key()).withColumn("_gk", self.group_key().cast("string"))), by=("_wk", "_gk"))
            taken = stateful.stream_take(keyed, limit)
            return self._then(replace(taken.with_df(taken.df.drop("_wk", "_gk")), by=s.by))
        if self.window_kind == "global" and self.group is None:
            return self._then(s.with_df(s.df.orderBy("_ord").limit(limit)))
        w = Window.partitionBy(self.window_key(), self.group_key()).orderBy("_ord")
        return self._then(s.with_df(s.df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")))

    def aggregate(self, fields: Mapping[str, Mapping[str, Reducer | str] | Reducer | str]) -> Pipeline:
        """{out: {path: reducer}} or {path: reducer}: one row per window and group.

        Rows of windows are keyed by the window's index, those of the global window by the range of their times. The group's
        key stays as column `_group`.
        """
        s = self.series()
        outs = []
        for out, how in fields.items():
            pairs = list(how.items()) if isinstance(how, Mapping) else [(out, how)]
            if len(pairs) != 1:
                raise PipelineError(f"{out}: an aggregate has exactly one input")
            path, r = pairs[0]
            c, k, _ = s._field(path)
            outs.append(reducer(r).over_rows(c, k, s._order()).alias(out))
        if s.df.isStreaming:
            from chronoweave.streaming.aggregate import stream_windows

            return self._then(stream_windows(self, s, outs))
        lo, hi = F.min("_t").alias("_t"), F.max(s.end()).alias("_e")
        first = F.min(s._order()).alias("_ord")
        if self.window_kind == "global":
            df = s.df.groupBy(self.group_key().alias(GROUP)).agg(lo, hi, first, *outs)
            return self._then(s.with_df(df.where("_t is not null"), RANGE))
        df = s.df.groupBy(self.window_key().alias("_k"), self.group_key().alias(GROUP)).agg(first, *outs)
        b, e = tk.index_range(F.col("_k"), self.tz)
        return self._then(replace(s.with_df(df.withColumn("_t", b).withColumn("_e", e), INDEX), by=()))

    # outputs

    def keyed(self) -> Keyed:
        """Rows with `_key`: 'window--group', the window, the group, or 'all'."""
        s = self.series()
        group = self.group_key().cast("string")
        if self.window_kind == "global":
            key = F.coalesce(group, F.lit("all"))
        else:
            window = F.col("_k") if s.kind == INDEX else self.window_key()
            key = F.concat_ws("--", window, group)
        return Keyed(s.with_df(s.df.withColumn("_key", key)))

    def to_event_list(self) -> list[dict] | None:
        """The rows as Python dicts in order; None if there are none."""
        return self.series().events() or None

    def to(self, callback: Callable[[dict], None], observer: Callable[[int | None], None] | None = None, checkpoint: str | None = None, once: bool = True) -> Output:
        """Every row to a function, in order, streamed to the driver. A batch is given at once; of a stream, each micro-batch as it
        comes (`checkpoint`, `once`: see `start`). The observer gets the number of rows at a batch's end, None for none."""
        out = Output(callback, observer)
        if self.mode == "stream":
            from chronoweave.streaming.aggregate import start

            s = self.series()
            out.query = start(self, lambda df, _: out.give(s.with_df(df)), checkpoint, once)
        else:
            out.give(self.series())
        return out

    def count(self) -> DataFrame:
        """Rows per window and group."""
        s = self.series()
        return s.df.groupBy(self.window_key().alias("window"), self.group_key().cast("string").alias("group")).agg(F.count(F.lit(1)).alias("size"))

    def state(self) -> dict[str, Any]:
        return {"mode": self.mode, "window_type": self.window_kind, "window_duration": self.window_duration, "tz": self.tz, "group_by": self.group, "emit_on": self.emit}


def rollup(s: Series, window: str, fields: Mapping, to_events: bool = False, tz: str = "UTC") -> Series:
    """Fixed ('30s', '1h' ..) or calendar ('daily', 'monthly', 'yearly') windows, aggregated; as points if wanted."""
    p = Pipeline().from_source(s).window_by(window, tz if window in tk.CALENDAR else None).emit_on("discard").aggregate(fields)
    return (p.as_events() if to_events else p).clear_window().series()


def collect_by_window(s: Series, window: str) -> Keyed:
    """The rows of every fixed window as a series of their own."""
    return Pipeline().from_source(s).window_by(window).keyed()
