"""Series: a DataFrame of events with a time key, a stable order, and metadata.

Internal columns begin with an underscore: `_t` (epoch milliseconds; the begin of a range or index), `_e` (end, for ranges
and indexes), `_k` (index string) and `_ord` (order of arrival). Everything else is data. An optional list of `by` columns
names the series that one frame holds; without it the frame is one series. All methods are lazy unless they return Python
values, and none changes the frame.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime
from fractions import Fraction
from functools import reduce as fold
from typing import TYPE_CHECKING, Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chronoweave.errors import FieldError, PipelineError, SeriesError, TimeError
from chronoweave.functions import timekeys as tk
from chronoweave.functions.paths import Path, Spec, column, need, put, quoted, resolve, spec, type_at
from chronoweave.functions.reducers import Reducer, reducer
from chronoweave.functions.validity import as_number, numeric, valid
from chronoweave.operators.neighbours import POS, add_neighbours, drop_neighbours

if TYPE_CHECKING:
    from chronoweave.plans.pipeline import Pipeline

TIME, RANGE, INDEX = "time", "timerange", "index"
#: Of pushed streams: whether a row is no event, but ends its series.
END = "_end"
INTERNAL = ("_t", "_e", "_k", "_ord", END)

#: Rows of one series are processed in time buckets of this length, so that a hot series is no task of its own; None: at once.
SPLIT_MS = 86_400_000

#: A pair of readings that is far apart is expanded in blocks of so many grid times.
GRID_BLOCK = 4096


@dataclass(frozen=True)
class TimeRange:
    """An ordered pair of epoch milliseconds."""

    begin: int
    end: int

    @classmethod
    def of(cls, *args: Any) -> TimeRange:
        """From two times, a pair of them, or another range; both of one kind, and not reversed."""
        if len(args) == 1 and isinstance(args[0], TimeRange):
            return args[0]
        pair = list(args[0]) if len(args) == 1 and isinstance(args[0], (list, tuple)) else list(args)
        if len(pair) != 2 or type(pair[0]) is not type(pair[1]):
            raise TimeError(f"a range needs two times of one kind: {args!r}")
        b, e = map(tk.to_ms, pair)
        if e < b:
            raise TimeError("a range must not end before it begins")
        return cls(b, e)

    def contains(self, other: TimeRange | datetime | int) -> bool:
        if isinstance(other, TimeRange):
            return self.begin <= other.begin and self.end >= other.end
        return self.begin <= tk.to_ms(other) <= self.end

    def within(self, other: TimeRange) -> bool:
        return other.contains(self)

    def overlaps(self, other: TimeRange) -> bool:
        """Exactly one end of the other range lies inside this one."""
        return self.contains(other.begin) != self.contains(other.end)

    def disjoint(self, other: TimeRange) -> bool:
        return self.end < other.begin or self.begin > other.end

    def extents(self, other: TimeRange) -> TimeRange:
        return TimeRange(min(self.begin, other.begin), max(self.end, other.end))

    def intersection(self, other: TimeRange) -> TimeRange | None:
        return None if self.disjoint(other) else TimeRange(max(self.begin, other.begin), min(self.end, other.end))

    def duration(self) -> int:
        return self.end - self.begin

    def with_begin(self, t: datetime | int) -> TimeRange:
        return TimeRange.of(tk.to_ms(t), self.end)

    def with_end(self, t: datetime | int) -> TimeRange:
        return TimeRange.of(self.begin, tk.to_ms(t))

    def to_json(self) -> list[int]:
        return [self.begin, self.end]

    def text(self, tz: str = "UTC") -> str:
        # Fixed value: the format of a time as text.
        form = "%a, %d %b %Y %H:%M:%S %Z"
        return f"[{tk.from_ms(self.begin, tz).strftime(form)}, {tk.from_ms(self.end, tz).strftime(form)}]"

    def humanize_duration(self) -> str:
        """'12 hours', 'a day' and the like: the largest unit that fits, rounded."""
        s = self.duration() / 1000
        for size, one, many in ((31_536_000, "a year", "years"), (2_592_000, "a month", "months"), (86_400, "a day", "days"), (3_600, "an hour", "hours"), (60, "a minute", "minutes")):
            if s >= size:
                n = int(s // size)
                return one if n == 1 else f"{n} {many}"
        return "now" if s < 1 else f"{int(s)} seconds"

    def relative_text(self, now: datetime | int) -> str:
        def ago(ms: int) -> str:
            d = tk.to_ms(now) - ms
            words = TimeRange(0, abs(d)).humanize_duration()
            return words if words == "now" else f"{words} ago" if d > 0 else f"in {words}"

        return f"{ago(self.begin)} to {ago(self.end)}"


@dataclass(frozen=True)
class Index:
    """An index string: '5m-4754394', '2014-09-17', '2014-09' or '2014'; a bad one raises when its range is asked for."""

    text: str
    tz: str = "UTC"

    def timerange(self) -> TimeRange:
        return TimeRange(*tk.range_of_index(self.text, self.tz))

    def begin(self) -> int:
        return self.timerange().begin

    def end(self) -> int:
        return self.timerange().end

    def to_json(self) -> str:
        return self.text

    def nice(self, form: str | None = None) -> str:
        """'September 17 2014', 'September', '2014', or the text; `form` is a format of strftime."""
        if "-" in self.text and tk.duration_ms(self.text):
            return self.text
        begin = tk.from_ms(self.begin(), self.tz)
        if form is not None:
            return begin.strftime(form)
        return (begin.strftime("%Y"), begin.strftime("%B"), f"{begin:%B} {begin.day} {begin.year}")[self.text.count("-")]

    @staticmethod
    def of(duration: str, t: datetime | int) -> Index:
        """The index of the window of a duration that holds a time."""
        return Index(f"{duration}-{int(tk.to_ms(t) / tk.need_duration(duration))}")

    @staticmethod
    def all_of(duration: str, span: TimeRange) -> list[str]:
        """All index strings of a range, both ends included."""
        d = tk.need_duration(duration)
        return [f"{duration}-{p}" for p in range(int(span.begin / d), int(span.end / d) + 1)]


def last_days(n: int, now: datetime) -> TimeRange:
    """The range of n days that ends now."""
    end = tk.to_ms(now)
    return TimeRange(end - n * tk.UNIT_MS["d"], end)


def last_month(now: datetime) -> TimeRange:
    """The range from the same day a month ago (or that month's last day) to now."""
    y, m = divmod(now.year * 12 + now.month - 2, 12)
    for day in range(now.day, 27, -1):
        try:
            return TimeRange(tk.to_ms(now.replace(year=y, month=m + 1, day=day)), tk.to_ms(now))
        except ValueError:
            continue
    return TimeRange(tk.to_ms(now.replace(year=y, month=m + 1)), tk.to_ms(now))


@dataclass(frozen=True)
class Series:
    """See the module."""

    df: DataFrame
    kind: str = TIME
    meta: Mapping[str, Any] = field(default_factory=dict)
    by: tuple[str, ...] = ()
    split_ms: int | None = None
    tz: str = "UTC"

    # building

    @classmethod
    def from_frame(cls, df: DataFrame, time: Column | str | None = None, begin: Column | str | None = None, end: Column | str | None = None, index: Column | str | None = None, order: Column | str | None = None, by: tuple[str, ...] | list[str] = (), meta: Mapping[str, Any] | None = None, split_ms: int | None = SPLIT_MS, tz: str = "UTC", span: TimeRange | None = None) -> Series:
        """A series of the rows of a DataFrame: give `time`, or `begin` and `end`, or `index`.

        `span` keeps the rows whose time (or begin) lies in a range, both ends included, by a condition on the given column
        itself, so that it reaches the scan.

        Times are TIMESTAMP (an instant), TIMESTAMP_NTZ (read as UTC) or whole milliseconds; microseconds are cut. `order`
        breaks ties in time and should be unique per series; without it the order of arrival in the scan does. Time columns
        given by name leave the data. Data columns must not begin with an underscore of this class.
        """
        clash = [c for c in df.columns if c in INTERNAL]
        if clash:
            raise SeriesError(f"columns {clash} clash with the series' own")

        def ms(c: Column | str) -> Column:
            col = F.col(f"`{c}`") if isinstance(c, str) else c
            kind = df.select(col.alias("c")).schema["c"].dataType
            if isinstance(kind, T.TimestampType):
                return F.unix_millis(col)
            if isinstance(kind, T.TimestampNTZType):
                return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col)
            if isinstance(kind, T.IntegralType):
                return col.cast("long")
            raise TimeError(f"not a time column: {kind.simpleString()}")

        if span is not None:
            if time is None and begin is None:
                raise SeriesError("a span needs a time column")
            source = time if time is not None else begin
            at = F.col(f"`{source}`") if isinstance(source, str) else source
            kind = df.select(at.alias("c")).schema["c"].dataType
            if isinstance(kind, T.TimestampType):
                lo, hi = (F.timestamp_millis(F.lit(x)) for x in (span.begin, span.end + 1))
            elif isinstance(kind, T.TimestampNTZType):
                lo, hi = (F.timestamp_add("MILLISECOND", F.lit(x), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")) for x in (span.begin, span.end + 1))
            else:
                lo, hi = F.lit(span.begin), F.lit(span.end + 1)
            df = df.where((at >= lo) & (at < hi))
        rank = F.monotonically_increasing_id() if order is None else F.col(f"`{order}`") if isinstance(order, str) else order
        gone = {c for c in (time, begin, end, index) if isinstance(c, str)}
        data = [F.col(f"`{c}`") for c in df.columns if c not in gone]
        if index is not None:
            k = F.col(f"`{index}`") if isinstance(index, str) else index
            b, e = tk.index_range(k, tz)
            keys, kind = [b.alias("_t"), e.alias("_e"), k.alias("_k")], INDEX
        elif begin is not None and end is not None:
            keys, kind = [ms(begin).alias("_t"), ms(end).alias("_e")], RANGE
        elif time is not None:
            keys, kind = [ms(time).alias("_t")], TIME
        else:
            raise SeriesError("a series needs time, begin and end, or index")
        return cls(df.select(*keys, rank.alias("_ord"), *data), kind, dict(meta or {}), tuple(by), split_ms, tz)

    def pipeline(self) -> Pipeline:
        """A pipeline over this series."""
        from chronoweave.plans.pipeline import Pipeline

        return Pipeline().from_source(self)

    def add_event(self, key: datetime | int | str | TimeRange, payload: Mapping[str, Any] | Any) -> Series:
        """This series with one more row, which arrived last. A plain value stands for {'value': it}; fields that the series does
        not have are an error, those that are not given are null."""
        row = payload if isinstance(payload, Mapping) else {"value": payload}
        lost = [n for n in row if n not in self.columns()]
        if lost:
            raise FieldError(f"no such columns: {lost}")
        if self.kind == INDEX:
            head = {"_k": key} | dict(zip(("_t", "_e"), tk.range_of_index(str(key), self.tz), strict=True))
        elif self.kind == RANGE:
            span = TimeRange.of(key)
            head = {"_t": span.begin, "_e": span.end}
        else:
            head = {"_t": tk.to_ms(key)}
        fields = [self.df.schema[c] for c in (*self.keys, *self.columns())]
        new = self.df.sparkSession.createDataFrame([tuple((head | dict(row)).get(f.name) for f in fields)], T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
        return self._arrived(new.withColumn("_ord", F.lit(0)))

    def add_events(self, other: Series) -> Series:
        """This series with the rows of another after its own, in the order of theirs."""
        if other.kind != self.kind:
            raise SeriesError("series of different kinds cannot be combined")
        return self._arrived(other.df)

    def _arrived(self, more: DataFrame) -> Series:
        own = self.df.withColumn("_ord", F.struct(F.lit(0).alias("src"), F.struct("_ord").alias("a"), F.lit(None).cast(more.schema["_ord"].dataType).alias("b")))
        new = more.withColumn("_ord", F.struct(F.lit(1).alias("src"), F.lit(None).cast(T.StructType([self.df.schema["_ord"]])).alias("a"), F.col("_ord").alias("b")))
        return self.with_df(own.unionByName(new, allowMissingColumns=True))

    def set_events(self, df: DataFrame | Series | None) -> Series:
        """Other rows in place of this series' own, under its metadata; None for no rows."""
        return self.with_rows(df if df is None or isinstance(df, Series) else self.with_df(df))

    def empty(self) -> Series:
        return self.with_df(self.df.limit(0))

    def with_df(self, df: DataFrame, kind: str | None = None) -> Series:
        return replace(self, df=df, kind=kind or self.kind)

    # metadata and accessors

    @property
    def name(self) -> str:
        return self.meta.get("name", "")

    def with_name(self, name: str) -> Series:
        return self.with_meta("name", name)

    def with_meta(self, key: str, value: Any) -> Series:
        return replace(self, meta={**self.meta, key: value})

    @property
    def is_utc(self) -> bool:
        return bool(self.meta.get("utc", True))

    @property
    def index_text(self) -> str | None:
        return self.meta.get("index")

    def index_range(self) -> TimeRange | None:
        return TimeRange(*tk.range_of_index(self.meta["index"], self.tz)) if self.meta.get("index") else None

    @property
    def keys(self) -> list[str]:
        return {TIME: ["_t"], RANGE: ["_t", "_e"], INDEX: ["_t", "_e", "_k"]}[self.kind]

    def columns(self) -> list[str]:
        """The data columns (top level)."""
        return [c for c in self.df.columns if c not in INTERNAL]

    def with_rows(self, other: Series | None) -> Series:
        """Other rows under this series' metadata; None for no rows."""
        return self.empty() if other is None else replace(other, meta=self.meta)

    def key(self) -> Column:
        """The key as text: milliseconds, 'begin,end', or the index."""
        if self.kind == INDEX:
            return F.col("_k")
        return F.col("_t").cast("string") if self.kind == TIME else F.concat_ws(",", F.col("_t").cast("string"), F.col("_e").cast("string"))

    def begin(self) -> Column:
        return F.col("_t")

    def end(self) -> Column:
        return F.col("_t") if self.kind == TIME else F.col("_e")

    def _field(self, path: Path) -> tuple[Column, T.DataType, tuple[str, ...]]:
        p = resolve(self.df, path)
        c = need(self.df, p)
        return c, type_at(self.df.schema, p), p

    def value(self, path: Path = None) -> Column:
        """The column at a path; null where there is none."""
        return column(self.df, resolve(self.df, path))

    # projection, filter, map

    def select(self, fields: Spec = None) -> Series:
        """Keeps the listed paths; a nested one gets its path as name. Missing columns are null."""
        picked = [column(self.df, resolve(self.df, list(p) if len(p) > 1 else p[0])).alias(".".join(p)) for p in spec(fields)]
        return self.with_df(self.df.select(*self.keys, "_ord", *[c for c in self.by if c not in [".".join(p) for p in spec(fields)]], *picked))

    def set_data(self, **columns: Column) -> Series:
        """Replaces the data, keeping the keys."""
        return self.with_df(self.df.select(*self.keys, "_ord", *self.by, *[c.alias(n) for n, c in columns.items()]))

    def rename(self, names: Mapping[str, str]) -> Series:
        """Renames top-level columns; one that does not exist is an error."""
        lost = [n for n in names if n not in self.columns()]
        if lost:
            raise FieldError(f"no such columns: {lost}")
        return replace(self.with_df(self.df.withColumnsRenamed(dict(names))), by=tuple(names.get(b, b) for b in self.by))

    def collapse(self, fields: Spec, name: str, how: Reducer | str, append: bool = True) -> Series:
        """Reduces some columns of each row into a new one; without `append` only the new one stays."""
        parts = [self._field(list(p) if len(p) > 1 else p[0]) for p in spec(fields)]
        out = reducer(how).over_columns([c for c, _, _ in parts], [k for _, k, _ in parts])
        return self.with_df(self.df.withColumn(name, out)) if append else self.set_data(**{name: out})

    def offset_by(self, by: float, fields: Spec = None) -> Series:
        """Adds a constant to the selected columns; others are dropped."""
        s = self.select(fields)
        names = [".".join(p) for p in spec(fields)]
        return s.with_df(s.df.withColumns({n: F.col(quoted((n,))) + F.lit(by) for n in names}))

    def map(self, op: Callable[[DataFrame], DataFrame] | Mapping[str, Column]) -> Series:
        """Columns to add or replace, or a function DataFrame -> DataFrame that keeps the internal columns."""
        df = self.df.withColumns(dict(op)) if isinstance(op, Mapping) else op(self.df)
        lost = [c for c in (*self.keys, "_ord") if c not in df.columns]
        if lost:
            raise PipelineError(f"the mapping lost {lost}")
        return self.with_df(df)

    def map_rows(self, op: Callable[[dict], dict], schema: T.StructType | str) -> Series:
        """A Python function payload -> payload, in Arrow batches; `schema` describes the new payload."""
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        keep = [*self.keys, "_ord", *[b for b in self.by if b not in fields.names]]
        data = self.columns()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in frames:
                rows = [op(dict(zip(data, r, strict=True))) for r in x[data].itertuples(index=False)]
                yield pd.concat([x[keep].reset_index(drop=True), pd.DataFrame([{n: r.get(n) for n in fields.names} for r in rows], columns=fields.names)], axis=1)

        out = T.StructType([self.df.schema[c] for c in keep] + list(fields))
        return self.with_df(self.df.mapInPandas(run, out))

    def filter(self, op: Column | Callable) -> Series:
        """Keeps rows where a condition holds; a Python function gets the payload as a dict (slow path)."""
        if isinstance(op, Column):
            return self.with_df(self.df.where(op))
        if not callable(op):
            raise PipelineError("a filter is a condition or a function")
        data = self.columns()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in frames:
                yield x[[bool(op(dict(zip(data, r, strict=True)))) for r in x[data].itertuples(index=False)]]

        return self.with_df(self.df.mapInPandas(run, self.df.schema))

    def clean(self, path: Path = None) -> Series:
        """Keeps rows whose value is valid."""
        c, k, _ = self._field(path)
        return self.with_df(self.df.where(valid(c, k)))

    # position, order, range

    def positions(self) -> DataFrame:
        """The rows with `_pos`, their 0-based position in order of arrival within a series.

        With `split_ms` the numbering is two-phase by time bucket, for series in time order.
        """
        if self.split_ms is not None:
            x = add_neighbours(self.df, list(self.by), "_t", "_ord", {}, self.split_ms)
            return x.withColumn("_pos", F.col(POS) - 1).drop(POS)
        w = Window.partitionBy(*self.by).orderBy("_ord") if self.by else Window.partitionBy(F.lit(0)).orderBy("_ord")
        return self.df.withColumn("_pos", F.row_number().over(w).cast("long") - 1)

    def _unplaced(self, x: DataFrame) -> Series:
        return self.with_df(x.drop("_pos"))

    def _with_size(self, x: DataFrame) -> DataFrame:
        """Rows with `_n`, the number of rows of their series."""
        return self._with(x, self.df.groupBy(*self.by).agg(F.count(F.lit(1)).alias("_n")))

    def at(self, i: int) -> Series:
        """The row at a position; negative ones count from the end. Out of range: no row."""
        x = self.positions()
        if i < 0:
            x = self._with_size(x).withColumn("_pos", F.col("_pos") - F.col("_n")).drop("_n")
        return self._unplaced(x.where(F.col("_pos") == i))

    def at_first(self) -> Series:
        return self._extreme(F.min_by)

    def at_last(self) -> Series:
        return self._extreme(F.max_by)

    def _extreme(self, f: Callable) -> Series:
        """First or last row by arrival, as an aggregate: no window over a whole series."""
        cols = self.df.columns
        return self.with_df(self.df.groupBy(*self.by).agg(f(F.struct(*cols), F.col("_ord")).alias("r")).where("r is not null").select("r.*"))

    def bisect(self, t: datetime | int, b: int = 0) -> DataFrame:
        """One row per series: the position of the first row at exactly `t`, else of the last before it, else (all later) the
        one before `b`, but not below 0; searched from position `b`. No row for an empty series."""
        return self._search(self.positions().where(F.col("_pos") >= b), tk.to_ms(t), "pos")

    def _search(self, x: DataFrame, ms: int, name: str) -> DataFrame:
        """The place of a time among positioned rows, one row per series; plain aggregates, so nothing is sorted."""
        exact, later = F.min(F.when(F.col("_t") == ms, F.col("_pos"))), F.min(F.when(F.col("_t") > ms, F.col("_pos")))
        g = x.groupBy(*self.by).agg(exact.alias("_exact"), later.alias("_later"), F.max("_pos").alias("_last")).where("_last is not null")
        hit = F.col("_exact").isNotNull() & (F.col("_later").isNull() | (F.col("_exact") < F.col("_later")))
        found = F.when(hit, F.col("_exact")).when(F.col("_later").isNotNull(), F.greatest(F.col("_later") - 1, F.lit(0))).otherwise(F.col("_last"))
        return g.select(*self.by, found.alias(name))

    def at_time(self, t: datetime | int) -> Series:
        """The row at a time or the last before it; before all, the first."""
        if self.split_ms is None:
            return self._join_positions(self.bisect(t), F.col("_pos") == F.col("pos"))
        row = F.struct("_t", "_ord")
        at = self._with(self.df, self.df.groupBy(*self.by).agg(self._place(tk.to_ms(t), row).alias("_lo")))
        return self.with_df(at.where(row.eqNullSafe(F.col("_lo"))).drop("_lo"))

    @staticmethod
    def _place(ms: int, row: Column) -> Column:
        """Of rows in time order: the first at exactly a time, else the last before it, else the first of all."""
        t = F.col("_t")
        return F.coalesce(F.min(F.when(t == ms, row)), F.max(F.when(t.isNull() | (t < ms), row)), F.min(row))

    def as_of(self, probes: Series) -> DataFrame:
        """For every row of `probes` (a series with the same `by` columns) the row of this one at its time or the last before it,
        else the first: `_t` and the probes' columns, and the row found as struct `found` (null where the series is empty).

        Both sides are put in one time order, so nothing is compared pairwise; of rows of one time the last arrived counts.
        """
        data = F.struct(F.col("_t").alias("t"), *[F.col(quoted((c,))) for c in self.columns() if c not in self.by])
        mine = self.df.select(*self.by, "_t", data.alias("__row"), F.struct(F.lit(0).alias("s"), F.xxhash64("_ord").alias("h")).alias("__o"), F.col("_ord").alias("__mo"))
        theirs = probes.df.select(*self.by, "_t", F.struct(F.lit(1).alias("s"), F.xxhash64("_ord").alias("h")).alias("__o"), F.struct(*[F.col(quoted((c,))) for c in probes.columns() if c not in self.by]).alias("__probe"))
        both = mine.unionByName(theirs, allowMissingColumns=True)
        both = both.withColumn("__o", F.struct(F.col("__o.s").alias("s"), F.col("__mo").alias("m"), F.col("__o.h").alias("h"))).drop("__mo")
        x = add_neighbours(both, list(self.by), "_t", "__o", {"row": F.col("__row")}, self.split_ms).where("__o.s = 1")
        found = F.coalesce(F.col("__prev_row")["v"], F.col("__next_row")["v"])
        return x.select(*self.by, "_t", "__probe.*", found.alias("found"))

    def slice(self, begin: int, end: int) -> Series:
        """Rows of positions begin to end - 1; negative positions count from the end."""
        x = self.positions()
        if begin >= 0 and end >= 0:
            return self._unplaced(x.where((F.col("_pos") >= begin) & (F.col("_pos") < end)))
        x = self._with_size(x)
        lo, hi = (F.lit(v) if v >= 0 else F.col("_n") + v for v in (begin, end))
        return self._unplaced(x.where((F.col("_pos") >= lo) & (F.col("_pos") < hi)).drop("_n"))

    def crop(self, span: TimeRange) -> Series:
        """Rows from the one at or just before the range's begin, up to but without the one at or just before its end.

        The row at the end is left out even where the series ends before it.
        """
        if self.split_ms is not None:
            # in time order a place is a key, so nothing is numbered and no row is moved
            row = F.struct("_t", "_ord")
            ends = self.df.groupBy(*self.by).agg(self._place(span.begin, row).alias("_lo"), self._place(span.end, row).alias("_hi"))
            return self.with_df(self._with(self.df, ends).where((row >= F.col("_lo")) & (row < F.col("_hi"))).drop("_lo", "_hi"))
        x = self.positions()
        keyed = self._with(x, self._search(x, span.begin, "_lo")).where(F.col("_pos") >= F.col("_lo"))
        kept = self._with(keyed, self._search(keyed, span.end, "_hi")).where(F.col("_pos") < F.col("_hi"))
        return self._unplaced(kept.drop("_lo", "_hi"))

    def between(self, span: TimeRange) -> Series:
        """Rows whose time lies in a range, both ends included; `span` of `from_frame` does it in the scan."""
        return self.with_df(self.df.where(F.col("_t").between(span.begin, span.end)))

    def _with(self, x: DataFrame, small: DataFrame) -> DataFrame:
        """Joins one row per series to the rows; without `by` that is one row, broadcast."""
        if not self.by:
            return x.join(F.broadcast(small), F.lit(True))
        s = small.select(*[F.col(b).alias(f"__{b}") for b in self.by], *[c for c in small.columns if c not in self.by])
        on = fold(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in self.by])
        return x.join(s, on).drop(*[f"__{b}" for b in self.by])

    def _join_positions(self, pos: DataFrame, cond: Column) -> Series:
        return self._unplaced(self._with(self.positions(), pos).where(cond).drop("pos"))

    def at_key(self, key: datetime | int | str | TimeRange) -> Series:
        """All rows of exactly a key."""
        if isinstance(key, str):
            return self.with_df(self.df.where(F.col("_k") == key))
        if isinstance(key, TimeRange):
            return self.with_df(self.df.where((F.col("_t") == key.begin) & (F.col("_e") == key.end)))
        return self.with_df(self.df.where(F.col("_t") == tk.to_ms(key)))

    def sort_by_time(self) -> Series:
        """The arrival order becomes the time order; ties keep theirs. Nothing is moved: the order's key changes."""
        return self.with_df(self.df.withColumn("_ord", F.struct("_t", "_ord")))

    def sort(self, path: Path = None) -> Series:
        """The arrival order becomes the order of a column, nulls first, ties as before."""
        c, _, _ = self._field(path)
        return replace(self.with_df(self.df.withColumn("_ord", F.struct(c.alias("c"), F.col("_ord")))), split_ms=None)

    def ordered(self) -> DataFrame:
        """The rows in order of arrival: a distributed sort."""
        return self.df.orderBy(*self.by, "_ord")

    def is_chronological(self) -> bool:
        """Whether no row of a series is earlier than one that arrived before it.

        Rows are range-sorted by arrival; each partition reports its first and greatest time, and only those are compared.
        """
        key = F.struct(*self.by) if self.by else F.lit(0)
        x = self.df.select(F.xxhash64(key).alias("s"), "_ord", "_t").repartitionByRange("s", "_ord").sortWithinPartitions("s", "_ord").select("s", "_t")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, list] = {}
            for f in frames:
                for s, g in f.groupby("s", sort=False):
                    t = g["_t"].to_numpy()
                    h = held.get(s)
                    fine = bool((t[1:] >= t[:-1]).all()) and (h is None or t[0] >= h[1])
                    held[s] = [t[0], t[-1], fine] if h is None else [h[0], t[-1], h[2] and fine]
            if held:
                from pyspark import TaskContext

                # a series that lies inside one partition is settled; those at its ends may go on in others
                ends = [next(iter(held)), next(reversed(held))]
                rows = [(TaskContext.get().partitionId(), s, *held[s]) for s in dict.fromkeys(ends)]
                rows.append((TaskContext.get().partitionId(), 0, 0, 0, all(h[2] for h in held.values())))
                yield pd.DataFrame(rows, columns=["p", "s", "first", "last", "fine"])

        got = x.mapInPandas(run, "p int, s long, first long, last long, fine boolean").collect()
        if not all(r["fine"] for r in got):
            return False
        seen: dict[int, int] = {}
        for r in sorted(got, key=lambda r: r["p"]):
            if r["s"] in seen and r["first"] < seen[r["s"]] and r["s"] != 0:
                return False
            seen[r["s"]] = r["last"]
        return True

    def check_chronological(self) -> Series:
        if not self.is_chronological():
            raise SeriesError("events must be in time order")
        return self

    def size(self) -> int:
        return self.df.count()

    def size_valid(self, path: Path = None) -> int:
        c, k, _ = self._field(path)
        return self.df.agg(F.count_if(valid(c, k))).first()[0]

    def extents(self) -> DataFrame:
        """One row per series: begin_ms and end_ms over all rows."""
        return self.df.groupBy(*self.by).agg(F.min("_t").alias("begin_ms"), F.max(self.end()).alias("end_ms")).where("begin_ms is not null")

    def timerange(self) -> TimeRange | None:
        r = self.df.agg(F.min("_t").alias("b"), F.max(self.end()).alias("e")).first()
        return None if r["b"] is None else TimeRange(r["b"], r["e"])

    # aggregates

    def _order(self) -> Column:
        return F.struct(F.col("_ord"), F.col("_t"))

    def aggregate(self, how: Reducer | str | Callable, path: Path = None) -> Any:
        """One value over all rows; None over no rows."""
        r = reducer(how)
        c, k, _ = self._field(path)
        row = self.df.agg(r.over_rows(c, k, self._order()).alias("v"), F.count(F.lit(1)).alias("n")).first()
        return row["v"] if row["n"] else None

    def sum(self, path: Path = None, policy: str | None = None) -> Any:
        return self.aggregate(Reducer("sum").with_policy(policy or "keep"), path)

    def avg(self, path: Path = None, policy: str | None = None) -> Any:
        return self.aggregate(Reducer("avg").with_policy(policy or "keep"), path)

    mean = avg

    def max(self, path: Path = None, policy: str | None = None) -> Any:
        return self.aggregate(Reducer("max").with_policy(policy or "keep"), path)

    def min(self, path: Path = None, policy: str | None = None) -> Any:
        return self.aggregate(Reducer("min").with_policy(policy or "keep"), path)

    def first(self, path: Path = None, policy: str | None = None) -> Any:
        return self.aggregate(Reducer("first").with_policy(policy or "keep"), path)

    def last(self, path: Path = None, policy: str | None = None) -> Any:
        return self.aggregate(Reducer("last").with_policy(policy or "keep"), path)

    def median(self, path: Path = None, policy: str | None = None) -> Any:
        r = Reducer("median").with_policy(policy or "keep")
        return self._cut([Fraction(1, 2)], path, "linear")[0] if r.policy in ("keep", "ignore") else self.aggregate(r, path)

    def stdev(self, path: Path = None, policy: str | None = None) -> Any:
        return self.aggregate(Reducer("stddev").with_policy(policy or "keep"), path)

    def difference(self, path: Path = None, policy: str | None = None) -> Any:
        return self.aggregate(Reducer("difference").with_policy(policy or "keep"), path)

    def keep(self, path: Path = None, policy: str | None = None) -> Any:
        return self.aggregate(Reducer("keep").with_policy(policy or "keep"), path)

    def count(self) -> int:
        return self.size()

    def percentile(self, q: float, path: Path = None, method: str = "linear", policy: str | None = None) -> Any:
        from chronoweave.functions.reducers import percentile as make

        r = make(q, method, policy)
        return self._cut([Fraction(str(q)) / 100], path, method)[0] if r.policy in ("keep", "ignore") else self.aggregate(r, path)

    def _cut(self, marks: list[Fraction], path: Path, method: str) -> list:
        """Values at some fractions of all valid values, without collecting them; nulls for no values."""
        from chronoweave.operators.percentiles import interpolated

        c, k, _ = self._field(path)
        x = self.df.where(valid(c, k)).select(F.lit(0).alias("g"), c.alias("v"))
        row = interpolated(x, "g", "v", {f"q{i}": m for i, m in enumerate(marks)}, method).first()
        return [None] * len(marks) if row is None else [row[f"q{i}"] for i in range(len(marks))]

    def quantile(self, n: int, path: Path = None, method: str = "linear") -> list:
        """The n - 1 cut points; more parts than values is an error."""
        from chronoweave.functions.reducers import METHODS

        if method not in METHODS:
            raise SeriesError(f"no such method: {method!r}")
        size = self.size_valid(path)
        if n > size:
            raise SeriesError(f"{n} parts of {size} values")
        return self._cut([Fraction(i, n) for i in range(1, n)], path, method) if n > 1 else []

    def reduce_columns(self, reducers: Mapping[str, Reducer | str]) -> DataFrame:
        """One row per series with every column reduced."""
        out = []
        for name, how in reducers.items():
            c, k, _ = self._field(name)
            out.append(reducer(how).over_rows(c, k, self._order()).alias(name))
        return self.df.groupBy(*self.by).agg(*out)

    def columns_as_lists(self, fields: Spec = None) -> DataFrame:
        """One row per series: every column as the list of its values in order."""
        names = [".".join(p) for p in spec(fields, self.columns())]
        cols = [F.transform(F.array_sort(F.collect_list(F.struct("_ord", self._field(n)[0].alias("v")))), lambda x: x["v"]).alias(n) for n in names]
        return self.df.groupBy(*self.by).agg(*cols)

    def map_pairs(self, op: Callable[[dict], Mapping[str, Any]], returns: str = "double") -> DataFrame:
        """`by`, `key`, `value`, `_ord`: the pairs that a Python function makes of every payload, over Arrow batches."""
        kind = T._parse_datatype_string(returns)

        def pairs(rows: pa.Array) -> pa.Array:
            return pa.array([list(op(row).items()) for row in rows.to_pylist()], pa.map_(pa.string(), to_arrow_type(kind)))

        made = F.arrow_udf(pairs, T.MapType(T.StringType(), kind))(F.struct(*[F.col(quoted((c,))) for c in self.columns()]))
        return self.df.select(*self.by, "_ord", F.explode(made).alias("key", "value"))

    def map_reduce(self, op: Callable[[dict], Mapping[str, Any]], how: Reducer | str, returns: str = "double") -> DataFrame:
        """One row per series and key of `map_pairs` with the values reduced, in their order."""
        kind = T._parse_datatype_string(returns)
        return self.map_pairs(op, returns).groupBy(*self.by, "key").agg(reducer(how).over_rows(F.col("value"), kind, F.col("_ord")).alias("value"))

    def rows_by_key(self) -> DataFrame:
        """Key -> its rows, in order."""
        row = F.struct("_ord", *[F.col(quoted((c,))) for c in self.columns()])
        return self.df.groupBy(*self.by, self.key().alias("key")).agg(F.array_sort(F.collect_list(row)).alias("events"))

    # gaps, grid, rate, conversion

    def fill(self, fields: Spec = None, method: str = "zero", fill_limit: int | None = None) -> Series:
        """Fills missing values: 'zero', 'pad' (the value before) or 'linear' in time (numbers between two valid ones).

        At most `fill_limit` in a row are filled by zero and pad; a gap is filled linearly only if it is shorter than the
        limit. Columns that do not exist are skipped. Gaps at either end stay under linear, at the begin under pad.
        """
        if method not in ("zero", "pad", "linear"):
            raise PipelineError(f"no such fill method: {method!r}")
        if fill_limit is not None and (isinstance(fill_limit, bool) or not isinstance(fill_limit, int)):
            raise PipelineError("the fill limit is a whole number")
        parts = []
        for p in spec(fields):
            p = resolve(self.df, list(p) if len(p) > 1 else p[0])
            kind = type_at(self.df.schema, p)
            if kind is not None and not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
                parts.append((p, kind, need(self.df, p)))
        marks = {f"f{i}": F.when(valid(c, k), F.struct(F.col("_t").alias("t"), c.alias("x"))) for i, (_, k, c) in enumerate(parts)}
        x = add_neighbours(self.df, list(self.by), "_t", "_ord", marks, self.split_ms, following=method == "linear")
        out = x
        for i, (p, kind, c) in enumerate(parts):
            prev, nxt = F.col(f"__prev_f{i}"), F.col(f"__next_f{i}")
            run = F.col(POS) - F.coalesce(prev["pos"], F.lit(0))
            near = F.lit(True) if fill_limit is None else run <= fill_limit
            ok = valid(c, kind)
            if method == "zero":
                new = F.when(ok, c).when(near, F.lit(0).cast(kind)).otherwise(c)
            elif method == "pad":
                new = F.when(ok, c).when(near & prev.isNotNull(), prev["v"]["x"]).otherwise(c)
            else:
                gap = nxt["pos"] - prev["pos"] - 1
                short = F.lit(True) if fill_limit is None else gap < fill_limit
                a, b = as_number(prev["v"]["x"], kind), as_number(nxt["v"]["x"], kind)
                part = F.try_divide(F.col("_t") - prev["v"]["t"], nxt["v"]["t"] - prev["v"]["t"])
                est = a + (b - a) * part
                target = T.DoubleType() if numeric(kind) else kind
                new = F.when(ok, c.cast(target)).when(short & est.isNotNull(), est.cast(target)).otherwise(c.cast(target))
            out = put(out, p, new)
        return self.with_df(drop_neighbours(out))

    def _pairs(self, fields: list[tuple[tuple[str, ...], T.DataType, Column]]) -> DataFrame:
        """Rows with `_pt` and `_p0`, `_p1` ..: time and values of the row before."""
        row = F.struct(F.col("_t").alias("t"), *[c.alias(f"v{i}") for i, (_, _, c) in enumerate(fields)])
        x = add_neighbours(self.df, list(self.by), "_t", "_ord", {"row": row}, self.split_ms, strict=True, following=False)
        p = F.col("__prev_row")["v"]
        x = x.withColumn("_pt", p["t"]).withColumns({f"_p{i}": p[f"v{i}"] for i in range(len(fields))})
        return drop_neighbours(x)

    def _numbers(self, fields: Spec) -> list[tuple[tuple[str, ...], T.DataType, Column]]:
        out = []
        for p in spec(fields):
            c, k, q = self._field(list(p) if len(p) > 1 else p[0])
            out.append((q, k, c))
        return out

    def align(self, fields: Spec = None, window: str = "5m", method: str = "linear", limit: int | None = None) -> Series:
        """Values at every multiple of `window` between consecutive rows, by 'linear' interpolation or 'hold'.

        A row exactly on a boundary that is the first stays. Pairs that span more than `limit` boundaries give nulls, as do
        texts that are no numbers. Only the aligned fields (and `by`) remain.
        """
        if self.kind != TIME:
            raise PipelineError("only series of points in time can be aligned")
        if method not in ("linear", "hold"):
            raise PipelineError(f"no such align method: {method!r}")
        if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int)):
            raise PipelineError("the limit is a whole number")
        d = tk.need_duration(window)
        parts = self._numbers(fields)
        x = self._pairs(parts)
        lo, hi = F.floor(F.col("_pt") / d) + 1, F.floor(F.col("_t") / d)
        first = F.col("_pt").isNull() & (F.col("_t") % d == 0)
        lo = F.when(first, hi).otherwise(lo)
        x = x.withColumn("_lo", lo).withColumn("_hi", hi).where(F.col("_lo") <= F.col("_hi"))
        x = x.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_hi") - F.col("_lo")) / GRID_BLOCK))))
        start = F.col("_lo") + F.col("_b") * GRID_BLOCK
        x = x.withColumn("_g", F.explode(F.sequence(start, F.least(F.col("_hi"), start + (GRID_BLOCK - 1))))).withColumn("_g", F.col("_g") * d)
        many = F.lit(False) if limit is None else (F.col("_hi") - F.col("_lo") + 1) > limit
        part = F.try_divide(F.col("_g") - F.col("_pt"), F.col("_t") - F.col("_pt"))
        cols = []
        for i, (p, k, c) in enumerate(parts):
            pv, v = as_number(F.col(f"_p{i}"), k), as_number(c, k)
            if method == "hold":
                new = F.col(f"_p{i}")
            else:
                new = pv + (v - pv) * part
            cols.append(F.when(F.col("_pt").isNull(), c if method == "hold" else v).when(~many, new).alias(".".join(p)))
        return self.with_df(x.select(F.col("_g").alias("_t"), "_ord", *[b for b in self.by if b not in [".".join(p) for p, _, _ in parts]], *cols).withColumn("_ord", F.struct("_ord", "_t")), TIME)

    def rate(self, fields: Spec = None, allow_negative: bool = True) -> Series:
        """Change per second between consecutive rows as `<field>_rate`, keyed by the range between them.

        Texts that are no numbers, equal times, and falls where they are not allowed give null. The first row gives none.
        """
        if self.kind != TIME:
            raise PipelineError("only series of points in time have a rate")
        parts = self._numbers(fields)
        x = self._pairs(parts).where("_pt is not null")
        seconds = (F.col("_t") - F.col("_pt")) / F.lit(1000.0)
        cols = []
        for i, (p, k, c) in enumerate(parts):
            r = F.try_divide(as_number(c, k) - as_number(F.col(f"_p{i}"), k), seconds)
            cols.append((r if allow_negative else F.when(r >= 0, r)).alias(".".join(p) + "_rate"))
        return self.with_df(x.select(F.col("_pt").alias("_t"), F.col("_t").alias("_e"), "_ord", *self.by, *cols), RANGE)

    def as_events(self, alignment: str = "center") -> Series:
        """Ranges and indexes become points at their begin ('lag'), middle ('center') or end ('lead')."""
        if alignment not in ("lag", "center", "lead"):
            raise PipelineError(f"no such alignment: {alignment!r}")
        if self.kind == TIME:
            return self
        t = {"lag": F.col("_t"), "lead": F.col("_e"), "center": F.floor((F.col("_t") + F.col("_e")) / 2)}[alignment]
        return self.with_df(self.df.withColumn("_t", t).drop("_e", "_k"), TIME)

    def as_time_ranges(self, duration: str | None = None, alignment: str = "center") -> Series:
        """Points become ranges that they begin ('front'), halve ('center') or end ('behind'); an index becomes its range."""
        if self.kind == RANGE:
            return self
        if self.kind == INDEX:
            return self.with_df(self.df.drop("_k"), RANGE)
        if duration is None:
            raise PipelineError("points need a duration to become ranges")
        if alignment not in ("front", "center", "behind"):
            raise PipelineError(f"no such alignment: {alignment!r}")
        d = tk.need_duration(duration)
        back = {"front": 0, "center": d // 2, "behind": d}[alignment]
        return self.with_df(self.df.withColumn("_e", F.col("_t") - back + d).withColumn("_t", F.col("_t") - back), RANGE)

    def as_indexed(self, duration: str | None = None) -> Series:
        """Points become index strings of a duration; ranges cannot."""
        if self.kind == INDEX:
            return self
        if self.kind == RANGE:
            raise PipelineError("ranges cannot become indexes")
        if duration is None:
            raise PipelineError("points need a duration to become indexes")
        k = tk.index_string(F.col("_t"), duration)
        b, e = tk.index_range(k)
        return self.with_df(self.df.withColumn("_k", k).withColumn("_e", e).withColumn("_t", b), INDEX)

    # combination

    def dedup(self) -> Series:
        """Rows of one key become one: later ones win, field by field; a null does not overwrite."""
        return merge([self])

    def is_duplicate(self, ignore_values: bool = True) -> DataFrame:
        """The rows with `_duplicate`: whether the row's key occurs more than once; without `ignore_values`, key and payload."""
        same = [*self.by, *self.keys, *([] if ignore_values else [c for c in self.columns() if c not in self.by])]
        keys = [F.col(quoted((c,))) for c in same]
        plain = [F.to_json(F.struct(k)) if isinstance(self.df.schema[c].dataType, T.MapType) else k for c, k in zip(same, keys, strict=True)]
        # equal keys are counted before they meet, so a frequent one is no task of its own
        often = self.df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(plain)]).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
        on = fold(lambda a, b: a & b, [k.eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(plain)])
        return self.df.join(often, on, "left").withColumn("_duplicate", F.col("__n").isNotNull()).drop("__n", *[f"__k{i}" for i in range(len(plain))])

    def same(self, other: Series) -> bool:
        """Equal kind, metadata, and rows in order, by value."""
        if self.kind != other.kind or dict(self.meta) != dict(other.meta) or sorted(self.columns()) != sorted(other.columns()):
            return False
        cols = sorted(self.columns())
        a, b = (s.positions().select(*s.keys, "_pos", *[F.col(quoted((c,))) for c in cols]) for s in (self, other))
        if [f.dataType for f in a.schema] != [f.dataType for f in b.schema]:
            return False
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    # what only streams can do

    def _bounded(self, what: str) -> None:
        raise PipelineError(f"{what}: a series is no stream")

    def start(self) -> None:
        self._bounded("start")

    def stop(self) -> None:
        self._bounded("stop")

    def on_emit(self, callback: Callable) -> None:
        self._bounded("on_emit")

    # output

    def events(self) -> list[dict]:
        """All rows in order, as Python dicts with their key."""
        return list(self.iterate(collect=True))

    def iterate(self, collect: bool = False) -> Iterator[dict]:
        """The rows in order; streamed partition by partition unless collected."""
        if self.df.isStreaming:
            raise PipelineError("a stream has no list of events")
        rows = self.ordered()
        for r in rows.collect() if collect else rows.toLocalIterator():
            d = r.asDict(recursive=True)
            key = d["_k"] if self.kind == INDEX else d["_t"] if self.kind == TIME else [d["_t"], d["_e"]]
            yield {self.kind: key, **{c: d[c] for c in self.columns()}}

    def points(self) -> DataFrame:
        """The rows as wire points: one JSON array [key, values ..] per row."""
        key = F.to_json(F.array("_t", "_e")) if self.kind == RANGE else F.col("_t").cast("string") if self.kind == TIME else F.to_json(F.array("_k"))
        key = F.regexp_extract(key, r"^\[(.*)\]$", 1) if self.kind == INDEX else key
        cells = [F.regexp_extract(F.to_json(F.array(F.col(quoted((c,))))), r"(?s)^\[(.*)\]$", 1) for c in self.columns()]
        return self.df.select("_ord", F.concat(F.lit("["), F.concat_ws(",", key, *cells), F.lit("]")).alias("point"))

    def to_json(self) -> dict:
        """The wire document."""
        pts = [json.loads(r["point"]) for r in self.points().orderBy("_ord").collect()]
        extra = {k: v for k, v in self.meta.items() if k not in ("name", "utc")}
        return {"name": self.name, "columns": [self.kind, *self.columns()], "points": pts, "utc": self.is_utc, **extra}

    def to_string(self) -> str:
        return json.dumps(self.to_json())


# over several series


def _union(series: list[Series]) -> tuple[DataFrame, Series]:
    kinds = {s.kind for s in series}
    if len(kinds) != 1:
        raise SeriesError("series of different kinds cannot be combined")
    parts = [s.df.withColumn("_src", F.lit(i)) for i, s in enumerate(series)]
    return fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), series[0]


def _merge_type(col: Column, kind: T.DataType, order: Column) -> Column:
    """The latest non-null leaf; structures are merged leaf by leaf."""
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_merge_type(col[f.name], f.dataType, order).alias(f.name) for f in kind])
        return F.when(F.count(col) > 0, inner)
    return F.max_by(col, F.when(col.isNotNull(), order))


def merge(series: list[Series], meta: Mapping[str, Any] | None = None) -> Series:
    """All rows by key, later ones (later series, then later arrival) winning leaf by leaf; null counts as absent."""
    if not series:
        raise SeriesError("nothing to merge")
    u, s = _union(series)
    order = F.struct("_src", "_ord")
    data = [c for c in u.columns if c not in (*INTERNAL, "_src", *s.by)]
    aggs = [_merge_type(F.col(quoted((c,))), u.schema[c].dataType, order).alias(c) for c in data]
    out = u.groupBy(*s.keys, *s.by).agg(F.min(order).alias("_ord"), *aggs)
    return replace(s.with_df(out.select(*s.keys, "_ord", *s.by, *[F.col(quoted((c,))) for c in data])), meta=dict(meta if meta is not None else s.meta))


def combine(series: list[Series], how: Reducer | str, fields: Spec = None, meta: Mapping[str, Any] | None = None) -> Series:
    """All rows by key, each field reduced over the rows of the key; None: every column. Fields are top-level columns."""
    if not series:
        raise SeriesError("nothing to combine")
    u, s = _union(series)
    order = F.struct("_src", "_ord")
    names = [p[0] for p in spec(fields, [c for c in u.columns if c not in (*INTERNAL, "_src", *s.by)])]
    r = reducer(how)
    aggs = [r.over_rows(F.col(quoted((n,))), u.schema[n].dataType, order).alias(n) for n in names]
    out = u.groupBy(*s.keys, *s.by).agg(F.min(order).alias("_ord"), *aggs)
    return replace(s.with_df(out), meta=dict(meta if meta is not None else s.meta))


def sum_series(series: list[Series], fields: Spec = None, meta: Mapping[str, Any] | None = None, policy: str = "ignore") -> Series:
    return combine(series, Reducer("sum").with_policy(policy), fields, meta)


def avg_series(series: list[Series], fields: Spec = None, meta: Mapping[str, Any] | None = None, policy: str = "ignore") -> Series:
    return combine(series, Reducer("avg").with_policy(policy), fields, meta)


def reduce_series(series: list[Series], function: Callable[[Series], Series], meta: Mapping[str, Any] | None = None) -> Series:
    """A function of the concatenated rows (in order of the series), as a Series of its own."""
    u, s = _union(series)
    both = s.with_df(u.withColumn("_ord", F.struct("_src", "_ord")).drop("_src"))
    return replace(function(both), meta=dict(meta if meta is not None else s.meta))


def parse_wire(spark: SparkSession, doc: Mapping[str, Any], schema: T.StructType | str | None = None, tz: str = "UTC") -> Series:
    """A series of a wire document {name, columns, points, ..}; `schema` names the data types, else they are inferred."""
    from chronoweave.sources.wire import read_wire

    return read_wire(spark, doc, schema, tz)
