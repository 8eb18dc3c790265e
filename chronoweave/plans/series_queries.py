"""Queries of the series operators over whole tables; `series_sql` has their SQL."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import ranges as rg
from chronoweave.functions import reducers as r
from chronoweave.functions import timekeys as tk
from chronoweave.functions.validity import POLICIES, valid
from chronoweave.operators import series as sr
from chronoweave.operators.percentiles import interpolated
from chronoweave.operators.series import Series, TimeRange
from chronoweave.plans.pipeline import Pipeline, collect_by_window, rollup
from chronoweave.plans.scale import shared_folder
from chronoweave.sources.tables import table
from chronoweave.sources.wire import read_wire_files, write_wire
from chronoweave.streaming import stateful
from chronoweave.streaming.aggregate import start, with_watermark
from chronoweave.streaming.source import read_stream

#: A range inside January 2024, the month of the events.
WEEK = TimeRange(1_704_672_000_000, 1_705_276_800_000)
PROBE = 1_705_000_000_123
TOKYO = "Asia/Tokyo"
ANGELES = "America/Los_Angeles"


def events(spark: SparkSession, folder: str, by: tuple[str, ...] = ("event_type",)) -> Series:
    """The events as series per type; `g` is `value` with gaps."""
    df = table(spark, folder, "events").withColumn("g", F.when(~(F.col("event_id") % 7).isin(0, 1), F.col("value")))
    return Series.from_frame(df, time="ts", order="event_id", by=by)


def out(s: Series | DataFrame, *cols: str) -> DataFrame:
    """Key and data columns under plain names."""
    df = s.df if isinstance(s, Series) else s
    names = {"_t": "t", "_e": "e", "_k": "k", "_group": "grp", "_pos": "pos"}
    keep = [c for c in df.columns if c in names] + list(cols) if cols else [c for c in df.columns if c != "_ord"]
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in dict.fromkeys(keep)])


def _stats() -> dict:
    return {"avg_value": {"value": r.avg()}, "max_value": {"value": r.maximum()}, "min_value": {"value": r.minimum()}, "n": {"value": r.count()}}


def _rounded(df: DataFrame, *cols: str, places: int = 9) -> DataFrame:
    """Doubles to 9 places, where sums differ by the order of addition only; sums themselves to 6."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in cols})


def _roll(window: str, tz: str = "UTC") -> Callable[[SparkSession, str], DataFrame]:
    def q(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(out(rollup(events(spark, d), window, _stats(), tz=tz), "avg_value", "max_value", "min_value", "n").drop("grp"), "avg_value")

    return q


def rollup_to_events(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(out(rollup(events(spark, d), "1h", _stats(), to_events=True), "avg_value", "n").drop("grp"), "avg_value")


def group_window_agg(spark: SparkSession, d: str) -> DataFrame:
    p = Pipeline().from_source(events(spark, d)).window_by("1h").group_by("event_type").emit_on("flush")
    x = p.aggregate({"mean_value": {"value": r.mean()}, "n": {"value": r.count()}, "median_value": {"value": r.median()}, "sd": {"value": r.stddev()}, "spread": {"value": r.difference()}, "p95": {"value": r.percentile(95)}, "event_type": {"event_type": r.keep()}})
    return _rounded(out(x.series(), "event_type", "mean_value", "n", "median_value", "sd", "spread", "p95").drop("grp"), "mean_value", "sd", "median_value", "p95", "spread")


def global_agg(spark: SparkSession, d: str) -> DataFrame:
    x = Pipeline().from_source(events(spark, d)).group_by("event_type").aggregate({"total": {"value": r.total()}, "n": {"value": r.count()}})
    return _rounded(out(x.series(), "total", "n", "_group"), "total", places=6)


def agg_reducers(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d)
    p = Pipeline().from_source(s).group_by("event_type")
    kinds = {"total": r.total(), "mean_value": r.avg(), "hi": r.maximum(), "lo": r.minimum(), "n": r.count(), "first_value": r.first(), "last_value": r.last(), "spread": r.difference(), "median_value": r.median(), "sd": r.stddev(), "p90": r.percentile(90)}
    x = p.aggregate({n: {"value": k} for n, k in kinds.items()} | {"kept": {"event_type": r.keep()}, "unkept": {"user_id": r.keep()}})
    x = _rounded(out(x.series(), *kinds, "kept", "unkept").drop("t", "e", "grp"), "mean_value", "sd", "p90", "median_value", "spread")
    return _rounded(x, "total", places=6)


def agg_policies(spark: SparkSession, d: str) -> DataFrame:
    p = Pipeline().from_source(events(spark, d)).window_by("daily").group_by("event_type")
    fields = {f"{k}_{policy}": {"g": r.BY_NAME[k](policy)} for policy in POLICIES for k in ("sum", "avg", "count", "min", "max", "first", "last")}
    x = out(p.aggregate(fields).series(), *fields, "_group").drop("t", "e")
    x = _rounded(x, *[f for f in fields if f.startswith("avg")])
    return _rounded(x, *[f for f in fields if f.startswith("sum")], places=6)


def percentile_methods(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").select("event_type", "value")
    marks = {"p5": Fraction(5, 100), "p50": Fraction(1, 2), "p95": Fraction(95, 100)}
    return _rounded(interpolated(df, "event_type", "value", marks, r.METHODS).drop("n"), *marks)


def quantile_4(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").select("event_type", "value")
    x = interpolated(df, "event_type", "value", {f"q{i}": Fraction(i, 4) for i in (1, 2, 3)})
    return x.select("event_type", *[F.round(f"q{i}", 9).alias(f"q{i}") for i in (1, 2, 3)])


def _flows(spark: SparkSession, d: str) -> Series:
    return Series.from_frame(table(spark, d, "flow"), time="time", order="flow_id", by=("name",))


def select_cols(spark: SparkSession, d: str) -> DataFrame:
    return out(_flows(spark, d).select(["in", "flow_id"]))


def select_nested(spark: SparkSession, d: str) -> DataFrame:
    s = _flows(spark, d)
    s = s.with_df(s.df.withColumn("direction", F.struct("in", "out")))
    return out(s.select(["direction.in", "direction.out", "flow_id"]))


def rename_columns(spark: SparkSession, d: str) -> DataFrame:
    return out(_flows(spark, d).rename({"in": "incoming", "out": "outgoing"}), "flow_id", "incoming", "outgoing")


def _collapse(kind: str, policy: str) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark: SparkSession, d: str) -> DataFrame:
        return out(_flows(spark, d).collapse(["in", "out"], "both", r.BY_NAME[kind](policy)), "flow_id", "both")

    return q


def offset_by(spark: SparkSession, d: str) -> DataFrame:
    return out(events(spark, d).offset_by(10.5, ["value"]), "event_type", "value")


def filter_gt(spark: SparkSession, d: str) -> DataFrame:
    return out(events(spark, d).filter(F.col("value") > 65), "event_id", "value")


def clean_valid(spark: SparkSession, d: str) -> DataFrame:
    s = Series.from_frame(table(spark, d, "traffic"), time="time", order="reading_id", by=("name",))
    return out(s.clean("value"), "reading_id", "value").distinct()


def size_valid(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "availability")
    return df.groupBy("name").agg(*[F.count_if(valid(F.col(c), df.schema[c].dataType)).alias(c) for c in ("value", "uptime", "notes", "outages")])


def map_columns(spark: SparkSession, d: str) -> DataFrame:
    return out(events(spark, d).map({"double": F.col("value") * 2}), "event_id", "double")


def map_rows(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d, ())
    return out(s.map_rows(lambda e: {"event_id": e["event_id"], "label": f"{e['event_type']}:{e['user_id']}"}, "event_id long, label string"))


def filter_rows(spark: SparkSession, d: str) -> DataFrame:
    return out(events(spark, d, ()).filter(lambda e: e["event_type"].startswith("p") and e["user_id"] % 2 == 0), "event_id")


def take_global(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the first ten events."""
    return out(Pipeline().from_source(events(spark, d)).take(10).series(), "event_id")


def take_per_group(spark: SparkSession, d: str) -> DataFrame:
    return out(Pipeline().from_source(events(spark, d)).group_by("event_type").take(10).series(), "event_id", "event_type")


def take_per_window_group(spark: SparkSession, d: str) -> DataFrame:
    return out(Pipeline().from_source(events(spark, d)).window_by("daily").group_by("event_type").take(2).series(), "event_id", "event_type")


def filter_take_count(spark: SparkSession, d: str) -> DataFrame:
    p = Pipeline().from_source(events(spark, d)).filter(F.col("value") > 50).group_by("user_id").take(3).clear_group_by().group_by("event_type")
    return p.count().select("group", "size")


def window_counts(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline().from_source(events(spark, d)).window_by("1h").group_by("event_type").count()


def keyed_sizes(spark: SparkSession, d: str) -> DataFrame:
    k = Pipeline().from_source(events(spark, d)).window_by("1d").group_by("event_type").keyed()
    return k.sizes().select(F.col("_key").alias("key"), "size")


def collect_windows(spark: SparkSession, d: str) -> DataFrame:
    return collect_by_window(events(spark, d), "1d").sizes().select(F.col("_key").alias("key"), "size")


def _fill(method: str, limit: int | None) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark: SparkSession, d: str) -> DataFrame:
        x = out(events(spark, d).fill("g", method, limit), "event_id", "g")
        return _rounded(x, "g") if method == "linear" else x

    return q


def _align(method: str, limit: int | None, window: str = "1h") -> Callable[[SparkSession, str], DataFrame]:
    def q(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(out(events(spark, d).align("value", window, method, limit), "event_type", "value"), "value")

    return q


def _rate(allow_negative: bool) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(out(events(spark, d).rate("value", allow_negative), "event_type", "value_rate"), "value_rate")

    return q


def align_then_rate(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(out(events(spark, d).align("value", "1h").rate("value"), "event_type", "value_rate"), "value_rate")


def fill_align_rate(spark: SparkSession, d: str) -> DataFrame:
    """Three steps in a row over the gapped values."""
    return _rounded(out(events(spark, d).fill("g", "pad").clean("g").align("g", "6h").rate("g"), "event_type", "g_rate"), "g_rate")


def _as_events(alignment: str) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, "outages").where("timerange.begin is not null and timerange.end is not null")
        s = Series.from_frame(df, begin=F.col("timerange.begin"), end=F.col("timerange.end"), order="outage_id", by=("name",))
        return out(s.as_events(alignment), "outage_id").distinct()

    return q


def _as_ranges(alignment: str) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark: SparkSession, d: str) -> DataFrame:
        return out(events(spark, d).as_time_ranges("1h", alignment), "event_id")

    return q


def as_indexed(spark: SparkSession, d: str) -> DataFrame:
    return out(events(spark, d).as_indexed("5m"), "event_id")


def index_ranges(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "availability").select("avail_id", "index").distinct()
    return out(Series.from_frame(df, index="index", order="avail_id"), "avail_id")


def calendar_keys(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d)
    t = F.col("_t")
    return s.df.select("event_id", tk.calendar_key(t, "daily").alias("day"), tk.calendar_key(t, "monthly").alias("month"), tk.calendar_key(t, "yearly").alias("year"), tk.calendar_key(t, "daily", TOKYO).alias("tokyo_day"), tk.index_string(t, "30s").alias("half_minute"))


def index_lists(spark: SparkSession, d: str) -> DataFrame:
    x = events(spark, d).extents()
    return x.select("event_type", F.explode(tk.index_strings(F.col("begin_ms"), F.col("end_ms"), "1d")).alias("k"))


def range_extents(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).extents()


def range_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Each outage against the one that begins before it in its series."""
    from pyspark.sql import Window

    b, e = F.unix_millis("timerange.begin"), F.unix_millis("timerange.end")
    x = table(spark, d, "outages").select("outage_id", "name", b.alias("b"), e.alias("e")).where("b <= e").distinct().withColumn("a", rg.time_range(F.col("b"), F.col("e")))
    x = x.withColumn("p", F.lag("a").over(Window.partitionBy("name").orderBy("b", "e", "outage_id"))).where("p is not null")
    a, p = F.col("p"), F.col("a")
    common = rg.intersection(a, p)
    return x.select("outage_id", rg.contains(a, p).alias("contains"), rg.within(a, p).alias("within"), rg.overlaps(a, p).alias("overlaps"), rg.disjoint(a, p).alias("disjoint"), rg.equals(a, p).alias("equal"), common["begin"].alias("cb"), common["end"].alias("ce"), rg.extents(a, p)["end"].alias("xe"), rg.duration(p).alias("ms"))


def merge_series(spark: SparkSession, d: str) -> DataFrame:
    """In and out of the flows as two series, merged by time."""
    s = _flows(spark, d)
    a, b = (s.with_df(s.df.select("_t", "_ord", "name", c).where(F.col(c).isNotNull())) for c in ("in", "out"))
    return out(sr.merge([a, b]), "name", "in", "out")


def _hours(spark: SparkSession, d: str) -> list[Series]:
    s = events(spark, d, ())
    return [rollup(s.filter(F.col("event_type") == k), "1h", {"n": {"event_id": r.count()}, "value": {"value": r.maximum()}}) for k in ("click", "error", "purchase", "signup", "view")]


def sum_series(spark: SparkSession, d: str) -> DataFrame:
    return out(sr.sum_series(_hours(spark, d), ["n"]), "n")


def combine_avg(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(out(sr.avg_series(_hours(spark, d), ["value", "n"]), "n", "value"), "n", "value")


def combine_last(spark: SparkSession, d: str) -> DataFrame:
    return out(sr.combine(_hours(spark, d), r.last(), ["value"]), "value")


def reduce_list(spark: SparkSession, d: str) -> DataFrame:
    return out(sr.reduce_series(_hours(spark, d), lambda s: s.dedup()), "n", "value").drop("grp")


def dedup_last(spark: SparkSession, d: str) -> DataFrame:
    return out(_flows(spark, d).dedup(), "name", "flow_id", "in", "out")


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    s = _flows(spark, d)
    return s.df.where("_t is not null").groupBy("name", "_t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", F.col("_t").alias("t"), "n")


def rows_by_key(spark: SparkSession, d: str) -> DataFrame:
    s = Series.from_frame(table(spark, d, "availability").drop("notes").distinct(), index="index", order="avail_id")
    return s.rows_by_key().select("key", F.size("events").alias("n"), F.col("events")[0]["avail_id"].alias("first_id"))


def columns_as_lists(spark: SparkSession, d: str) -> DataFrame:
    s = Series.from_frame(table(spark, d, "availability").select("name", "index", "avail_id", "outages").distinct(), index="index", order="avail_id", by=("name",))
    x = s.columns_as_lists(["avail_id", "outages"])
    return x.select("name", F.array_join(F.transform("avail_id", lambda v: v.cast("string")), ",").alias("ids"), F.array_join(F.transform("outages", lambda v: v.cast("string")), ",", "-").alias("outs"))


def crop(spark: SparkSession, d: str) -> DataFrame:
    return out(events(spark, d).crop(WEEK), "event_id")


def span_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same range as `between`, cut out by the scan."""
    return out(Series.from_frame(table(spark, d, "events"), time="ts", order="event_id", span=WEEK), "event_id")


def between(spark: SparkSession, d: str) -> DataFrame:
    return out(events(spark, d).between(WEEK), "event_id")


def slice_positions(spark: SparkSession, d: str) -> DataFrame:
    return out(events(spark, d).slice(5, 105), "event_id")


def slice_from_end(spark: SparkSession, d: str) -> DataFrame:
    return out(events(spark, d).slice(-20, -10), "event_id")


def at_time(spark: SparkSession, d: str) -> DataFrame:
    return out(events(spark, d).at_time(PROBE), "event_id")


def as_of(spark: SparkSession, d: str) -> DataFrame:
    """For every purchase the user's last click before it, else the first."""
    s = events(spark, d, ("user_id",))
    clicks, purchases = (s.filter(F.col("event_type") == k).set_data(event_id=F.col("event_id")) for k in ("click", "purchase"))
    return clicks.as_of(purchases).select("user_id", "event_id", F.col("found.event_id").alias("click_id"), F.col("found.t").alias("click_t"))


def bisect_pos(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).bisect(PROBE)


def at_position(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d)
    return out(s.at(7), "event_id").unionByName(out(s.at(-3), "event_id"))


def first_last(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d)
    return out(s.at_first(), "event_id").unionByName(out(s.at_last(), "event_id"))


def at_key(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "availability").select("avail_id", "index").distinct()
    return out(Series.from_frame(df, index="index", order="avail_id").at_key("1d-14641"), "avail_id")


def sort_by_value(spark: SparkSession, d: str) -> DataFrame:
    """The place of every event in its type's order by value."""
    return out(events(spark, d).sort("value").positions(), "event_id")


def nice_index(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("_t")
    x = events(spark, d).df.select("event_id", F.explode(F.array(tk.calendar_key(t, "daily"), tk.calendar_key(t, "monthly"), tk.calendar_key(t, "yearly"), tk.index_string(t, "1h"))).alias("k"))
    return x.select("event_id", "k", tk.nice_index(F.col("k")).alias("nice"))


def time_text(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).df.select("event_id", tk.time_text(F.col("_t")).alias("said"))


def month_shift(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).df.select("event_id", tk.add_months(F.col("_t"), 1).alias("later"), tk.add_months(F.col("_t"), -11).alias("sooner"))


def wire_points(spark: SparkSession, d: str) -> DataFrame:
    s = Series.from_frame(table(spark, d, "availability").select("avail_id", "index", "value", "outages").distinct(), index="index", order="avail_id")
    return s.points().select("point")


def wire_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Events as one wire document per user, written, read again and taken apart."""
    df = events(spark, d, ()).df.select(F.col("user_id").cast("string").alias("name"), "_t", "_ord", "event_id", "value", "event_type")
    path = shared_folder(spark, "wire")
    write_wire(df).select(F.col("wire").alias("value")).write.text(path)
    return read_wire_files(spark, path, "event_id long, value double, event_type string").select("name", F.col("_t").alias("t"), "event_id", "value", "event_type")


def series_points_wire(spark: SparkSession, d: str) -> DataFrame:
    """The batches of series_points as readings, one wire point each."""
    x = table(spark, d, "series_points").select("batch_id", F.explode("points").alias("p")).where("p.time is not null")
    s = Series.from_frame(x.select("batch_id", F.col("p.time").alias("time"), F.col("p.value").alias("value")), time="time", order="batch_id")
    return s.clean().points().select("point")


# streams


def _stream(spark: SparkSession, d: str, by: tuple[str, ...] = ("event_type",)) -> Series:
    schema = table(spark, d, "events").schema
    # a pattern, so that the table may be one file as well as a folder of files
    s = read_stream(spark, f"{d}/[e]vents.parquet", schema, time="ts", order="event_id", by=by)
    return s.with_df(s.df.withColumn("g", F.when(~(F.col("event_id") % 7).isin(0, 1), F.col("value"))))


def _collected(spark: SparkSession, p: Pipeline, mode: str | None = None) -> DataFrame:
    """What a stream gave, with `_batch`; written to files in the shared folder, not to the driver."""
    base = shared_folder(spark, "stream")
    q = start(p, lambda df, i: df.withColumn("_batch", F.lit(i)).write.mode("append").parquet(f"{base}/out"), f"{base}/state", mode=mode)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def stream_update(spark: SparkSession, d: str) -> DataFrame:
    p = Pipeline().from_source(_stream(spark, d)).window_by("1d").group_by("event_type").emit_on("eachEvent").aggregate(_stats())
    x = _collected(spark, p)
    last = x.groupBy("_k", "_group").agg(F.max_by(F.struct("avg_value", "max_value", "min_value", "n"), "_batch").alias("v"))
    return _rounded(last.select(F.col("_k").alias("k"), F.col("_group").alias("grp"), "v.*"), "avg_value")


def stream_discard(spark: SparkSession, d: str) -> DataFrame:
    """Complete windows only: those that the watermark has passed at the stream's end."""
    s = with_watermark(_stream(spark, d))
    p = Pipeline().from_source(s).window_by("1d").emit_on("discard").aggregate(_stats())
    return _rounded(out(_collected(spark, p), "_k", "avg_value", "n").drop("t", "e", "grp"), "avg_value")


def stream_flush(spark: SparkSession, d: str) -> DataFrame:
    p = Pipeline().from_source(_stream(spark, d)).window_by("monthly").group_by("event_type").emit_on("flush").aggregate(_stats())
    x = _collected(spark, p)
    last = x.groupBy("_k", "_group").agg(F.max_by(F.struct("avg_value", "n"), "_batch").alias("v"))
    return _rounded(last.select(F.col("_k").alias("k"), F.col("_group").alias("grp"), "v.*"), "avg_value")


def _stateful(make: Callable[[Series], Series], *cols: str) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark: SparkSession, d: str) -> DataFrame:
        s = make(_stream(spark, d))
        x = out(_collected(spark, Pipeline().from_source(s), "append"), *cols)
        return _rounded(x, *[c for c in cols if c in ("value", "value_rate")])

    return q


def series_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "rollup_fixed_1d": _roll("1d"),
        "rollup_fixed_30s": _roll("30s"),
        "rollup_hourly": _roll("1h"),
        "rollup_daily_utc": _roll("daily"),
        "rollup_daily_tokyo": _roll("daily", TOKYO),
        "rollup_monthly": _roll("monthly"),
        "rollup_monthly_angeles": _roll("monthly", ANGELES),
        "rollup_yearly": _roll("yearly"),
        "fill_zero": _fill("zero", None),
        "fill_zero_limit": _fill("zero", 1),
        "fill_pad": _fill("pad", None),
        "fill_pad_limit": _fill("pad", 1),
        "fill_linear": _fill("linear", None),
        "fill_linear_limit": _fill("linear", 2),
        "align_linear": _align("linear", None),
        "align_hold": _align("hold", None),
        "align_limit": _align("linear", 2, "10m"),
        "rate": _rate(True),
        "rate_non_negative": _rate(False),
        "collapse_sum": _collapse("sum", "ignore"),
        "collapse_avg_zero": _collapse("avg", "zero"),
        "collapse_max": _collapse("max", "ignore"),
        "collapse_propagate": _collapse("difference", "propagate"),
        "stream_rate": _stateful(lambda s: stateful.stream_rate(s, "value"), "event_type", "value_rate"),
        "stream_align": _stateful(lambda s: stateful.stream_align(s, "value", "1h"), "event_type", "value"),
        "stream_fill_pad": _stateful(lambda s: stateful.stream_fill(s, "g", "pad"), "event_id", "g"),
        "stream_take": _stateful(lambda s: stateful.stream_take(s, 10), "event_id", "event_type"),
    }
    for a in ("lag", "center", "lead"):
        q[f"as_events_{a}"] = _as_events(a)
    for a in ("front", "center", "behind"):
        q[f"as_time_ranges_{a}"] = _as_ranges(a)
    for f in (rollup_to_events, group_window_agg, global_agg, agg_reducers, agg_policies, percentile_methods, quantile_4, select_cols, select_nested, rename_columns, offset_by, filter_gt, clean_valid, size_valid, map_columns, map_rows, filter_rows, take_global, take_per_group, take_per_window_group, filter_take_count, window_counts, keyed_sizes, collect_windows, align_then_rate, fill_align_rate, as_indexed, index_ranges, calendar_keys, index_lists, range_extents, range_algebra, merge_series, sum_series, combine_avg, combine_last, reduce_list, dedup_last, duplicate_keys, rows_by_key, columns_as_lists, crop, between, span_scan, slice_positions, slice_from_end, at_time, as_of, bisect_pos, at_position, first_last, at_key, sort_by_value, nice_index, time_text, month_shift, wire_points, wire_round_trip, series_points_wire, stream_update, stream_discard, stream_flush):
        q[f.__name__] = f
    return q
