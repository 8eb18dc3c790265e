"""Queries of the parts of the interface that work on Python values, single calls or pushed streams, with their SQL."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.errors import ChronoweaveError
from chronoweave.functions import reducers as r
from chronoweave.functions import timekeys as tk
from chronoweave.functions.validity import check_policy
from chronoweave.operators import series as sr
from chronoweave.operators.series import Index, Series, TimeRange, last_days, last_month
from chronoweave.plans.pipeline import Pipeline
from chronoweave.plans.scale import shared_folder
from chronoweave.plans.series_queries import TOKYO, _collected, _rounded, _stats, events, out
from chronoweave.plans.series_sql import E, _fill
from chronoweave.sources.tables import millis, table
from chronoweave.sources.wire import WireEncoder, read_bag, read_events, read_wire
from chronoweave.streaming.push import PushStream
from chronoweave.streaming.source import read_stream

DAY = 86_400_000


def _rows(df: DataFrame, op: Callable[[tuple], tuple], schema: str) -> DataFrame:
    """A Python function of every row, over batches."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame([op(row) for row in x.itertuples(index=False)], columns=names)

    return df.mapInPandas(run, schema)


def _nations(spark: SparkSession, d: str) -> list[tuple[int, dict]]:
    return [(int(x["n_nationkey"]) * 1000, {"label": x["n_name"], "region": int(x["n_regionkey"])}) for x in table(spark, d, "nation").orderBy("n_nationkey").collect()]


def _spans(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "outages").select("outage_id", "name", millis(F.col("timerange")["begin"]).alias("b"), millis(F.col("timerange")["end"]).alias("e"))
    return x.where("b is not null and e is not null").distinct()


def event_list(spark: SparkSession, d: str) -> DataFrame:
    """A series of a list of events, listed again."""
    listed = Pipeline().from_source(read_events(spark, _nations(spark, d))).to_event_list()
    return spark.createDataFrame([(e["time"], e["label"], e["region"]) for e in listed], "t long, label string, region long")


def event_bag(spark: SparkSession, d: str) -> DataFrame:
    """Plain values as payloads; what is no list of events gives no rows and a warning."""
    good = read_bag(spark, [(t, x["region"]) for t, x in _nations(spark, d)], schema="value long")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        bad = read_bag(spark, "no events", schema="value long")
    return out(good.add_events(bad), "value").withColumn("warnings", F.lit(len(seen)))


def wrapped_copies(spark: SparkSession, d: str) -> DataFrame:
    """A copy of a series, an empty one, and one with the rows of another under its own metadata."""
    s = events(spark, d).with_name("all")
    one = s.empty().set_events(s.filter(F.col("event_type") == "click"))
    none, back = s.set_events(None), s.empty().add_events(s)
    return out(one, "event_id").withColumn("part", F.lit(one.name)).unionByName(out(none, "event_id").withColumn("part", F.lit("none"))).unionByName(out(back, "event_id").withColumn("part", F.lit("copy")))


def appended(spark: SparkSession, d: str) -> DataFrame:
    """Events after those that were there, and one more."""
    s = events(spark, d, ()).select(["value"])
    more = s.filter(F.col("value") > 300).offset_by(1000, "value")
    grown = s.add_events(more).add_event(1_704_067_200_000, -1.0)
    last = grown.at_last().df.select(F.col("_t").alias("t"), "value")
    counts = grown.df.agg(F.min("_t").alias("t"), F.round(F.sum("value"), 4).alias("value"))
    return last.withColumn("part", F.lit("last")).unionByName(counts.withColumn("part", F.lit("all")))


def chronological(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d, ())
    by_id = s.with_df(s.df.withColumn("_ord", F.col("event_id")))
    return spark.createDataFrame([("arrival", by_id.is_chronological()), ("sorted", by_id.sort_by_time().is_chronological())], "part string, fine boolean")


def sorted_by_time(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d)
    s = s.with_df(s.df.withColumn("_ord", -F.col("event_id")))
    return out(s.sort_by_time().positions(), "event_id")


def pipeline_builder(spark: SparkSession, d: str) -> DataFrame:
    """A window given as a pair, a grouping set and cleared, a window set and cleared."""
    p = events(spark, d).pipeline().window_by(("fixed", "6h")).group_by("event_type")
    state = p.state()
    a = p.clear_group_by().aggregate({"n": {"value": r.count()}}).series()
    b = p.clear_window().aggregate({"n": {"value": r.count()}}).series()
    c = p.window_by().clear_group_by().aggregate({"n": {"value": r.count()}}).series()
    said = F.lit(f"{state['mode']} {state['window_type']} {state['window_duration']} {state['group_by']} {state['emit_on']} {state['tz']}")
    parts = [a.df.select(F.col("_t").alias("t"), F.lit("windows").alias("part"), "n"), b.df.select(F.lit(None).cast("long").alias("t"), F.col("_group").alias("part"), "n"), c.df.select(F.lit(None).cast("long").alias("t"), F.lit("all").alias("part"), "n")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("state", said)


def set_data(spark: SparkSession, d: str) -> DataFrame:
    return out(events(spark, d).set_data(twice=F.col("value") * 2, id=F.col("event_id")), "id", "twice")


def map_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A Python function of every payload to pairs, and the pairs reduced per type."""
    s = events(spark, d)

    def pairs(row: dict) -> dict:
        v = row["value"]
        return {"big": v} if v is not None and v > 50 else {"small": v, "share": (v or 0.0) / 100}

    x = s.map_reduce(pairs, r.last())
    y = s.map_reduce(pairs, r.count())
    return x.withColumnRenamed("value", "last_value").join(y.withColumnRenamed("value", "n"), ["event_type", "key"])


def user_reducer(spark: SparkSession, d: str) -> DataFrame:
    """A Python reducer of the ordered values of every day and type: the span between first and last."""
    p = Pipeline().from_source(events(spark, d)).window_by("1d").group_by("event_type")
    return out(p.aggregate({"change": {"value": r.user(lambda v: v[-1] - v[0])}}).series(), "change", "_group").drop("t", "e")


def metadata(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d).with_name("first").with_meta("index", "1d-19723").with_meta("site", "x")
    t = s.with_name("second")
    rows = [(x.name, x.meta.get("site"), x.is_utc, x.index_text, x.index_range().begin, ",".join(sorted(x.columns())), ",".join(x.keys)) for x in (s, t)]
    return spark.createDataFrame(rows, "name string, site string, utc boolean, idx string, begin_ms long, data string, key string")


def event_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys, begins and ends of points, ranges and indexes."""
    points = events(spark, d)
    spans = Series.from_frame(_spans(spark, d), begin="b", end="e", order="outage_id")
    days = Series.from_frame(table(spark, d, "availability").select("avail_id", "index").distinct(), index="index", order="avail_id")
    parts = [s.df.select(F.lit(s.kind).alias("kind"), F.col(i).alias("id"), s.key().alias("key"), s.begin().alias("b"), s.end().alias("e")) for s, i in ((points, "event_id"), (spans, "outage_id"), (days, "avail_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def iterated(spark: SparkSession, d: str) -> DataFrame:
    """Rows given to a function in order; the observer gets their number, the replaced function the rest."""
    daily = Pipeline().from_source(events(spark, d)).window_by("1d").aggregate({"n": {"value": r.count()}})
    seen: list[tuple] = []
    ends: list[int | None] = []
    daily.to(lambda e: seen.append((len(seen), e["index"], e["n"])), ends.append)
    Pipeline().from_source(daily.series().empty()).to(seen.append, ends.append)
    listed = daily.series().events()
    return spark.createDataFrame([(*x, str(ends), len(listed)) for x in seen], "place long, k string, n long, ends string, listed long")


def encoded(spark: SparkSession, d: str) -> DataFrame:
    """Ranges, indexes, times and series in the JSON of the wire format."""
    x = _rows(_spans(spark, d).where("b <= e"), lambda row: (row.outage_id, json.dumps({"range": TimeRange(row.b, row.e), "index": Index.of("1d", row.b), "time": tk.from_ms(row.b)}, cls=WireEncoder)), "id long, said string")
    nations = read_wire(spark, {"name": "n", "columns": ["time", "label"], "points": [[t, v["label"]] for t, v in _nations(spark, d)]})
    return x.unionByName(spark.createDataFrame([(-1, json.dumps(nations, cls=WireEncoder))], "id long, said string"))


def coerced_times(spark: SparkSession, d: str) -> DataFrame:
    """The same times from instants, from local times read as UTC, from numbers, and through Python."""
    df = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("a"), F.col("ts").cast("timestamp_ntz").alias("b"))
    df = df.withColumn("c", F.unix_millis("a"))
    parts = [Series.from_frame(df.select("event_id", c), time=c, order="event_id").df.select(F.lit(c).alias("part"), "event_id", F.col("_t").alias("t")) for c in "abc"]
    python = _rows(df.select("event_id", "c"), lambda row: ("d", row.event_id, tk.to_ms(tk.from_ms(int(row.c)) + timedelta(microseconds=999))), "part string, event_id long, t long")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(python)


def range_values(spark: SparkSession, d: str) -> DataFrame:
    """Ranges as Python values: made of a pair, moved ends, texts and lengths in words; reversed ones raise."""

    def of(row: Any) -> tuple:
        try:
            x = TimeRange.of([int(row.b), int(row.e)])
        except ChronoweaveError:
            return row.outage_id, None, None, None, None, None
        return row.outage_id, x.with_begin(x.begin - 1000).begin, x.with_end(tk.from_ms(x.end + 5000)).end, x.text(), x.humanize_duration(), x.relative_text(x.end + DAY)

    return _rows(_spans(spark, d), of, "outage_id long, begin_ms long, end_ms long, said string, length string, ago string")


def last_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The ranges that end with every outage: one day, seven days, a month."""

    def of(row: Any) -> tuple:
        now = tk.from_ms(int(row.e))
        return row.outage_id, last_days(1, now).begin, last_days(7, now).begin, last_month(now).begin, last_month(now).end

    return _rows(_spans(spark, d), of, "outage_id long, day_ms long, week_ms long, month_ms long, end_ms long")


def index_values(spark: SparkSession, d: str) -> DataFrame:
    """Index strings as Python values: length of the window, begin, end, range, text."""
    df = table(spark, d, "availability").select("index").distinct()
    return _rows(df, lambda row: (row.index, tk.duration_ms(row.index), Index(row.index).begin(), Index(row.index).end(), Index(row.index).timerange().duration(), Index(row.index).to_json()), "k string, ms long, b long, e long, length long, said string")


def local_times(spark: SparkSession, d: str) -> DataFrame:
    df = events(spark, d).df.select("event_id", "_t")
    return _rows(df, lambda row: (row.event_id, tk.from_ms(int(row[1]), TOKYO).strftime("%Y-%m-%d %H:%M:%S")), "event_id long, said string")


def fill_linear_many(spark: SparkSession, d: str) -> DataFrame:
    """Two columns with gaps of their own, filled at once."""
    s = events(spark, d)
    s = s.with_df(s.df.withColumn("h", F.when(F.col("event_id") % 5 != 0, F.col("value"))))
    return _rounded(out(s.fill(["g", "h"], "linear"), "event_id", "g", "h"), "g", "h")


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Rows of flow whose key, and whose key and payload, occur more than once."""
    df = table(spark, d, "flow").select("name", "time", "in", "out", "type")
    s = Series.from_frame(df, time="time", by=("name",))
    parts = [s.is_duplicate(x).where("_duplicate").groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("key" if x else "payload")) for x in (True, False)]
    return parts[0].unionByName(parts[1])


def same_series(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d).select(["event_id", "value"])
    other = s.offset_by(1, ["event_id", "value"])
    rows = [("itself", s.same(s)), ("in another order", s.same(s.with_df(s.df.repartition(3)))), ("other values", s.same(other)), ("other name", s.same(s.with_name("x"))), ("a row less", s.same(s.filter(F.col("event_id") > 0)))]
    return spark.createDataFrame(rows, "part string, same boolean")


def refused(spark: SparkSession, d: str) -> DataFrame:
    """Calls that must raise, and what they raise."""
    s = events(spark, d)
    spans = Series.from_frame(_spans(spark, d), begin="b", end="e", order="outage_id")
    stream = _daily_stream(spark, d, 1)
    calls = {
        "start": s.start,
        "stop": s.stop,
        "on_emit": lambda: s.on_emit(print),
        "events of a stream": stream.events,
        "align of ranges": lambda: spans.align("name"),
        "rate of ranges": lambda: spans.rate("name"),
        "fill method": lambda: s.fill("g", "spline"),
        "fill limit": lambda: s.fill("g", "pad", 1.5),
        "policy": lambda: check_policy("drop"),
        "two kinds": lambda: sr.merge([s, spans]),
        "discard of months": lambda: Pipeline().from_source(stream).window_by("monthly").emit_on("discard").aggregate({"n": {"value": r.count()}}),
        "trigger": lambda: Pipeline().emit_on("sometimes"),
        "no source": lambda: Pipeline().series(),
        "reversed range": lambda: TimeRange.of(2, 1),
        "mixed range": lambda: TimeRange.of(1, tk.from_ms(2)),
        "naive time": lambda: tk.to_ms(tk.from_ms(1).replace(tzinfo=None)),
        "payload": lambda: read_bag(spark, [(1, None)]),
        "disorder": lambda: read_events(spark, [(2, 1.0), (1, 1.0)]),
    }
    rows = []
    for name, call in calls.items():
        try:
            call()
            rows.append((name, "nothing"))
        except ChronoweaveError as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "call string, raised string")


# streams


def _pushed(spark: SparkSession, d: str) -> PushStream:
    p = PushStream(spark, "event_id long, event_type string, g double", by=("event_type",))
    s = events(spark, d).select(["event_id", "g"])
    p.add_rows(s)  # not started: dropped
    p.start()
    p.add_rows(s)
    p.add_event(1_767_225_600_000, {"event_id": -1, "event_type": "click"})
    return p


def push_fill_linear(spark: SparkSession, d: str) -> DataFrame:
    """Pushed rows, filled linearly; stopping ends the stream, so what waited for a value comes out unfilled."""
    p = _pushed(spark, d)
    p.stop()
    p.add_event(1_767_225_600_001, {"event_id": -2, "event_type": "click"})
    x = _collected(spark, Pipeline().from_source(p.source()).fill("g", "linear"), "append")
    return _rounded(out(x, "event_id", "g"), "g")


def stream_fill_linear(spark: SparkSession, d: str) -> DataFrame:
    """The same without an end: gaps that no value has closed are held back."""
    p = _pushed(spark, d)
    p.flush()
    x = _collected(spark, Pipeline().from_source(p.source()).fill("g", "linear"), "append")
    return _rounded(out(x, "event_id", "g"), "g")


def push_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pushed rows counted per day; the end of the stream is no row."""
    p = _pushed(spark, d)
    p.stop()
    x = _collected(spark, Pipeline().from_source(p.source()).window_by("1d").emit_on("flush").aggregate({"n": {"event_id": r.count()}}))
    return x.groupBy("_k").agg(F.max_by("n", "_batch").alias("n")).select(F.col("_k").alias("k"), "n")


def _daily_stream(spark: SparkSession, d: str, files: int = 4) -> Series:
    """The events in files that are not in time order, one file a micro-batch."""
    path = shared_folder(spark, "files")
    df = table(spark, d, "events")
    for i in range(files):
        df.where(F.col("event_id") % files == i).coalesce(1).write.mode("append").parquet(path)
    return read_stream(spark, path, df.schema, files_per_batch=1, time="ts", order="event_id", by=("event_type",))


def stream_late(spark: SparkSession, d: str) -> DataFrame:
    """Late rows join their windows where the trigger is each event; the last state of every window."""
    p = Pipeline().from_source(_daily_stream(spark, d)).window_by("1d").group_by("event_type").emit_on("eachEvent").aggregate(_stats())
    last = _collected(spark, p).groupBy("_k", "_group").agg(F.max_by(F.struct("avg_value", "max_value", "min_value", "n"), "_batch").alias("v"))
    return _rounded(last.select(F.col("_k").alias("k"), F.col("_group").alias("grp"), "v.*"), "avg_value")


def stream_global(spark: SparkSession, d: str) -> DataFrame:
    """One window for all, and calendar years, at the end of the stream."""
    s = _daily_stream(spark, d, 2)
    parts = []
    for window in (None, "yearly"):
        x = _collected(spark, Pipeline().from_source(s).window_by(window).emit_on("flush").aggregate({"n": {"value": r.count()}}))
        parts.append(x.groupBy("_k").agg(F.max_by("n", "_batch").alias("n")).select(F.lit(window or "global").alias("part"), "n"))
    return parts[0].unionByName(parts[1])


def stream_forks(spark: SparkSession, d: str) -> DataFrame:
    """Two outputs of one pipeline; one of them to a function that is replaced before it runs."""
    base = Pipeline().from_source(_daily_stream(spark, d, 2)).filter(F.col("value") > 50)
    counts = base.window_by("1d").emit_on("flush").aggregate({"n": {"value": r.count()}})
    rates = _collected(spark, base.take(3), "append")
    seen: list[tuple] = []
    state = shared_folder(spark, "state")
    fork = counts.to(lambda e: None, checkpoint=state)
    fork.on_emit(lambda e: seen.append((e["index"], e["n"])))
    fork.query.awaitTermination()
    last = dict(seen)
    a = spark.createDataFrame(sorted(last.items()), "k string, n long")
    return a.unionByName(rates.agg(F.count(F.lit(1)).alias("n")).select(F.lit("taken").alias("k"), "n"))


def api_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (event_list, event_bag, wrapped_copies, appended, chronological, sorted_by_time, pipeline_builder, set_data, map_pairs, user_reducer, metadata, event_keys, iterated, encoded, coerced_times, range_values, last_ranges, index_values, local_times, fill_linear_many, duplicates, same_series, refused, push_fill_linear, stream_fill_linear, push_counts, stream_late, stream_global, stream_forks)
    return {f.__name__: f for f in found}


_N = "n AS (SELECT n_nationkey * 1000 AS t, n_name AS label, n_regionkey AS region FROM nation)"
_S = """s AS (SELECT DISTINCT outage_id, name, epoch_us(timerange['begin']) // 1000 AS b, epoch_us(timerange['end']) // 1000 AS e
  FROM outages WHERE timerange['begin'] IS NOT NULL AND timerange['end'] IS NOT NULL)"""
_TEXT = "'%a, %d %b %Y %H:%M:%S UTC'"

# A length in words, by the largest unit that fits.
_WORDS = """CASE WHEN s >= 31536000 THEN CASE WHEN s // 31536000 = 1 THEN 'a year' ELSE (s // 31536000) || ' years' END
  WHEN s >= 2592000 THEN CASE WHEN s // 2592000 = 1 THEN 'a month' ELSE (s // 2592000) || ' months' END
  WHEN s >= 86400 THEN CASE WHEN s // 86400 = 1 THEN 'a day' ELSE (s // 86400) || ' days' END
  WHEN s >= 3600 THEN CASE WHEN s // 3600 = 1 THEN 'an hour' ELSE (s // 3600) || ' hours' END
  WHEN s >= 60 THEN CASE WHEN s // 60 = 1 THEN 'a minute' ELSE (s // 60) || ' minutes' END
  WHEN s < 1 THEN 'now' ELSE s || ' seconds' END"""


def _words(ms: str) -> str:
    return _WORDS.replace("s //", f"({ms}) // 1000 //").replace("WHEN s ", f"WHEN ({ms}) // 1000 ").replace("ELSE s ||", f"ELSE ({ms}) // 1000 ||")


_PUSHED = f"""SELECT event_id, t, g FROM ({_fill('linear', None)})"""
_HELD = f"""WITH {E}, z AS (SELECT *, last_value(CASE WHEN g IS NOT NULL THEN 1 END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY t DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS closed FROM e)
SELECT x.event_id, x.t, x.g FROM ({_fill('linear', None)}) x JOIN z ON z.event_id = x.event_id WHERE closed = 1"""


def _linear(gap: str) -> str:
    return _fill("linear", None).replace("event_id % 7 IN (0, 1)", gap)


def api_sql() -> dict[str, str]:
    keyed = f"""WITH {E}, x AS (SELECT event_type, t, event_id, CASE WHEN value > 50 THEN 'big' ELSE 'small' END AS key, value FROM e
  UNION ALL SELECT event_type, t, event_id, 'share', coalesce(value, 0) / 100 FROM e WHERE value <= 50 OR value IS NULL)
SELECT event_type, key, arg_max(value, event_id) AS last_value, count(*) AS n FROM x GROUP BY 1, 2"""
    return {
        "event_list": f"WITH {_N} SELECT t, label, region FROM n",
        "event_bag": f"WITH {_N} SELECT t, region AS value, 1 AS warnings FROM n",
        "wrapped_copies": f"""WITH {E} SELECT t, event_id, 'all' AS part FROM e WHERE event_type = 'click' UNION ALL SELECT t, event_id, 'copy' FROM e""",
        "appended": f"""WITH {E} SELECT 1704067200000 AS t, -1.0 AS value, 'last' AS part
UNION ALL SELECT least(min(t), 1704067200000), round(sum(value) + coalesce(sum(CASE WHEN value > 300 THEN value + 1000 END), 0) - 1, 4), 'all' FROM e""",
        "chronological": f"""WITH {E} SELECT 'arrival' AS part, count(*) = 0 AS fine FROM (SELECT t, lag(t) OVER (ORDER BY event_id) AS p FROM e) WHERE p > t UNION ALL SELECT 'sorted', true""",
        "sorted_by_time": f"WITH {E} SELECT t, event_id, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id DESC) - 1 AS pos FROM e",
        "pipeline_builder": f"""WITH {E}, x AS (SELECT t // 21600000 * 21600000 AS t, 'windows' AS part, count(*) AS n FROM e GROUP BY 1
  UNION ALL SELECT NULL, event_type, count(*) FROM e GROUP BY event_type UNION ALL SELECT NULL, 'all', count(*) FROM e)
SELECT *, 'batch fixed 6h event_type eachEvent UTC' AS state FROM x""",
        "set_data": f"WITH {E} SELECT t, event_id AS id, value * 2 AS twice FROM e",
        "map_pairs": keyed,
        "user_reducer": f"WITH {E} SELECT '1d-' || (t // {DAY}) AS k, event_type AS grp, arg_max(value, event_id) - arg_min(value, event_id) AS change FROM e GROUP BY 1, 2",
        "metadata": """SELECT unnest(['first', 'second']) AS name, 'x' AS site, true AS utc, '1d-19723' AS idx, 19723 * 86400000::BIGINT AS begin_ms,
  'event_id,event_type,g,props,user_id,value' AS data, '_t' AS key""",
        "event_keys": f"""WITH {E}, {_S} SELECT 'time' AS kind, event_id AS id, t::VARCHAR AS key, t AS b, t AS e FROM e
UNION ALL SELECT 'timerange', outage_id, b || ',' || e, b, e FROM s
UNION ALL SELECT 'index', avail_id, index, split_part(index, '-', 2)::BIGINT * {DAY}, (split_part(index, '-', 2)::BIGINT + 1) * {DAY} FROM (SELECT DISTINCT avail_id, index FROM availability)""",
        "iterated": f"""WITH {E}, x AS (SELECT t // {DAY} AS p, count(*) AS n FROM e GROUP BY 1)
SELECT row_number() OVER (ORDER BY p) - 1 AS place, '1d-' || p AS k, n, '[' || count(*) OVER () || ', None]' AS ends, count(*) OVER () AS listed FROM x""",
        "encoded": f"""WITH {_S}, {_N} SELECT outage_id AS id, '{{"range": [' || b || ', ' || e || '], "index": "1d-' || (b // {DAY}) || '", "time": ' || b || '}}' AS said FROM s WHERE b <= e
UNION ALL SELECT -1, '{{"name": "n", "columns": ["time", "label"], "points": [' || string_agg('[' || t || ', "' || label || '"]', ', ' ORDER BY t) || '], "utc": true}}' FROM n""",
        "coerced_times": f"WITH {E} SELECT unnest(['a', 'b', 'c', 'd']) AS part, event_id, t FROM e",
        "range_values": f"""WITH {_S} SELECT outage_id, CASE WHEN b <= e THEN b - 1000 END AS begin_ms, CASE WHEN b <= e THEN e + 5000 END AS end_ms,
  CASE WHEN b <= e THEN '[' || strftime(make_timestamp(b * 1000), {_TEXT}) || ', ' || strftime(make_timestamp(e * 1000), {_TEXT}) || ']' END AS said,
  CASE WHEN b <= e THEN {_words('e - b')} END AS length,
  CASE WHEN b <= e THEN {_words(f'e + {DAY} - b')} || ' ago to a day ago' END AS ago FROM s""",
        "last_ranges": f"""WITH {_S} SELECT outage_id, e - {DAY} AS day_ms, e - 7 * {DAY} AS week_ms, epoch_us(make_timestamp(e * 1000) - INTERVAL 1 month) // 1000 AS month_ms, e AS end_ms FROM s""",
        "index_values": f"""WITH x AS (SELECT DISTINCT index, split_part(index, '-', 2)::BIGINT AS p FROM availability)
SELECT index AS k, {DAY} AS ms, p * {DAY} AS b, (p + 1) * {DAY} AS e, {DAY} AS length, index AS said FROM x""",
        "local_times": f"WITH {E} SELECT event_id, strftime(make_timestamp((t + 9 * 3600000) * 1000), '%Y-%m-%d %H:%M:%S') AS said FROM e",
        "fill_linear_many": f"SELECT a.event_id, a.t, a.g, b.g AS h FROM ({_linear('event_id % 7 IN (0, 1)')}) a JOIN ({_linear('event_id % 5 = 0')}) b USING (event_id)",
        "duplicates": """WITH a AS (SELECT name, count(*) OVER (PARTITION BY name, epoch_us(time) // 1000) AS k, count(*) OVER (PARTITION BY name, epoch_us(time) // 1000, "in", "out", type) AS p FROM flow)
SELECT name, count(*) AS n, 'key' AS part FROM a WHERE k > 1 GROUP BY 1 UNION ALL SELECT name, count(*), 'payload' FROM a WHERE p > 1 GROUP BY 1""",
        "same_series": "SELECT * FROM (VALUES ('itself', true), ('in another order', true), ('other values', false), ('other name', false), ('a row less', false)) v(part, same)",
        "refused": """SELECT * FROM (VALUES ('start', 'PipelineError'), ('stop', 'PipelineError'), ('on_emit', 'PipelineError'), ('events of a stream', 'PipelineError'),
  ('align of ranges', 'PipelineError'), ('rate of ranges', 'PipelineError'), ('fill method', 'PipelineError'), ('fill limit', 'PipelineError'), ('policy', 'ReducerError'),
  ('two kinds', 'SeriesError'), ('discard of months', 'PipelineError'), ('trigger', 'PipelineError'), ('no source', 'PipelineError'), ('reversed range', 'TimeError'),
  ('mixed range', 'TimeError'), ('naive time', 'TimeError'), ('payload', 'FieldError'), ('disorder', 'SeriesError')) v(call, raised)""",
        "push_fill_linear": f"{_PUSHED} UNION ALL SELECT -1, 1767225600000, NULL",
        "stream_fill_linear": _HELD,
        "push_counts": f"""WITH {E}, x AS (SELECT t // {DAY} AS p FROM e UNION ALL SELECT 20454) SELECT '1d-' || p AS k, count(*) AS n FROM x GROUP BY 1""",
        "stream_late": f"""WITH {E} SELECT '1d-' || (t // {DAY}) AS k, event_type AS grp, round(avg(value), 9) AS avg_value, max(value) AS max_value, min(value) AS min_value, count(*) AS n FROM e GROUP BY 1, 2""",
        "stream_global": f"WITH {E} SELECT 'global' AS part, count(*) AS n FROM e UNION ALL SELECT 'yearly', count(*) FROM e GROUP BY year(make_timestamp(t * 1000))",
        "stream_forks": f"""WITH {E} SELECT '1d-' || (t // {DAY}) AS k, count(*) AS n FROM e WHERE value > 50 GROUP BY 1 UNION ALL SELECT 'taken', least(3, count(*)) FROM e WHERE value > 50""",
    }
