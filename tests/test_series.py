"""Series and pipeline against known results."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from chronoweave.errors import ChronoweaveError, FieldError, PipelineError, SeriesError, TimeError
from chronoweave.functions import reducers as r
from chronoweave.operators import series as sr
from chronoweave.operators.series import Index, Series, TimeRange
from chronoweave.plans.pipeline import Pipeline, collect_by_window, rollup
from chronoweave.sources.wire import read_events, read_wire

T0 = 1_400_425_947_000
TRAFFIC = {"name": "traffic", "columns": ["time", "value", "status"], "points": [[T0, 52, "ok"], [T0 + 1000, 18, "ok"], [T0 + 2000, 26, "fail"], [T0 + 3000, 93, "offline"]]}
HOURLY = [int(x) for x in "80 88 52 80 26 37 6 32 69 21 6 54 88 41 35 43 84 32 41 57 27 50 13 63 58 80 59 96 2 20 64 7 50 88 34 31 16 38 94 78 86 13 34 29 48 80 30 15 62 66 44 94 78 29 21 4 83 15 89 53 70 41 47 30 68 89 29 17 38 67 75 89 47 82 33 67 93 86 97 19 19 31 56 19 43 29 72 27 21 88 18 30 46 34 31 20 45 17 24 84 6 91 82 71 97 43 38 1 71 50 19 19 86 65 93 35".split()]
TEMPERATURES = [22.3, 32.4, 12.1, 76.8, 87.3, 54.6, 45.5, 87.9]


def wire(spark, columns, points, **meta):
    return read_wire(spark, {"columns": columns, "points": points, **meta})


@pytest.fixture(scope="module")
def traffic(spark):
    return read_wire(spark, TRAFFIC)


@pytest.fixture(scope="module")
def hourly(spark):
    return wire(spark, ["time", "value"], [[1_409_529_600_000 + 3_600_000 * i, v] for i, v in enumerate(HOURLY)])


@pytest.fixture(scope="module")
def pairs(spark):
    return wire(spark, ["time", "in", "out"], [[1_429_673_400_000, 1, 2], [1_429_673_460_000, 3, 4], [1_429_673_520_000, 5, 6]])


def values(s, name="value"):
    return [e[name] for e in s.events()]


def test_wire_round_trip_and_metadata(spark, traffic):
    doc = traffic.to_json()
    assert doc == {**TRAFFIC, "utc": True}
    assert read_wire(spark, json.dumps(doc)).same(traffic)
    assert traffic.columns() == ["value", "status"] and traffic.name == "traffic" and traffic.with_name("x").name == "x"
    assert traffic.timerange() == TimeRange(T0, T0 + 3000)
    rich = wire(spark, ["index", "uptime"], [["2014-07", "100%"], ["2014-08", "88%"]], site="lab", index="1d-625")
    assert rich.index_range() == TimeRange(54_000_000_000, 54_086_400_000) and rich.meta["site"] == "lab"
    assert json.loads(rich.to_string())["points"] == [["2014-07", "100%"], ["2014-08", "88%"]]
    ranges = wire(spark, ["timerange", "title"], [[[1, 5], 'a "b"'], [[2, 3], None]])
    assert ranges.to_json()["points"] == [[[1, 5], 'a "b"'], [[2, 3], None]] and ranges.timerange() == TimeRange(1, 5)
    nested = wire(spark, ["time", "direction"], [[T0, {"in": 1, "out": 2}]])
    assert nested.to_json()["points"] == [[T0, {"in": 1, "out": 2}]]


def test_bad_documents(spark):
    for columns, points in ((["when"], []), (["time", "v"], [[5, 1], [4, 1]]), (["index", "v"], [["2015-9@", 1]]), (["timerange", "v"], [[[5, 4], 1]])):
        with pytest.raises(ChronoweaveError):
            wire(spark, columns, points)


def test_direct_aggregates(pairs, traffic):
    assert (pairs.sum("in"), pairs.avg("out"), pairs.min("in"), pairs.max("in"), pairs.first("out"), pairs.last("out"), pairs.median("out")) == (9, 4, 1, 5, 2, 6, 4)
    assert pairs.stdev("in") == pytest.approx(1.632993161855452)
    assert traffic.sum() == 189 and traffic.count() == 4 and traffic.difference() == 75 and traffic.keep("status") is None
    assert pairs.empty().sum("in") is None and pairs.empty().timerange() is None
    with pytest.raises(FieldError):
        pairs.sum("no")


def test_user_reducer(pairs):
    assert pairs.aggregate(r.user(lambda v: float(v[-1] * 100 + v[0])), "in") == 501.0


@pytest.mark.parametrize(("kind", "policy", "want"), [("sum", "ignore", 8), ("avg", "ignore", 4), ("min", "zero", 0), ("max", "propagate", None), ("median", "zero", 2), ("stdev", "zero", 2.494438257849294), ("sum", "propagate", None), ("count", "keep", 3), ("count", "ignore", 2), ("first", "ignore", 2), ("last", "keep", 6)])
def test_policies(spark, kind, policy, want):
    s = wire(spark, ["time", "out"], [[1, 2], [2, None], [3, 6]])
    assert s.aggregate(r.BY_NAME[kind](policy), "out") == (want if want is None else pytest.approx(want))


def test_strict_and_unknown(spark):
    s = wire(spark, ["time", "out"], [[1, 2], [2, None]])
    with pytest.raises(Exception, match="missing value"):
        s.aggregate(r.total(strict=True), "out")
    for bad in (lambda: r.total("no"), lambda: r.percentile(101), lambda: r.percentile(5, "no"), lambda: r.reducer(3)):
        with pytest.raises(ChronoweaveError):
            bad()


def test_percentile_and_quantile(spark):
    s = wire(spark, ["time", "temperature"], [[i, v] for i, v in enumerate(TEMPERATURES)])
    want = {(50, "linear"): 50.05, (95, "linear"): 87.69, (99, "linear"): 87.858, (99, "lower"): 87.3, (99, "higher"): 87.9, (99, "nearest"): 87.9, (99, "midpoint"): 87.6, (0, "linear"): 12.1, (100, "linear"): 87.9}
    for (q, m), v in want.items():
        assert s.percentile(q, "temperature", m) == pytest.approx(v)
        assert s.aggregate(r.percentile(q, m), "temperature") == pytest.approx(v)
    assert s.quantile(4, "temperature") == pytest.approx([29.875, 50.05, 79.425])
    assert s.quantile(4, "temperature", "nearest") == pytest.approx([32.4, 54.6, 76.8])
    assert s.quantile(1, "temperature") == [] and s.empty().percentile(50, "temperature") is None
    with pytest.raises(SeriesError):
        s.quantile(15, "temperature")


def test_filter_take_group(hourly):
    p = Pipeline().from_source(hourly)
    high = p.filter(F.col("value") > 65)
    assert len(high.to_event_list()) == 39
    ten = values(high.take(10).series())
    assert ten[:2] == [80, 88] and ten[8:] == [88, 94]
    grouped = p.group_by(F.when(F.col("value") > 65, "high").otherwise("low")).take(10)
    assert grouped.series().size() == 20
    assert grouped.series().filter(F.col("value") <= 65).events()[:2] == [{"time": 1_409_529_600_000 + 7_200_000, "value": 52}, {"time": 1_409_529_600_000 + 14_400_000, "value": 26}]
    again = p.take(10).group_by(lambda e: "high" if e["value"] > 65 else "low").count()
    assert {x["group"]: x["size"] for x in again.collect()} == {"high": 4, "low": 6}
    assert p.filter(F.col("value") > 1000).to_event_list() is None
    seen = []
    p.take(3).to(seen.append)
    assert [e["value"] for e in seen] == [80, 88, 52]


def test_rollups(hourly):
    daily = rollup(hourly, "1d", {"value": r.avg()})
    got = daily.df.orderBy("_k").collect()
    assert [x["value"] for x in got] == pytest.approx([46.875, 47.916666666666664, 54.083333333333336, 46.166666666666664, 51.85])
    assert rollup(hourly, "1h", {"value": r.avg()}).size() == 116
    events = rollup(hourly, "1d", {"value": r.avg()}, to_events=True)
    assert events.kind == "time" and events.df.agg(F.min("_t")).first()[0] == got[0]["_t"] + 43_200_000
    k = collect_by_window(hourly, "1d")
    assert k["1d-16314"].size() == 24 and k["1d-16318"].size() == 20 and len(k.keys()) == 5
    month = rollup(hourly, "monthly", {"n": {"value": r.count()}})
    assert month.events() == [{"index": "2014-09", "_group": None, "n": 116}]


def test_calendar_windows_honour_dst(spark):
    # 2015-03-08 has 23 hours in Los Angeles
    s = wire(spark, ["time", "value"], [[1_425_801_600_000 + 3_600_000 * i, 1] for i in range(48)])
    day = rollup(s, "daily", {"n": {"value": r.count()}}, tz="America/Los_Angeles").df.where("_k = '2015-03-08'").first()
    assert day["n"] == 23 and day["_e"] - day["_t"] == 23 * 3_600_000 - 1000


def test_windows_and_groups(spark):
    base = 1_426_319_820_000
    s = wire(spark, ["time", "type", "in", "out"], [[base, "a", 3, 1], [base + 60_000, "a", 9, 2], [base + 120_000, "b", 6, 6], [base + 180_000, "a", 4, 7], [base + 240_000, "b", 5, 9]])
    p = Pipeline().from_source(s).window_by("1h").emit_on("flush")
    fields = {"in": {"in": r.avg()}, "out": {"out": r.avg()}}
    assert sorted((e["index"], e["in"], e["out"]) for e in p.aggregate(fields).to_event_list()) == [("1h-396199", 6, 3), ("1h-396200", 4.5, 8)]
    got = p.group_by("type").aggregate({**fields, "type": {"type": r.keep()}}).to_event_list()
    assert sorted((e["index"], e["type"], e["in"], e["out"]) for e in got) == [("1h-396199", "a", 6, 1.5), ("1h-396199", "b", 6, 6), ("1h-396200", "a", 4, 7), ("1h-396200", "b", 5, 9)]
    assert p.group_by("type").keyed().keys() == ["1h-396199--a", "1h-396199--b", "1h-396200--a", "1h-396200--b"]
    assert p.clear_window().group_by("type").keyed().keys() == ["a", "b"] and p.clear_window().keyed().keys() == ["all"]
    total = p.clear_window().aggregate({"n": {"in": r.count()}}).series()
    assert total.kind == "timerange" and total.events()[0]["timerange"] == [base, base + 240_000]


def test_group_by_nested_path_and_nulls(spark):
    rows = [[1, {"status": "OK", "in": 1, "out": 2}], [2, {"status": "OK", "in": 3, "out": 4}], [3, {"status": "FAIL", "in": 0, "out": 0}], [4, {"status": None, "in": 8, "out": 0}]]
    p = Pipeline().from_source(wire(spark, ["time", "direction"], rows)).group_by("direction.status")
    assert {x["group"]: x["size"] for x in p.count().collect()} == {"OK": 2, "FAIL": 1, None: 1}
    got = p.aggregate({"out": {"direction.out": r.maximum()}}).keyed()
    assert got["OK"].events()[0]["out"] == 4


def test_projections(spark, pairs):
    s = wire(spark, ["time", "in", "out", "perpendicular"], [[1, 80, 37, 1000], [2, 88, 22, 1001], [3, 52, 56, 1002]])
    assert values(s.collapse(["in", "out"], "both", "sum"), "both") == [117, 110, 108]
    assert values(s.collapse(["in", "out"], "m", r.maximum(), append=False), "m") == [80, 88, 56]
    assert s.collapse(["in", "out"], "m", "sum", append=False).columns() == ["m"]
    for kind, want in (("avg", 58.5), ("median", 58.5), ("stddev", 21.5), ("difference", 43), ("first", 80), ("last", 37), ("count", 2), ("min", 37)):
        assert values(s.collapse(["in", "out"], "x", kind), "x")[0] == want
    assert s.select(["in", "gone"]).events()[0] == {"time": 1, "in": 80, "gone": None}
    assert s.offset_by(1, ["in"]).events()[0] == {"time": 1, "in": 81}
    assert s.rename({"in": "i"}).columns() == ["i", "out", "perpendicular"]
    with pytest.raises(FieldError):
        s.rename({"no": "x"})
    assert values(s.map({"in": F.col("in") * 2}), "in") == [160, 176, 104]
    assert s.map_rows(lambda e: {"x": e["in"] - e["out"]}, "x long").events()[0] == {"time": 1, "x": 43}
    assert s.filter(lambda e: e["in"] > 60).size() == 2
    nested = wire(spark, ["time", "d"], [[1, {"a": {"b": 5}}]])
    assert nested.select("d.a.b").events() == [{"time": 1, "d.a.b": 5}]
    with pytest.raises(FieldError):
        nested.select("d.a.b.c")


def test_clean_and_valid(spark):
    s = wire(spark, ["time", "v", "t"], [[1, 1.0, "x"], [2, float("nan"), ""], [3, None, "NaN"], [4, 2.0, None]])
    assert values(s.clean("v"), "v") == [1.0, 2.0] and s.size_valid("t") == 1


def test_fill(spark):
    t = [T0 + x for x in (0, 1000, 2000, 3000, 13_000, 23_000, 33_000)]
    s = wire(spark, ["time", "direction"], [[a, {"in": i, "out": o}] for a, i, o in zip(t, [1, None, None, 3, None, 5, 6], [2, None, None, None, None, 12, 13], strict=True)])
    got = [e["direction"] for e in s.fill(["direction.in", "direction.out"], "linear").events()]
    assert [g["in"] for g in got] == pytest.approx([1, 1.6666666666666665, 2.333333333333333, 3, 4, 5, 6])
    assert [g["out"] for g in got] == pytest.approx([2, 2.4347826086956523, 2.8695652173913047, 3.304347826086957, 7.6521739130434785, 12, 13])


@pytest.mark.parametrize("split", [None, 1000, 3000])
def test_fill_limits(spark, split):
    n = None
    x = {"a": [1, n, n, n, 5, 6, 7, n, n, n, n], "in": [1, n, n, 3, n, n, n, 7, 8, 9, 10], "out": [n, n, n, 8, n, 12, 13, n, n, n, n], "two": [1, n, n, 4, n, 6, n, n, n, n, n]}
    s = wire(spark, ["time", *x], [[T0 + 1000 * i, *[c[i] for c in x.values()]] for i in range(11)])
    s = sr.replace(s, split_ms=split)
    zero = s.fill(list(x), "zero", 2)
    assert values(zero, "in") == [1, 0, 0, 3, 0, 0, n, 7, 8, 9, 10] and values(zero, "out") == [0, 0, n, 8, 0, 12, 13, 0, 0, n, n]
    pad = s.fill(list(x), "pad", 2)
    assert values(pad, "in") == [1, 1, 1, 3, 3, 3, n, 7, 8, 9, 10] and values(pad, "out") == [n, n, n, 8, 8, 12, 13, 13, 13, n, n]
    linear = s.fill(["a", "two"], "linear", 2)
    assert values(linear, "a") == x["a"] and values(linear, "two")[:6] == [1, n, n, 4, 5, 6]
    assert values(s.fill("in", "linear"), "in") == [1, pytest.approx(5 / 3), pytest.approx(7 / 3), 3, 4, 5, 6, 7, 8, 9, 10]
    assert values(s.fill("no such", "zero").fill("a", "zero"), "a") == [v or 0 for v in x["a"]]
    for bad in ({"method": "no"}, {"fill_limit": 1.5}):
        with pytest.raises(PipelineError):
            s.fill("a", **bad)


@pytest.mark.parametrize("split", [None, 60_000])
def test_align_and_rate(spark, split):
    b = 1_471_824_000_000
    points = [[b + 30_000, 0.75], [b + 105_000, 2], [b + 210_000, 1], [b + 390_000, 1], [b + 510_000, 3], [b + 525_000, 5]]
    s = sr.replace(wire(spark, ["time", "value"], points), split_ms=split)
    x = s.align("value", "1m")
    assert values(x) == pytest.approx([1.25, 1.8571428571428572, 1.2857142857142856, 1, 1, 1, 1.5, 2.5])
    assert values(s.align("value", "1m", "hold")) == [0.75, 2, 2, 1, 1, 1, 1, 1]
    assert values(s.align("value", "1m", limit=2)) == [1.25, pytest.approx(1.8571428571428572), pytest.approx(1.2857142857142856), None, None, None, 1.5, 2.5]
    bad = sr.replace(wire(spark, ["time", "value"], [p if i != 4 else [p[0], "text"] for i, p in enumerate(points)]), split_ms=split)
    assert values(bad.align("value", "1m"))[5:] == [1, None, None]
    assert values(bad.align("value", "1m").rate(), "value_rate")[5:] == [None, None]
    counter = sr.replace(wire(spark, ["time", "in"], [[b + 30_000 * i, v] for i, v in enumerate([1, 3, 10, 40, 70, 130, 190, 220, 300, 390, 510])]), split_ms=split)
    rates = values(counter.rate("in"), "in_rate")
    assert len(rates) == 10 and [rates[i] for i in (2, 3, 4, 8, 9)] == [1, 1, 2, 3, 4]
    two = sr.replace(wire(spark, ["time", "value"], [[89_000, 100], [181_000, 50]]), split_ms=split).align("value", "30s")
    assert values(two.rate(), "value_rate") == pytest.approx([-0.5434782608695656, -0.5434782608695646, -0.5434782608695653])
    assert values(two.rate("value", allow_negative=False), "value_rate") == [None, None, None]
    edge = wire(spark, ["time", "value"], [[1_473_490_770_000 + 30_000 * i, 10 + 10 * i] for i in range(4)])
    assert values(edge.align("value", "30s")) == [10, 20, 30, 40]
    same = wire(spark, ["time", "value"], [[5, 1], [5, 2]])
    assert values(same.rate(), "value_rate") == [None]
    with pytest.raises(PipelineError):
        edge.rate().align("value_rate", "1m")


def test_conversions(spark):
    s = wire(spark, ["time", "v"], [[1_426_316_400_000, 1]])
    for alignment, want in (("front", [1_426_316_400_000, 1_426_320_000_000]), ("center", [1_426_314_600_000, 1_426_318_200_000]), ("behind", [1_426_312_800_000, 1_426_316_400_000])):
        assert s.as_time_ranges("1h", alignment).events()[0]["timerange"] == want
    i = s.as_indexed("1h")
    assert i.events()[0]["index"] == "1h-396199"
    for alignment, want in (("lag", 1_426_316_400_000), ("center", 1_426_318_200_000), ("lead", 1_426_320_000_000)):
        assert i.as_events(alignment).events()[0]["time"] == want
        assert i.as_time_ranges().as_events(alignment).events()[0]["time"] == want
    for bad in (lambda: i.as_time_ranges().as_indexed("1h"), lambda: s.as_time_ranges(), lambda: s.as_events("no") or i.as_events("no"), lambda: s.as_indexed()):
        with pytest.raises(PipelineError):
            bad()


def test_positions(spark, traffic):
    s = wire(spark, ["time", "value"], [[T0 + 1000 * i, v] for i, v in enumerate([52, 18, 26, 93, 99, 100])])
    assert values(s.crop(TimeRange(T0 + 1000, T0 + 4000))) == [18, 26, 93]
    assert values(s.crop(TimeRange(T0 - 500, T0 + 99_000))) == [52, 18, 26, 93, 99]
    assert values(traffic.at_time(datetime(2014, 5, 18, 15, 12, 29, 30_000, tzinfo=UTC)), "status") == ["fail"]
    assert values(s.at_time(5)) == [52] and values(s.at_time(T0 + 10**6)) == [100]
    assert values(s.at(2)) == [26] and values(s.at(-1)) == [100] and values(s.at(9)) == []
    assert values(s.slice(1, 3)) == [18, 26] and values(s.slice(-3, -1)) == [93, 99] and values(s.slice(-2, 99)) == [99, 100]
    assert [s.bisect(T0 + 3500, b).first()["pos"] for b in (0, 2, 5)] == [3, 3, 4]
    assert values(s.at_first()) == [52] and values(s.at_last()) == [100]
    assert values(s.sort("value")) == [18, 26, 52, 93, 99, 100]
    assert values(s.sort("value").sort_by_time()) == [52, 18, 26, 93, 99, 100]
    assert values(s.between(TimeRange(T0 + 1000, T0 + 2000))) == [18, 26]
    assert values(s.at_key(T0 + 1000)) == [18]
    e = s.empty()
    assert values(e.crop(TimeRange(0, 5))) == [] and values(e.at_time(5)) == [] and values(e.at_first()) == [] and e.bisect(5).isEmpty()
    assert s.is_chronological() and not s.sort("value").is_chronological()
    with pytest.raises(SeriesError):
        s.sort("value").check_chronological()


def test_merge_dedup_combine(spark):
    a = wire(spark, ["time", "in"], [[T0 + 1000 * i, v] for i, v in enumerate([52, 18, 26, 93])])
    b = wire(spark, ["time", "out"], [[T0 + 1000 * i, v] for i, v in enumerate([34, 13, 67, 91])])
    assert sr.merge([a, b]).events()[2] == {"time": T0 + 2000, "in": 26, "out": 67}
    assert values(sr.sum_series([a, a], "in"), "in") == [104, 36, 52, 186]
    d = wire(spark, ["time", "in", "out"], [[1, 1, 2], [2, 3, 4], [2, 4, 4], [3, 5, 6]])
    assert values(d.dedup(), "in") == [1, 4, 5] and d.df.where("_t = 2").count() == 2
    n1, n2 = (wire(spark, ["time", "payload"], [[1, {k: 1}]]) for k in "ab")
    n1 = n1.with_df(n1.df.withColumn("payload", F.struct(F.col("payload.a"), F.lit(None).cast("long").alias("b"))))
    n2 = n2.with_df(n2.df.withColumn("payload", F.struct(F.lit(None).cast("long").alias("a"), F.col("payload.b"))))
    assert sr.merge([n1, n2]).events()[0]["payload"] == {"a": 1, "b": 1}
    x = wire(spark, ["time", "a", "b", "c"], [[1, 5, 6, 7], [1, 2, 3, 4], [1, 1, 2, 3]])
    assert sr.combine([x], "sum").events()[0] == {"time": 1, "a": 8, "b": 11, "c": 14}
    for kind, want in (("max", 7), ("min", 3), ("count", 3), ("first", 7), ("last", 3), ("difference", 4)):
        assert sr.combine([x], kind, "c").events()[0]["c"] == want
    assert sr.avg_series([x], ["a"]).events()[0]["a"] == pytest.approx(8 / 3)
    with pytest.raises(SeriesError):
        sr.merge([a, b.rate("out")])
    assert a.rows_by_key().count() == 4 and a.columns_as_lists().first()["in"] == [52, 18, 26, 93]
    assert sr.reduce_series([a, a], lambda s: s.dedup()).size() == 4


def test_sum_of_series_with_different_starts(spark):
    idx = [f"5m-{4855968 + i}" for i in range(10)]
    parts = [(idx, 0), (idx, 1), (idx[:5], 1), (idx[3:7], 1), (idx[5:], 1)]
    series = [wire(spark, ["index", "in"], [[i, v] for i in names]) for names, v in parts]
    got = sr.sum_series(series, "in").df.orderBy("_t").collect()
    assert [x["in"] for x in got] == [2, 2, 2, 3, 3, 3, 3, 2, 2, 2]


def test_times_and_ranges(spark):
    jan, feb, mar, jun, jul, aug, sep, nov = (int(datetime(2014, m, 1, tzinfo=UTC).timestamp() * 1000) for m in (1, 2, 3, 6, 7, 8, 9, 11))
    assert TimeRange(jan, sep).overlaps(TimeRange(aug, nov)) and not TimeRange(jan, feb).overlaps(TimeRange(mar, jun))
    assert not TimeRange(jan, sep).overlaps(TimeRange(feb, mar)) and TimeRange(jan, jul).intersection(TimeRange(jun, aug)) == TimeRange(jun, jul)
    assert TimeRange(jan, feb).intersection(TimeRange(mar, jun)) is None and TimeRange(jan, sep).contains(TimeRange(feb, mar))
    assert TimeRange(jan, feb).extents(TimeRange(mar, jun)) == TimeRange(jan, jun) and not TimeRange(jan, feb).disjoint(TimeRange(feb, mar))
    for bad in ((5, 4), (1.5, 2), (datetime(2014, 1, 1), datetime(2014, 1, 2)), (1, datetime(2014, 1, 1, tzinfo=UTC))):
        with pytest.raises(TimeError):
            TimeRange.of(*bad)
    assert TimeRange(0, 86_400_000).humanize_duration() == "a day" and TimeRange(0, 43_200_000).humanize_duration() == "12 hours"
    now = datetime(2015, 3, 31, tzinfo=UTC)
    assert sr.last_month(now).begin == int(datetime(2015, 2, 28, tzinfo=UTC).timestamp() * 1000) and sr.last_days(7, now).duration() == 7 * 86_400_000
    assert Index("1d-12355").timerange() == TimeRange(1_067_472_000_000, 1_067_558_400_000)
    for text, end in (("2014", datetime(2014, 12, 31, 23, 59, 59)), ("2014-09", datetime(2014, 9, 30, 23, 59, 59)), ("2015-12", datetime(2015, 12, 31, 23, 59, 59)), ("2014-09-17", datetime(2014, 9, 17, 23, 59, 59))):
        assert Index(text).end() == int(end.replace(tzinfo=UTC).timestamp() * 1000)
    for bad in ("12-34-56-78", "12-34-5a", "1d-234a", "198o", "2015-9@"):
        with pytest.raises(TimeError):
            Index(bad).timerange()
    assert Index.of("5m", datetime(2015, 3, 14, 7, 32, 22, tzinfo=UTC)).text == "5m-4754394"
    whole = TimeRange(int(datetime(2015, 3, 14, 7, 30, tzinfo=UTC).timestamp() * 1000), int(datetime(2015, 3, 14, 8, 29, 59, tzinfo=UTC).timestamp() * 1000))
    assert len(Index.all_of("5m", whole)) == 12 and Index.all_of("5m", whole)[-1] == "5m-4754405"
    assert [Index(t).nice() for t in ("2014-09-17", "2014-09", "2014", "1h-5")] == ["September 17 2014", "September", "2014", "1h-5"]


def test_index_columns_match_python(spark):
    from chronoweave.functions import timekeys as tk

    texts = ["1h-123554", "5m-4135541", "30s-41135541", "1d-12355", "2014", "2014-09", "2015-12", "2014-09-17", "198o", "2015-13", "1d-234a", None]
    df = spark.createDataFrame([(t,) for t in texts], "k string")
    for tz in ("UTC", "America/New_York"):
        b, e = tk.index_range(F.col("k"), tz)
        for row in df.select("k", b.alias("b"), e.alias("e")).collect():
            try:
                want = tk.range_of_index(row["k"], tz) if row["k"] else (None, None)
            except TimeError:
                want = (None, None)
            assert (row["b"], row["e"]) == want, row


def test_session_zone_has_no_say(spark):
    from chronoweave.functions import timekeys as tk

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = spark.range(1).select(tk.calendar_key(F.lit(1_409_529_600_000), "daily"), tk.time_text(F.lit(1_426_318_342_000))).first()
        assert tuple(got) == ("2014-09-01", "Sat, 14 Mar 2015 07:32:22 UTC")
        df = spark.createDataFrame([("2024-01-01 00:00:00",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("ts"))
        assert Series.from_frame(df, time="ts").df.first()["_t"] == 1_704_067_200_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_bad_pipelines(spark, hourly):
    p = Pipeline().from_source(hourly)
    for bad in (lambda: Pipeline().series(), lambda: Pipeline().from_source(5), lambda: p.emit_on("never"), lambda: p.window_by("soon"), lambda: p.window_by("1h", "Asia/Tokyo"), lambda: p.aggregate({"x": {"a": r.avg(), "b": r.avg()}}), lambda: p.map(lambda d: d.drop("_t")), lambda: p.filter(5)):
        with pytest.raises(ChronoweaveError):
            bad()
    with pytest.raises(SeriesError):
        Series.from_frame(spark.createDataFrame([(1, 2)], "_t long, time long"), time="time")
    assert p.state()["mode"] == "batch"


def test_scalar_events(spark):
    assert read_events(spark, [(1, 5), (2, {"value": 6, "more": "x"})]).events() == [{"time": 1, "value": 5, "more": None}, {"time": 2, "value": 6, "more": "x"}]


def test_three_steps_and_by_columns(spark):
    rows = [(k, t * 60_000, None if t % 4 == 1 else float(t * (1 + (k == "b")))) for k in "ab" for t in range(12)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    s = Series.from_frame(df, time="t", by=("k",), split_ms=180_000)
    x = s.fill("v", "linear").align("v", "2m").rate("v")
    assert {round(e["v_rate"] * 60, 9) for e in x.events() if e["k"] == "a"} == {1.0}
    assert {round(e["v_rate"] * 60, 9) for e in x.events() if e["k"] == "b"} == {2.0}
    assert {r_["k"]: r_["end_ms"] for r_ in s.extents().collect()} == {"a": 660_000, "b": 660_000}


@pytest.mark.parametrize("split_rows", [10, 1_000_000])
def test_heavy_buckets_are_halved_and_change_nothing(spark, monkeypatch, split_rows):
    from chronoweave.operators import neighbours

    monkeypatch.setattr(neighbours, "SPLIT_ROWS", split_rows)
    monkeypatch.setattr(neighbours, "SPLIT_BYTES", 0)
    rows = [(i, "a", None if i < 5 else 1_000 + (i // 3) * (7 if i < 150 else 900_000), None if i % 4 else float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, name string, ms long, value double")
    one = Series.from_frame(df, time="ms", order="id", by=("name",), split_ms=None).fill("value", "linear")
    cut = Series.from_frame(df, time="ms", order="id", by=("name",)).fill("value", "linear")
    assert sorted(map(str, cut.df.collect())) == sorted(map(str, one.df.collect()))
    probes = Series.from_frame(df.where("id % 7 = 0").withColumn("ms", F.col("ms") + 3).drop("value"), time="ms", order="id", by=("name",))
    a, b = (Series.from_frame(df.where("ms is not null"), time="ms", order="id", by=("name",), split_ms=x).as_of(probes) for x in (None, 86_400_000))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_events_are_added_after_those_that_were_there(spark):
    s = read_events(spark, [(1000, 1.0), (2000, 2.0)])
    more = s.add_event(500, 3.0).add_event(500, {"value": 4.0}).add_events(s)
    assert [(e["time"], e["value"]) for e in more.events()] == [(1000, 1.0), (2000, 2.0), (500, 3.0), (500, 4.0), (1000, 1.0), (2000, 2.0)]
    assert [e["value"] for e in more.sort_by_time().events()] == [3.0, 4.0, 1.0, 1.0, 2.0, 2.0]
    spans = read_events(spark, [([0, 10], 1.0)], "timerange").add_event([5, 6], 2.0)
    days = read_events(spark, [("1d-3", 1.0)], "index").add_event("1d-2", 2.0)
    assert spans.events()[1] == {"timerange": [5, 6], "value": 2.0} and days.events()[1] == {"index": "1d-2", "value": 2.0}
    assert days.df.where("_k = '1d-2'").first()["_t"] == 2 * 86_400_000
    with pytest.raises(FieldError):
        s.add_event(1, {"other": 1})
    with pytest.raises(SeriesError):
        s.add_events(spans)
    assert s.set_events(None).events() == [] and s.set_events(more).size() == 6


def test_duplicates_by_key_and_payload(spark):
    s = read_events(spark, [(1, 1.0), (1, 2.0), (2, 5.0), (2, 5.0), (3, None), (3, None), (4, 1.0)])
    assert [r["_duplicate"] for r in s.is_duplicate().orderBy("_ord").collect()] == [True] * 6 + [False]
    assert [r["_duplicate"] for r in s.is_duplicate(ignore_values=False).orderBy("_ord").collect()] == [False, False, True, True, True, True, False]


def test_pairs_of_a_function_are_reduced(spark):
    s = read_events(spark, [(1, {"a": 1.0, "b": 2.0}), (2, {"a": None, "b": 4.0})])
    x = s.map_reduce(lambda row: {"b": row["b"]} | ({"a": row["a"]} if row["a"] is not None else {}), r.avg())
    assert sorted((y["key"], y["value"]) for y in x.collect()) == [("a", 1.0), ("b", 3.0)]
    assert s.map_pairs(lambda row: {}).count() == 0
    assert Pipeline().from_source(s).group_by(lambda row: None if row["a"] is None else f"{row['a']:.0f}").aggregate({"n": {"b": r.count()}}).series().df.where("_group is null").first()["n"] == 1


def test_outputs_and_their_observers(spark):
    seen, ends = [], []
    p = Pipeline().from_source(read_events(spark, [(1, 1.0), (2, 2.0)]))
    p.to(seen.append, ends.append).on_emit(print)
    Pipeline().from_source(p.series().empty()).to(seen.append, ends.append)
    assert [e["value"] for e in seen] == [1.0, 2.0] and ends == [2, None]


def test_broadcasts_are_measured(spark, monkeypatch):
    from chronoweave.plans import scale

    df = spark.range(100).selectExpr("id", "repeat('x', 100) AS s")
    assert scale.settled(df)[1] and scale.settled(df)[0].count() == 100
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 5_000)
    assert not scale.settled(df)[1]
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 1 << 20)
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 99)
    assert not scale.settled(df)[1] and "broadcast" not in scale.sized_broadcast(df)._jdf.queryExecution().logical().toString().lower()
    kept = scale.keep(df)
    assert kept.is_cached
    scale.release()
    assert not df.is_cached or not df.storageLevel.useMemory
