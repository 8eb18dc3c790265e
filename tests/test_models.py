"""Fill, align and rate in Spark against the plain steps, on random series, split in buckets and not."""

import random

import pytest

from chronoweave.operators.series import Series
from chronoweave.streaming.steps import AlignStep, FillStep, RateStep

SCHEMA = "k string, t long, id long, v double, w long"


def series(seed):
    rng = random.Random(seed)
    rows = []
    for k in "abc":
        t = rng.randint(-50_000, 50_000)
        for i in range(rng.choice([1, 2, 60])):
            t += rng.choice([0, 1, 900, 7_000, 40_000])
            gone = rng.random() < 0.45
            rows.append((k, t, len(rows), None if gone else rng.choice([float("nan"), float(rng.randint(-9, 9)), rng.random()]), None if gone else rng.randint(0, 9)))
    return rows


@pytest.mark.parametrize("split", [None, 10_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_steps(spark, seed, split):
    rows = series(seed)
    s = Series.from_frame(spark.createDataFrame(rows, SCHEMA), time="t", order="id", by=("k",), split_ms=split)
    per = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        per.setdefault(r[0], []).append((r[1], [r[3]], r[2]))

    def close(a, b):
        return (a is None or a != a) == (b is None or b != b) and (a is None or a != a or a == pytest.approx(b, abs=1e-9))

    for method in ("zero", "pad", "linear"):
        for limit in (None, 2):
            got = {r["id"]: r["v"] for r in s.fill("v", method, limit).df.collect()}
            for data in per.values():
                f = FillStep([0], method, limit)
                out = f.push([(t, v) for t, v, _ in data]) + f.flush()
                for (_, v), (_, old, i) in zip(out, data, strict=True):
                    assert close(got[i], v[0]), (method, limit, i, got[i], v, old)
    clean = s.clean("v")
    for method in ("linear", "hold"):
        for limit in (None, 3):
            got = {}
            for r in clean.align("v", "5s", method, limit).df.orderBy("_t", "_ord").collect():
                got.setdefault(r["k"], []).append((r["_t"], r["v"]))
            for k, data in per.items():
                want = AlignStep(5000, method, limit).push([(t, v) for t, v, _ in data if v[0] is not None and v[0] == v[0]])
                assert [t for t, _ in want] == [t for t, _ in got.get(k, [])]
                assert all(close(a, b[0]) for (_, a), (_, b) in zip(got.get(k, []), want, strict=True))
    for allow in (True, False):
        got = {}
        for r in clean.rate("v", allow).df.orderBy("_e", "_ord").collect():
            got.setdefault(r["k"], []).append((r["_t"], r["_e"], r["v_rate"]))
        for k, data in per.items():
            want = RateStep(allow).push([(t, v) for t, v, _ in data if v[0] is not None and v[0] == v[0]])
            assert [(p[0], t) for t, p in want] == [(a, b) for a, b, _ in got.get(k, [])]
            assert all(close(c, p[1]) for (_, _, c), (_, p) in zip(got.get(k, []), want, strict=True))


def test_rows_without_time_and_spans(spark):
    from pyspark.sql import functions as F

    from chronoweave.operators.series import TimeRange

    rows = [("a", None, 0, None, 1), ("a", 5, 1, 2.0, 1), ("a", 20_005, 2, None, 1), ("b", None, 3, 7.0, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [{r["id"]: r["v"] for r in Series.from_frame(df, time="t", order="id", by=("k",), split_ms=x).fill("v", "pad").df.collect()} for x in (None, 10_000)]
    assert got[0] == got[1] == {0: None, 1: 2.0, 2: 2.0, 3: 7.0}
    at = df.select("id", F.timestamp_millis("t").alias("ts"), F.timestamp_millis("t").cast("timestamp_ntz").alias("nt"), "t")
    for c in ("ts", "nt", "t"):
        assert [r["id"] for r in Series.from_frame(at, time=c, order="id", span=TimeRange(5, 20_004)).df.select(F.col("_ord").alias("id")).collect()] == [1]


def test_wire_files(spark, tmp_path):
    from chronoweave.sources.wire import read_wire_files, write_wire

    rows = [("x", 5, 0, 1.5, {"a": 1}), ("x", 7, 1, None, None), ('y"z', 6, 2, float(2**53), {"a": None})]
    df = spark.createDataFrame(rows, "name string, _t long, _ord long, v double, d struct<a:long>")
    write_wire(df).selectExpr("wire AS value").write.text(str(tmp_path / "w"))
    got = read_wire_files(spark, str(tmp_path / "w"), "v double, d struct<a:long>").orderBy("_t").collect()
    assert [(r["name"], r["_t"], r["v"], r["d"] and r["d"]["a"]) for r in got] == [("x", 5, 1.5, 1), ('y"z', 6, float(2**53), None), ("x", 7, None, None)]


def test_range_columns(spark):
    from itertools import product

    from pyspark.sql import functions as F

    from chronoweave.functions import ranges as rg
    from chronoweave.operators.series import TimeRange

    spans = [(a, b) for a, b in product(range(4), repeat=2) if a <= b]
    df = spark.createDataFrame([(*x, *y) for x, y in product(spans, spans)], "a long, b long, c long, d long")
    p, q = rg.time_range(F.col("a"), F.col("b")), rg.time_range(F.col("c"), F.col("d"))
    got = df.select("*", rg.contains(p, q).alias("contains"), rg.within(p, q).alias("within"), rg.overlaps(p, q).alias("overlaps"), rg.disjoint(p, q).alias("disjoint"), rg.intersection(p, q).alias("common"), rg.extents(p, q).alias("hull"), rg.duration(p).alias("ms"), rg.equals(p, q).alias("same")).collect()
    for r in got:
        x, y = TimeRange(r["a"], r["b"]), TimeRange(r["c"], r["d"])
        assert (r["contains"], r["within"], r["overlaps"], r["disjoint"], r["ms"], r["same"]) == (x.contains(y), x.within(y), x.overlaps(y), x.disjoint(y), x.duration(), x == y)
        assert tuple(r["hull"]) == (x.extents(y).begin, x.extents(y).end)
        assert (r["common"] and tuple(r["common"])) == (None if x.disjoint(y) else (x.intersection(y).begin, x.intersection(y).end))
    with pytest.raises(Exception, match="before it begins"):
        df.select(rg.time_range(F.lit(2), F.lit(1))).collect()
