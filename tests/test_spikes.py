"""Flags of readings against the plain rule over whole sources, for one chunk and for many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators.spikes import SpikeRules, around, control_charts, flag_readings

SCHEMA = "id long, name string, ms long, value double, top double"


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    gone = F.col("value").isNull() | F.isnan("value")
    x = flag_readings(df, F.col("id"), F.col("name"), F.col("ms"), F.col("value"), F.col("top"), gone, **kw)
    return {r["reading_id"]: r["flaw"] for r in x.collect()}


def brute(rows):
    """The rule itself: every reading's distance from the median around it, without any chart. Windows do not reach beyond
    the segment's halo."""
    out = {}
    seen = {}
    for i, n, t, v, top in rows:
        if v is not None and v == v and t is not None:
            seen.setdefault(n, {}).setdefault((t, i), (i, v, top))
    for readings in seen.values():
        rs = [readings[k] for k in sorted(readings)]
        v = np.array([r[1] for r in rs])
        top = rs[0][2] if rs[0][2] is not None else np.inf
        bad = (v < 0) | (v > top)
        out.update({r[0]: "impossible" for r, b in zip(rs, bad, strict=True) if b})
        if np.unique(v, return_counts=True)[1].max() * 2 > len(v):
            continue
        runs = np.cumsum(np.r_[True, v[1:] != v[:-1]]) - 1
        stuck = (np.bincount(runs)[runs] >= 8) & ~bad
        out.update({r[0]: "stuck" for r, s in zip(rs, stuck, strict=True) if s})
        rest = np.flatnonzero(~bad & ~stuck)
        if not len(rest):
            continue
        away = v[rest] - around(v[rest], 7)
        sc = np.median(np.abs(away))
        i = 0
        while sc > 0 and i < len(rest):
            j = i
            if abs(away[i]) > 5 * sc:
                while j + 1 < len(rest) and abs(away[j + 1]) > 5 * sc and np.sign(away[j + 1]) == np.sign(away[i]):
                    j += 1
                if j - i < 3:
                    out.update({rs[rest[k]][0]: "spike" for k in range(i, j + 1) if abs(away[k]) > 10 * sc})
            i = j + 1
    return out


def source(name, n, seed, base=500.0, first=0):
    rng = np.random.default_rng(seed)
    day = 86_400_000
    ms = np.cumsum(rng.integers(200_000, 400_000, n))
    v = base + 80 * np.sin(ms / day * 6.283) + rng.normal(0, 4, n)
    if n > 200:
        for at in range(37, n - 50, 97):
            v[at : at + 1 + at % 3] += rng.choice([-1, 1]) * 120
        v[n // 2 : n // 2 + 12] = 333.25
        v[n // 3 :] += 150
        v[60] = -1.0
        v[70] = 5_000.0
    return [(first + i, name, int(t), float(x), 2_000.0) for i, (t, x) in enumerate(zip(ms, v, strict=True))]


def test_against_the_rule(spark):
    rows = source("a", 3000, 1) + source("b", 400, 2, first=10_000) + source("c", 5, 3, first=20_000)
    got = run(spark, rows)
    assert got == brute(rows)
    assert {"impossible", "stuck", "spike"} == set(got.values())


@pytest.mark.parametrize("chunk_rows", [300, 1000, 100_000])
def test_chunks_change_nothing(spark, chunk_rows):
    rows = source("a", 6000, 1) + source("b", 400, 2, first=10_000)
    rows += [(20_000 + i, "idle", i * 1000, 4.0 if i % 7 else 4.0 + i, None) for i in range(4000)]
    rows += [(30_000 + i, "constant", i * 1000, 9.0, 100.0) for i in range(4000)]
    # a heavy second within a heavy day, a stuck run over several segments, repeats, a source without a name, half of one value
    rows += [(40_000 + i, "burst", i // 4 if i < 3000 else 40_000 * i, 100.0 + (i * 7919) % 13 + (500.0 if i % 211 == 5 else 0.0), None) for i in range(5000)]
    rows += [(50_000 + i, "long run", i * 300_000, 5.0 if 500 < i < 2400 else 50.0 + (i * 31) % 17 + (900.0 if i % 307 == 9 else 0.0), None) for i in range(5000)]
    rows += [(60_000 + i, None, i * 60_000, 50.0 + (i * 31) % 17 + (900.0 if i % 307 == 9 else 0.0), None) for i in range(2000)]
    rows += [(70_000 + i, "half", i * 60_000, 50.0 if i % 2 else 51.0 + (i * 31) % 17, None) for i in range(4000)]
    rows += rows[::5]
    want = brute(rows)
    assert run(spark, rows, chunk_rows=chunk_rows) == want
    assert not any(20_000 <= i < 40_000 for i in want) and any(want.get(i) == "spike" for i in range(40_000, 43_000))


def test_what_the_chart_marks_does_not_depend_on_chunks(spark):
    rows = source("a", 6000, 1) + source("b", 400, 2, first=10_000)
    whole = run(spark, rows, by_chart=True)
    assert run(spark, rows, by_chart=True, chunk_rows=500) == whole
    planted = {i for i, f in run(spark, rows).items() if f == "spike"}
    assert len(planted & {i for i, f in whole.items() if f == "spike"}) >= 0.7 * len(planted)


def test_repeats_ties_nulls_idle_and_empty(spark):
    rows = source("a", 500, 4)
    rows += rows[::3]
    rows += [(30_000, "a", None, 5.0, 2000.0), (30_001, "a", 77, None, 2000.0), (30_002, "a", 78, float("nan"), 2000.0)]
    rows += [(40_000 + i, "idle", i * 1000, 0.0 if i % 5 else 900.0, 100.0) for i in range(200)]
    rows += [(50_000 + i, None, i * 1000, float(i % 3), None) for i in range(50)]
    rows += [(60_000 + i, "flat", i * 1000, 7.0, None) for i in range(20)] + [(61_000, "one", 5, 3.0, 1.0)]
    rows += [(70_000 + i, "ties", 1000 * (i // 2), float(i % 11), None) for i in range(300)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert {got[i] for i in got if 40_000 <= i < 41_000} == {"impossible"}
    assert got[61_000] == "impossible" and not any(60_000 <= i < 60_100 for i in got)
    assert run(spark, []) == {}


def test_chart_recentres_after_a_lasting_change():
    x = [10.0, 10.1, 9.9, 10.0] * 10 + [50.0, 50.1, 49.9, 50.0] * 20
    marks, short = control_charts([np.array(x), np.array(x[:41])], np.array([10.0, 10.0]), np.array([0.1, 0.1]), SpikeRules())
    assert marks[40:44].all() and not marks[90:].any() and (short == marks[:41]).all()
