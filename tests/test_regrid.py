"""The regular grid against the weighted normal equations solved by numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators.regrid import LEAST_SPREAD, regular_series, step_millis

SCHEMA = "source string, step_ms long, ms long, value double"


def run(spark, rows, **kw):
    return {(r["source"], r["slot_ms"]): r for r in regular_series(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


@pytest.mark.parametrize("degree", [0, 1, 2])
def test_against_least_squares(spark, degree):
    rng = np.random.default_rng(5)
    ms = np.sort(rng.choice(60_000, 90, replace=False))
    ms = ms[(ms < 20_000) | (ms > 33_000)]
    y = np.sin(ms / 9_000) * 5 + rng.normal(0, 0.1, len(ms))
    got = run(spark, [("a", 1000, int(t), float(v)) for t, v in zip(ms, y, strict=True)], radius=3, degree=degree)
    first, last = ms[0] // 1000, ms[-1] // 1000
    assert set(got) == {("a", k * 1000) for k in range(first, last + 1)}
    for (_, slot), r in got.items():
        d = (ms - slot) / 3000
        w = np.where(np.abs(d) < 1, (1 - np.abs(d) ** 3) ** 3, 0)
        support = w.sum() ** 2 / (w**2).sum() if w.sum() > 0 else 0.0
        assert r["support"] == pytest.approx(support, abs=1e-9)
        assert r["n"] == ((ms // 1000) == slot // 1000).sum()
        assert r["mark"] == ("observed" if r["n"] else "filled" if support >= 1.5 else "missing")
        if r["mark"] == "missing":
            assert r["value"] is None
            continue
        m = [(w * d**p).sum() for p in range(5)]
        dets = {1: m[0] * m[2] - m[1] ** 2, 2: np.linalg.det([m[0:3], m[1:4], m[2:5]])}
        fit = max([0] + [k for k in (1, 2) if k <= degree and dets[k] > 1.1 * LEAST_SPREAD[k] * m[0] ** (k + 1)])
        if all(abs(dets[k] / m[0] ** (k + 1) / LEAST_SPREAD[k] - 1) > 0.1 for k in (1, 2)):
            x = np.stack([d**p for p in range(fit + 1)], axis=1)
            beta = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
            assert r["value"] == pytest.approx(beta[0], abs=1e-5)


def test_close_readings_give_no_slope(spark):
    got = run(spark, [("a", 1000, 0, 1.0), ("a", 1000, 1, 500.0), ("a", 1000, 3000, 2.0)])
    assert 240 < got["a", 0]["value"] < 260


def test_dirty_points(spark):
    rows = [("a", 1000, 0, 1.0), ("a", 1000, 0, 1.0), ("a", 1000, 0, 3.0), ("a", 1000, 5500, float("nan")), ("a", 1000, 5500, None), ("a", 1000, None, 2.0), ("a", None, 3, 2.0), ("a", 1000, 4000, 2.0), (None, 1000, 10, 1.0)]
    got = run(spark, rows)
    assert got["a", 0]["n"] == 2 and ("a", 5000) not in got and got["a", 4000]["mark"] == "observed"
    assert got["a", 2000]["n"] == 0 and (None, 0) in got
    assert run(spark, []) == {}


def test_negative_times_and_long_hole(spark):
    got = run(spark, [("a", 1000, -1500, 1.0), ("a", 1000, 9_000_000, 2.0)])
    assert len(got) == 9_003 and got["a", -2000]["n"] == 1 and got["a", 5_000_000]["mark"] == "missing"


def test_steps(spark):
    df = spark.createDataFrame([("30s",), ("1m",), (" 5m ",), ("2h",), ("1d",), ("0s",), ("x",), (None,), ("5 m",)], "s string")
    assert [r[0] for r in df.select(step_millis(F.col("s"))).collect()] == [30_000, 60_000, 300_000, 7_200_000, 86_400_000, None, None, None, None]


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        run(spark, [], degree=3)
