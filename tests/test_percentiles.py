"""Exact percentiles against sorted lists, with and without ranges, from rows and from partial counts."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from chronoweave.operators.percentiles import interpolated, percentiles, value_counts

MARKS = {"p50": Fraction(1, 2), "p90": Fraction(9, 10), "p99": Fraction(99, 100), "p0": Fraction(0), "p100": Fraction(1)}


def brute(values, p):
    v = sorted(values)
    n = len(v)
    rank = max(1, -(-n * p.numerator // p.denominator))
    return v[rank - 1]


def data():
    rng = random.Random(3)
    rows = [(i, "hot", float(rng.choice([1, 2, 3, rng.gauss(0, 50)])), i % 4) for i in range(3000)]
    rows += [(4000 + i, "idle", 7.0, i % 4) for i in range(700)]
    rows += [(5000 + i, f"s{i % 5}", rng.random(), i % 4) for i in range(300)]
    return rows + [(9000, None, 4.0, 0), (9001, "nan", float("nan"), 0), (9002, "null", None, 0), (9003, "hot", None, 0)]


@pytest.mark.parametrize("range_rows", [100, 10**9])
def test_rows_and_partials(spark, range_rows):
    rows = data()
    df = spark.createDataFrame(rows + rows[:500], "id long, name string, value double, day int")
    want = {}
    for g in {r[1] for r in rows}:
        v = [r[2] for r in rows if r[1] == g and r[2] is not None and r[2] == r[2]]
        if v:
            want[g] = (len(v), *[brute(v, p) for p in MARKS.values()])
    got = {r["name"]: tuple(r)[1:] for r in percentiles(df, "name", "value", MARKS, distinct_by="id", range_rows=range_rows).collect()}
    assert got == want
    once = df.dropDuplicates(["id"])
    parts = [value_counts(once.where(F.col("day") == d), ["name"], "value") for d in range(4)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = {r["name"]: tuple(r)[1:] for r in percentiles(both, "name", "value", MARKS, count="n", range_rows=range_rows).collect()}
    assert got == want


def test_empty_zero_and_clashing_names(spark):
    df = spark.createDataFrame([], "name string, value double")
    assert percentiles(df, "name", "value", MARKS).count() == 0
    df = spark.createDataFrame([("a", 0.0, 1, 2), ("a", -0.0, 1, 2)], "name string, value double, n int, `p50` int")
    assert [tuple(r) for r in percentiles(df, "name", "value", {"p50": Fraction(1, 2)}).collect()] == [("a", 2, 0.0)]


@pytest.mark.parametrize("method", ["linear", "lower", "higher", "nearest", "midpoint"])
def test_interpolated_golden(spark, method):
    v = [22.3, 32.4, 12.1, 76.8, 87.3, 54.6, 45.5, 87.9]
    df = spark.createDataFrame([(0, x) for x in v], "g int, v double")
    got = interpolated(df, "g", "v", {f"q{i}": Fraction(i, 4) for i in (1, 2, 3)}, method, range_rows=3).first()
    want = {"linear": (29.875, 50.05, 79.425), "lower": (22.3, 45.5, 76.8), "higher": (32.4, 54.6, 87.3), "nearest": (32.4, 54.6, 76.8), "midpoint": (27.35, 50.05, 82.05)}[method]
    assert tuple(got)[2:] == pytest.approx(want, abs=1e-9)
