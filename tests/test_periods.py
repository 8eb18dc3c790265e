"""Merging of intervals against a plain sweep."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoweave.operators.periods import merge_periods, pack, unite, unpack

SCHEMA = "id long, name string, b long, e long, version long"


def run(spark, rows, shard_ms=100):
    df = spark.createDataFrame(rows, SCHEMA)
    x = merge_periods(df, F.col("name"), F.col("b"), F.col("e"), F.col("id"), F.col("version"), shard_ms)
    return sorted(tuple(r) for r in x.fillna("~", ["entity"]).collect())


def brute(rows):
    best = {}
    for i, n, b, e, v in rows:
        if b is None or e is None or b >= e:
            continue
        k = (i, None if i is not None else (n, b, e))
        if k not in best or (v or 0, b, e) > best[k][0]:
            best[k] = ((v or 0, b, e), n)
    out = []
    names = {n for _, n in best.values()}
    for n in names:
        spans = sorted((b, e) for (_, b, e), m in best.values() if m == n)
        periods = []
        for b, e in spans:
            if periods and b <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], e)
                periods[-1][2] += 1
            else:
                periods.append([b, e, 1])
        out += [(n or "~", "period", b, e, c) for b, e, c in periods]
        out += [(n or "~", "gap", p[1], q[0], 0) for p, q in zip(periods, periods[1:], strict=False)]
    return sorted(out)


def test_overlap_nest_touch_and_gap(spark):
    rows = [(1, "a", 0, 50, 0), (2, "a", 10, 20, 0), (3, "a", 50, 60, 0), (4, "a", 61, 350, 0), (5, "b", 100, 200, 0), (6, "b", 200, 300, 0), (7, "a", 900, 901, 0)]
    assert run(spark, rows) == brute(rows)
    assert ("a", "gap", 60, 61, 0) in run(spark, rows)
    assert ("b", "period", 100, 300, 2) in run(spark, rows)


def test_bad_repeated_and_null_records(spark):
    rows = [(1, "a", 5, 5, 0), (2, "a", 9, 3, 0), (3, "a", None, 3, 0), (4, "a", 1, None, 0), (5, "a", 0, 10, 1), (5, "a", 0, 20, 2), (5, "a", 0, 10, 1), (None, "a", 30, 40, 0), (None, "a", 30, 40, 0), (None, None, 1, 2, 0), (8, None, 4, 6, 0)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_negative_times_and_whole_shards(spark):
    rows = [(1, "a", -250, -50, 0), (2, "a", -50, 100, 0), (3, "a", 100, 400, 0), (4, "a", 500, 700, 0)]
    assert run(spark, rows) == brute(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["a", "b", None]), st.integers(-300, 600), st.integers(-300, 600), st.just(0)), max_size=40))
def test_random(spark, rows):
    rows = list({r[0]: r for r in rows}.values())
    assert run(spark, rows) == brute(rows)


def test_pack_round_trip():
    b, e, n = np.array([0, 10]), np.array([5, 86_400_000]), np.array([1, 3])
    assert all((x == y).all() for x, y in zip(unpack(pack(b, e, n)), (b, e, n), strict=True))
    k, b, e, n = unite(np.array([1, 0, 1]), np.array([5, 7, 0]), np.array([9, 8, 5]), np.array([1, 1, 1]))
    assert (k.tolist(), b.tolist(), e.tolist(), n.tolist()) == ([0, 1], [7, 0], [8, 9], [1, 2])


def test_large_inputs_unite_in_salted_parts(spark, monkeypatch):
    import random

    from chronoweave.operators import periods

    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "a", "a", None, "b"]), b := rng.randint(0, 900), b + rng.randint(-2, 30), 0) for i in range(400)]
    monkeypatch.setattr(periods, "SPLIT_BYTES", 0)
    monkeypatch.setattr(periods, "SALTS", 3)
    monkeypatch.setattr(periods, "HELD_RUNS", 1)
    assert run(spark, rows) == brute(rows)


def test_whole_groups_never_splits_a_key():
    import random

    import pandas as pd

    from chronoweave.plans.scale import whole_groups

    rng = random.Random(3)
    for rows in (1, 5, 40):
        keys = sorted((rng.choice("abc"), rng.randint(0, 3)) for _ in range(60))
        x = pd.DataFrame([(None if k == "c" else k, i, at) for at, (k, i) in enumerate(keys)], columns=["k", "i", "at"])
        cuts = [0, *sorted(rng.sample(range(1, 60), 9)), 60]
        got = list(whole_groups(iter([x.iloc[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] + [x.iloc[:0]]), ["k", "i"], rows))
        assert pd.concat(got)["at"].tolist() == list(range(60))
        ends = [tuple(map(str, f[["k", "i"]].iloc[j])) for f in got for j in (0, -1)]
        assert all(a != b for a, b in zip(ends[1::2], ends[2::2], strict=False))
