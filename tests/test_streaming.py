"""Streams give what batches give; the steps give the same however a stream is cut."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoweave.errors import PipelineError
from chronoweave.functions import reducers as r
from chronoweave.operators.series import Series
from chronoweave.plans.pipeline import Pipeline
from chronoweave.streaming import stateful
from chronoweave.streaming.aggregate import start, with_watermark
from chronoweave.streaming.source import read_stream
from chronoweave.streaming.steps import AlignStep, FillStep, RateStep, TakeStep, is_valid, number

SCHEMA = "k string, t long, id long, v double"


def rows(n=120):
    rng = random.Random(7)
    out = []
    t = {"a": 0, "b": 500}
    for i in range(n):
        k = "ab"[i % 2]
        t[k] += rng.randint(1, 90_000)
        out.append((k, t[k], i, None if rng.random() < 0.3 else round(rng.gauss(10, 5), 3)))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The rows in four files, in time order."""
    path = str(tmp_path_factory.mktemp("in"))
    data = rows()
    for i in range(4):
        spark.createDataFrame(data[i * 30 : (i + 1) * 30], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def streamed(spark, folder, make, tmp_path, mode="append", emit="eachEvent"):
    s = read_stream(spark, folder, SCHEMA, files_per_batch=1, time="t", order="id", by=("k",))
    x = make(s)
    p = x if isinstance(x, Pipeline) else Pipeline().from_source(x).emit_on(emit)
    q = start(p, lambda df, i: df.withColumn("_batch", F.lit(i)).write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "state"), mode=mode)
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def batch(spark):
    return Series.from_frame(spark.createDataFrame(rows(), SCHEMA), time="t", order="id", by=("k",))


def table(df, *cols):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize(("name", "stream", "plain", "cols"), [
    ("rate", lambda s: stateful.stream_rate(s, "v"), lambda s: s.rate("v"), ("k", "_t", "_e", "v_rate")),
    ("align", lambda s: stateful.stream_align(s, "v", "1m"), lambda s: s.align("v", "1m"), ("k", "_t", "v")),
    ("hold", lambda s: stateful.stream_align(s, "v", "30s", "hold", 2), lambda s: s.align("v", "30s", "hold", 2), ("k", "_t", "v")),
    ("pad", lambda s: stateful.stream_fill(s, "v", "pad", 2), lambda s: s.fill("v", "pad", 2), ("k", "_t", "id", "v")),
    ("zero", lambda s: stateful.stream_fill(s, "v", "zero"), lambda s: s.fill("v", "zero"), ("k", "_t", "id", "v")),
])
def test_stateful_steps(spark, folder, tmp_path, name, stream, plain, cols):
    cols = [c for c in cols if c != "id"] if name in ("rate", "align", "hold") else list(cols)
    assert table(streamed(spark, folder, stream, tmp_path), *cols) == table(plain(batch(spark)).df, *cols)


def test_linear_fill_holds_back(spark, folder, tmp_path):
    got = table(streamed(spark, folder, lambda s: stateful.stream_fill(s, "v", "linear", 3), tmp_path), "k", "_t", "v")
    want = table(batch(spark).fill("v", "linear", 3).df, "k", "_t", "v")
    assert set(got) <= set(want) and len(want) - len(got) <= 4


def test_take(spark, folder, tmp_path):
    got = streamed(spark, folder, lambda s: stateful.stream_take(s, 5), tmp_path)
    assert got.groupBy("k").count().where("count = 5").count() == 2


def test_pipelines_of_streams_use_the_stateful_steps(spark, folder, tmp_path):
    def make(s):
        return Pipeline().from_source(s).filter(F.col("v").isNotNull()).rate("v")

    cols = ("k", "_t", "_e", "v_rate")
    assert table(streamed(spark, folder, make, tmp_path / "a"), *cols) == table(batch(spark).clean("v").rate("v").df, *cols)
    got = streamed(spark, folder, lambda s: Pipeline().from_source(s).window_by("1h").group_by("k").take(2), tmp_path / "b")
    want = Pipeline().from_source(batch(spark)).window_by("1h").group_by("k").take(2).series().df
    assert table(got, "k", "_t", "id") == table(want, "k", "_t", "id")


def test_windows_by_trigger(spark, folder, tmp_path):
    fields = {"n": {"v": r.count()}, "hi": {"v": r.maximum()}, "last": {"v": r.last()}}
    want = table(Pipeline().from_source(batch(spark)).window_by("10m").group_by("k").aggregate(fields).series().df, "_k", "_group", "n", "hi", "last")

    def run(emit, place):
        return streamed(spark, folder, lambda s: Pipeline().from_source(with_watermark(s, "5 minutes")).window_by("10m").group_by("k").emit_on(emit).aggregate(fields), place, None)

    for emit in ("eachEvent", "flush"):
        x = run(emit, tmp_path / emit)
        last = x.groupBy("_k", "_group").agg(F.max_by(F.struct("n", "hi", "last"), "_batch").alias("v")).select("_k", "_group", "v.*")
        assert table(last, "_k", "_group", "n", "hi", "last") == want
    done = table(run("discard", tmp_path / "discard"), "_k", "_group", "n", "hi", "last")
    assert len(set(done)) == len(done) and set(done) <= set(want) and len(done) >= len(want) - 6


@pytest.mark.parametrize("emit", ["eachEvent", "flush"])
@pytest.mark.parametrize("window", ["10m", "daily"])
def test_late_rows_join_their_windows(spark, tmp_path, emit, window):
    """Micro-batches from the latest to the earliest rows, a day apart, without a watermark of the caller's."""
    data = [(k, t + 86_400_000 * (i // 30), i, v) for k, t, i, v in rows()]
    path = str(tmp_path / "late")
    for i in reversed(range(4)):
        spark.createDataFrame(data[i * 30 : (i + 1) * 30], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    fields = {"n": {"v": r.count()}, "hi": {"v": r.maximum()}, "lo": {"v": r.minimum()}, "avg": {"v": r.avg("ignore")}}

    def windows(s):
        return Pipeline().from_source(s).window_by(window).group_by("k").emit_on(emit).aggregate(fields)

    whole = Series.from_frame(spark.createDataFrame(data, SCHEMA), time="t", order="id", by=("k",))
    x = streamed(spark, path, windows, tmp_path, None)
    assert x.select("_batch").distinct().count() == 4
    last = x.groupBy("_k", "_group").agg(F.max_by(F.struct("n", "hi", "lo", "avg"), "_batch").alias("v")).select("_k", "_group", "v.*")
    cols = ("_k", "_group", "n", "hi", "lo", "avg")
    assert table(last, *cols) == table(windows(whole).series().df, *cols)


def test_stream_errors(spark, folder):
    s = read_stream(spark, folder, SCHEMA, time="t", order="id")
    p = Pipeline().from_source(s)
    assert p.mode == "stream"
    for bad in (lambda: p.window_by("monthly").emit_on("discard").aggregate({"n": {"v": r.count()}}), lambda: start(Pipeline().from_source(batch(spark)), "x"), lambda: stateful.stream_rate(s, "no"), lambda: stateful.stream_rate(batch(spark), "v")):
        with pytest.raises(PipelineError):
            bad()


def test_known_linear_stream():
    f = FillStep([0], "linear")
    out = [len(f.push([(1000 * i, [v])])) for i, v in enumerate([1, 2, None, 3, None, None, None, None])]
    assert sum(out) == 4 and len(f.flush()) == 4
    g = FillStep([0], "linear", 3)
    assert sum(len(g.push([(1000 * i, [v])])) for i, v in enumerate([1, 2, None, 3, None, None, None, None])) == 8
    h = FillStep([0], "linear")
    got = h.push([(1000 * i, [v]) for i, v in enumerate([1, 2, None, None, None, 5, 6, 7])])
    assert [v[0] for _, v in got] == [1, 2, 2.75, 3.5, 4.25, 5, 6, 7]


VALUES = st.lists(st.one_of(st.none(), st.integers(-50, 50), st.just(""), st.just("text"), st.just(float("nan"))), max_size=25)


@settings(max_examples=60, deadline=None)
@given(VALUES, st.integers(1, 5), st.sampled_from(["zero", "pad", "linear"]), st.one_of(st.none(), st.integers(1, 4)))
def test_cutting_a_stream_changes_nothing(values, size, method, limit):
    data = [(700 * i, [v]) for i, v in enumerate(values)]
    for make in (lambda: FillStep([0], method, limit), lambda: AlignStep(1000, "hold" if method == "pad" else "linear", limit), lambda: RateStep(method == "zero"), lambda: TakeStep(limit or 3)):
        whole, parts = make(), make()
        a = whole.push(data) + whole.flush()
        b = [x for i in range(0, len(data), size) for x in parts.push(data[i : i + size])] + parts.flush()
        assert repr(a) == repr(b)


def test_validity_of_python_values():
    assert [is_valid(v) for v in (None, "", " NaN ", "x", float("nan"), 0, False)] == [False, False, False, True, False, True, True]
    assert [number(v) for v in ("5", "x", True, 2)] == [5.0, None, None, 2.0]
