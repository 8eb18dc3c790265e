"""Flags for impossible, stuck and spiking readings, per source.

A robust exponentially weighted control chart runs along each source: a reading outside the control limits is clipped to
them before it updates mean and scale; a run-length counter ends a run of clipped readings by re-centring the chart, so a
lasting change of level becomes the new level. Run-length counters over equal values give stuck readings, physical limits
impossible ones. What the chart marks in either direction of time is then checked exactly: the distance from the median
of the readings around it, against the source's scatter (the distance within which half of its readings lie).

A source is charted in segments of `SEGMENT` readings, by place in the source; a segment also sees `HALO` places before and
after it, which settle the chart and the windows. What a segment gives depends on its readings alone. So sources of more
than `chunk_rows` readings can be cut into chunks, each a task's work with the places around it, and get the flags
that they would get in one piece; scatter and idleness of such sources are counted exactly over all chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.cells import DAY_MS
from chronoweave.operators.percentiles import values_at_ranks
from chronoweave.plans.scale import cut, settled, sized_broadcast, whole_groups

#: Places of a source that are charted together, and those that a segment sees beyond its own on either side.
SEGMENT, HALO = 1024, 256

#: Readings of a source above which it is cut into chunks of about so many.
CHUNK_ROWS = 100_000

#: Time units of at most this part of a chunk are handed out whole; larger ones are counted in the next finer unit.
UNIT_SHARE = 16


@dataclass(frozen=True)
class SpikeRules:
    """Parameters of the flags."""

    stuck_run: int = 8
    spike_run: int = 3
    spike_scatters: float = 10.0
    return_scatters: float = 5.0
    half_window: int = 7
    weight: float = 0.15
    limit: float = 3.0


def control_charts(lanes: list[np.ndarray], centre: np.ndarray, scale: np.ndarray, rules: SpikeRules) -> list[np.ndarray]:
    """Whether each reading of each lane lies outside the limits of the lane's chart so far; all lanes run side by side."""
    if not lanes:
        return []
    sizes = np.array([len(x) for x in lanes])
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max())
    grid = np.zeros((longest, len(lanes)))
    for at, k in enumerate(order):
        grid[: sizes[k], at] = lanes[k]
    # lanes still running at each step: those at the front, as they are sorted by length
    running = np.searchsorted(-sizes[order], -np.arange(longest), side="left").tolist()
    marks = np.zeros(grid.shape, bool)
    mid, wide = np.array(centre, float)[order], np.array(scale, float)[order]
    least, run = wide * 0.05, np.zeros(len(lanes), np.int64)
    lam, keep = rules.weight, 1.0 - rules.weight
    for i, n in enumerate(running):
        v, c, s, r = grid[i, :n], mid[:n], wide[:n], run[:n]
        e, top = v - c, rules.limit * s
        size = np.abs(e)
        out = ~(size <= top)
        r = np.where(out, r + 1, 0)
        anew = r > rules.spike_run
        moved = c + lam * np.where(out, np.where(e > 0, top, -top) * 0.25, e)
        mid[:n] = np.where(anew, v, moved)
        wide[:n] = np.maximum(np.where(anew, s, keep * s + lam * 1.25 * np.where(out, top, size)), least[:n])
        run[:n] = np.where(anew, 0, r)
        marks[i, :n] = out
    found: list[np.ndarray] = [np.zeros(0, bool)] * len(lanes)
    for at, k in enumerate(order):
        found[k] = marks[: sizes[k], at]
    return found


def around(x: np.ndarray, half: int) -> np.ndarray:
    """Median of the readings from `half` before to `half` after each, the reading itself included; ends are mirrored."""
    n = len(x)
    if n == 0:
        return x
    h = min(half, n - 1)
    wide = np.pad(x, h, mode="reflect") if h else x
    return np.median(np.lib.stride_tricks.sliding_window_view(wide, 2 * h + 1), axis=1)


@dataclass
class Charted:
    """What is known of some readings of a source, in order: impossible, stuck, distance from the level around (NaN for the
    former two), marked by the chart in either direction, marked in both."""

    impossible: np.ndarray
    stuck: np.ndarray
    away: np.ndarray
    either: np.ndarray
    both: np.ndarray


def chart_stretches(stretches: list[np.ndarray], limits: list[float], rules: SpikeRules) -> list[Charted]:
    """Charts of ordered stretches of readings, each on its own."""
    out, lanes, centres, scales, owners = [], [], [], [], []
    for value, limit in zip(stretches, limits, strict=True):
        n = len(value)
        impossible = (value < 0) | (value > limit)
        turn = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        length = np.diff(np.r_[turn, n])
        stuck = np.repeat(length >= rules.stuck_run, length) & ~impossible
        rest = np.flatnonzero(~impossible & ~stuck)
        c = Charted(impossible, stuck, np.full(n, np.nan), np.zeros(n, bool), np.zeros(n, bool))
        out.append(c)
        if len(rest):
            x = value[rest]
            c.away[rest] = x - around(x, rules.half_window)
            first = x[:25]
            scale = 1.4826 * float(np.median(np.abs(x - np.median(first)))) or float(np.mean(np.abs(c.away[rest]))) or 1e-12
            local = 1.4826 * float(np.median(np.abs(c.away[rest])))
            start = min(scale, 2 * local) if local > 0 else scale
            lanes += [x, x[::-1]]
            centres += [float(np.median(first)), float(np.median(x[-25:]))]
            scales += [start, start]
            owners.append((c, rest))
    marks = control_charts(lanes, np.array(centres), np.array(scales), rules)
    for (c, rest), there, back in zip(owners, marks[::2], marks[1::2], strict=True):
        c.either[rest], c.both[rest] = there | back[::-1], there & back[::-1]
    return out


IMPOSSIBLE, STUCK, OWN, NEIGHBOUR = 1, 2, 3, 4
WORDS = np.array(["", "impossible", "stuck", "spike"], object)


def _beside(mark: np.ndarray, reach: int) -> np.ndarray:
    """The marks and what lies up to `reach` places beside one."""
    out = mark.copy()
    for s in range(1, reach + 1):
        out[s:] |= mark[:-s]
        out[:-s] |= mark[s:]
    return out


def find_spikes(order: np.ndarray, away: np.ndarray, scatter: float, rules: SpikeRules) -> np.ndarray:
    """Which readings are spikes, of those given with their place in the source and their distance from the level around.

    A spike is further away than `spike_scatters`; it and its neighbours on the same side that stay further away than
    `return_scatters` are at most `spike_run`.
    """
    if not len(away) or not scatter > 0:
        return np.zeros(len(away), bool)
    out = np.abs(away) > rules.return_scatters * scatter
    side = np.sign(away)
    join = (order[1:] == order[:-1] + 1) & out[1:] & out[:-1] & (side[1:] == side[:-1])
    size = np.diff(np.r_[np.flatnonzero(np.r_[True, ~join]), len(away)])
    return out & np.repeat(size <= rules.spike_run, size) & (np.abs(away) > rules.spike_scatters * scatter)


def short_runs(mark: np.ndarray, most: int) -> np.ndarray:
    """The marks in runs of at most `most`."""
    n = np.diff(np.r_[np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]]), len(mark)])
    return mark & np.repeat(n <= most, n)


class Segment:
    """The own readings of a segment and what the readings beyond add: `take` are the row numbers of the stretch, `own` which
    of them belong to the segment, `shown` which of them are suspect or beside a suspect one, `rank` their place among the
    readings that are neither impossible nor stuck."""

    def __init__(self, take: np.ndarray, own: np.ndarray, c: Charted, rules: SpikeRules) -> None:
        self.take, self.own, self.chart = take, own, c
        pos = np.flatnonzero(~np.isnan(c.away))
        self.rank = np.full(len(take), -1, np.int64)
        self.rank[pos] = np.arange(len(pos))
        self.shown = np.zeros(len(take), bool)
        # neighbours tell whether the level returns
        self.shown[pos[_beside(c.either[pos], rules.spike_run + 1)]] = True
        self.lone = np.zeros(len(take), bool)
        self.lone[pos] = short_runs(c.both[pos], rules.spike_run)


def segments(place: np.ndarray, fresh: np.ndarray, mine: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of every segment with rows of `mine`, halo included, and which of them belong to it. `place` are consecutive
    places in the source; rows that are not `fresh` repeat the one before and take a place, but are no readings."""
    if not mine.any():
        return
    held = np.flatnonzero(mine)
    for k in range(int(place[held[0]]) // SEGMENT, int(place[held[-1]]) // SEGMENT + 1):
        lo, hi = np.searchsorted(place, [k * SEGMENT - HALO, (k + 1) * SEGMENT + HALO])
        take = lo + np.flatnonzero(fresh[lo:hi])
        own = (place[take] // SEGMENT == k) & mine[take]
        if own.any():
            yield take, own


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, list[int], np.ndarray]]:
    """Frames of whole chunks, the rows that are no repeat of the one before, the chunks' edges, and which names are null."""
    for x in whole_groups(batches, ["name", "chunk"], 100_000):
        name, null, chunk, ids, ms = x["name"].to_numpy(), x["name"].isna().to_numpy(), x["chunk"].to_numpy(), x["reading_id"].to_numpy(), x["ms"].to_numpy()
        same = (chunk[1:] == chunk[:-1]) & ((name[1:] == name[:-1]) | (null[1:] & null[:-1]))
        fresh = ~np.r_[False, same & (ids[1:] == ids[:-1]) & (ms[1:] == ms[:-1])]
        yield x, fresh, np.r_[0, np.flatnonzero(~same) + 1, len(x)].tolist(), null


def _charted(x: pd.DataFrame, fresh: np.ndarray, edges: list[int], chunk_rows: int | None, rules: SpikeRules) -> Iterator[tuple[int, list[Segment]]]:
    """(first row, segments) of every source or chunk of a frame; all stretches of the frame are charted at once."""
    value, chunk, before = x["value"].to_numpy(), x["chunk"].to_numpy(), x["before"].to_numpy()
    limit = x["limit"].to_numpy(dtype=float, na_value=np.nan)
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        place = before[i] + np.arange(j - i)
        mine = np.ones(j - i, bool) if chunk_rows is None else place // chunk_rows == chunk[i]
        found += [(i, i + take, own) for take, own in segments(place, fresh[i:j], mine)]
    tops = [np.inf if np.isnan(limit[i]) else limit[i] for i, _, _ in found]
    charts = chart_stretches([value[take] for _, take, _ in found], tops, rules)
    at = 0
    for i in edges[:-1]:
        these = []
        while at < len(found) and found[at][0] == i:
            these.append(Segment(found[at][1], found[at][2], charts[at], rules))
            at += 1
        yield i, these


_FLAGS = "name string, reading_id long, ms long, flaw string, distance double, scatter double"


def _flag_whole(rules: SpikeRules, by_chart: bool):
    """The flags of sources of one chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, fresh, edges, null in _stretches(batches):
            name, ids, ms, value = (x[c].to_numpy() for c in ("name", "reading_id", "ms", "value"))
            out = []
            for i, these in _charted(x, fresh, edges, None, rules):
                if not these:
                    continue
                away = np.concatenate([s.chart.away[s.own] for s in these])
                mine = np.concatenate([value[s.take[s.own]] for s in these])
                counted = np.abs(away[~np.isnan(away)])
                scatter = float(np.median(counted)) if len(counted) else 0.0
                idle = np.unique(mine, return_counts=True)[1].max() * 2 > len(mine)
                for s in these:
                    flaw = judge(s, scatter, idle, rules, by_chart)
                    at = np.flatnonzero(flaw)
                    if len(at):
                        out.append((None if null[i] else name[i], scatter, flaw[at], s.chart.away[at], s.take[at]))
            if out:
                sizes = [len(o[4]) for o in out]
                at = np.concatenate([o[4] for o in out])
                yield pd.DataFrame({"name": np.repeat(np.array([o[0] for o in out], object), sizes), "reading_id": ids[at], "ms": ms[at], "flaw": WORDS[np.concatenate([o[2] for o in out])], "distance": np.concatenate([o[3] for o in out]), "scatter": np.repeat([o[1] for o in out], sizes)})

    return run


def judge(s: Segment, scatter: float, idle: bool, rules: SpikeRules, by_chart: bool) -> np.ndarray:
    """The flaws, as numbers, of a segment's own readings."""
    c = s.chart
    flaw = np.where(c.impossible, IMPOSSIBLE, 0)
    if not idle:
        flaw[c.stuck] = STUCK
        if by_chart:
            flaw[s.lone] = OWN
        else:
            at = np.flatnonzero(s.shown)
            flaw[at[find_spikes(s.rank[at], c.away[at], scatter, rules)]] = OWN
    return np.where(s.own, flaw, 0)


#: A long source's readings. seg: segment, -1 for readings that only their source's scatter and idleness need; rank, flag: see
#: `Segment` and the numbers above; value, away: of own readings, for the source's counts.
_PARTS = "name string, chunk long, seg long, rank long, reading_id long, ms long, value double, away double, flag int, lone boolean"


def _chart_parts(rules: SpikeRules, chunk_rows: int):
    """The readings of every chunk of a long source with what the chart says of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, fresh, edges, null in _stretches(batches):
            name, ids, ms, value, before = (x[c].to_numpy() for c in ("name", "reading_id", "ms", "value", "before"))
            for i, these in _charted(x, fresh, edges, chunk_rows, rules):
                for s in these:
                    c = s.chart
                    flag = np.where(c.impossible, IMPOSSIBLE, np.where(c.stuck, STUCK, OWN))
                    flag = np.where(s.own, flag, NEIGHBOUR)
                    show = s.shown | ((flag < OWN) & s.own) | s.lone
                    at = np.flatnonzero(show | s.own)
                    take = s.take[at]
                    seg = (before[i] + s.take[s.own][0] - i) // SEGMENT
                    yield pd.DataFrame({"name": np.full(len(at), None if null[i] else name[i], object), "chunk": np.full(len(at), x["chunk"].iloc[i]), "seg": np.where(show[at], seg, -1), "rank": s.rank[at], "reading_id": ids[take], "ms": ms[take], "value": value[take], "away": c.away[at], "flag": flag[at].astype(np.int32), "lone": s.lone[at]})

    return run


def _source_stats(parts: DataFrame) -> DataFrame:
    """s_name, scatter, idle of the long sources, exactly: the median of the distances, and whether the median value, which a
    value of more than half of the readings must be, is one."""
    own = parts.where(F.col("flag") < NEIGHBOUR)
    half = {"lo": lambda n: F.call_function("div", n + 1, F.lit(2).cast("long")), "hi": lambda n: F.call_function("div", n, F.lit(2).cast("long")) + 1}
    mid = values_at_ranks(own.select("name", F.abs("away").alias("r")), "name", "r", half).select(F.col("name").alias("b_name"), ((F.col("lo") + F.col("hi")) / 2).alias("scatter"))
    most = values_at_ranks(own.select("name", "value"), "name", "value", {"lo": half["lo"]}).select(F.col("name").alias("m_name"), F.col("lo").alias("top"))
    n = own.join(sized_broadcast(most), F.col("name").eqNullSafe(F.col("m_name"))).groupBy(F.col("name").alias("s_name")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") == F.col("top")).alias("same"))
    return n.join(mid, F.col("s_name").eqNullSafe(F.col("b_name")), "left").select("s_name", F.coalesce("scatter", F.lit(0.0)).alias("scatter"), (F.col("same") * 2 > F.col("n")).alias("idle"))


def _judge_parts(rules: SpikeRules, by_chart: bool):
    """The flags of the segments of long sources, with what is known of their source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in whole_groups(batches, ["name", "chunk", "seg"], 50_000):
            null, name, chunk, seg = x["name"].isna().to_numpy(), x["name"].to_numpy(), x["chunk"].to_numpy(), x["seg"].to_numpy()
            same = (seg[1:] == seg[:-1]) & (chunk[1:] == chunk[:-1]) & ((name[1:] == name[:-1]) | (null[1:] & null[:-1]))
            flag, rank, away, scatter, idle, lone = (x[c].to_numpy() for c in ("flag", "rank", "away", "scatter", "idle", "lone"))
            flaw = np.where(flag == IMPOSSIBLE, IMPOSSIBLE, np.where((flag == STUCK) & ~idle, STUCK, 0))
            if by_chart:
                flaw[(flag == OWN) & lone & ~idle] = OWN
            edges = np.r_[0, np.flatnonzero(~same) + 1, len(x)].tolist()
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                seq = i + np.flatnonzero(rank[i:j] >= 0)
                if len(seq) and not idle[i] and not by_chart:
                    hit = find_spikes(rank[seq], away[seq], float(scatter[i]), rules) & (flag[seq] == OWN)
                    flaw[seq[hit]] = OWN
            at = np.flatnonzero(flaw)
            if len(at):
                y = x.iloc[at]
                yield pd.DataFrame({"name": y["name"].to_numpy(), "reading_id": y["reading_id"].to_numpy(), "ms": y["ms"].to_numpy(), "flaw": WORDS[flaw[at]], "distance": y["away"].to_numpy(), "scatter": y["scatter"].to_numpy()})

    return run


def _units(good: DataFrame, chunk_rows: int, bucket_ms: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Of the sources of more than `chunk_rows` rows: their names, the rows, each with `start`, the begin of its time unit, and (h_name, h_start,
    chunk, before): the chunks that need a unit, and the number of rows before it. None without such sources.

    Units are buckets of `bucket_ms`; one that holds more than a part of a chunk is cut into finer ones, again and again, down to
    milliseconds. Every row counts, so a place in the source is the same for all who count.
    """
    day = F.floor(F.col("ms") / F.lit(bucket_ms)) * F.lit(bucket_ms)
    most = max(1, chunk_rows // UNIT_SHARE)
    days = good.groupBy("name", day.alias("start")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("name"))
    hot = days.withColumn("total", total).where(F.col("total") > chunk_rows).select("name", "start", "n")
    hot, _ = settled(hot)
    if hot.isEmpty():
        return None
    names = sized_broadcast(hot.select(F.col("name").alias("h_name")).distinct())
    rows = good.join(names, F.col("name").eqNullSafe(F.col("h_name"))).drop("h_name").withColumn("start", day).withColumn("day", day)
    # a unit keeps the bucket that it lies in, so that running counts are taken per bucket first
    units = hot.withColumn("day", F.col("start")).withColumn("len", F.lit(bucket_ms).cast("long"))
    while True:
        # a heavy unit of n rows is cut into 2^k parts of equal length, the least power that would leave few enough in each
        parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / most)))
        heavy = units.where((F.col("n") > most) & (F.col("len") > 1))
        heavy, few = settled(heavy.select(F.col("name").alias("x_name"), F.col("start").alias("x_start"), F.greatest(F.lit(1).cast("long"), (F.col("len") / parts).cast("long")).alias("x_len")))
        if heavy.isEmpty():
            break
        heavy = F.broadcast(heavy) if few else heavy
        on = F.col("name").eqNullSafe(F.col("x_name")) & (F.col("start") == F.col("x_start"))
        inner = F.col("start") + F.floor((F.col("ms") - F.col("start")) / F.col("x_len")) * F.col("x_len")
        rows = rows.join(heavy, on, "left").withColumn("start", F.coalesce(inner, F.col("start"))).withColumn("len", F.col("x_len")).drop("x_name", "x_start", "x_len")
        finer = rows.where("len is not null").groupBy("name", "day", "start", "len").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.drop("len")
        units, _ = settled(units.join(heavy, on, "left_anti").unionByName(finer))
    within = Window.partitionBy("name", "day").orderBy("start")
    per = units.groupBy("name", "day").agg(F.sum("n").alias("all"))
    offset = per.withColumn("offset", F.sum("all").over(Window.partitionBy("name").orderBy("day")) - F.col("all")).withColumn("total", F.sum("all").over(Window.partitionBy("name")))
    offset = offset.select(F.col("name").alias("o_name"), F.col("day").alias("o_day"), "offset", "total")
    placed = units.withColumn("inner", F.sum("n").over(within) - F.col("n")).join(offset, F.col("name").eqNullSafe(F.col("o_name")) & (F.col("day") == F.col("o_day")))
    before = F.col("offset") + F.col("inner")
    reach = SEGMENT + HALO
    first = F.floor(F.greatest(before - reach, F.lit(0)) / chunk_rows)
    last = F.least(F.floor((before + F.col("n") - 1 + reach) / chunk_rows), F.floor((F.col("total") - 1) / chunk_rows))
    return names, rows.drop("day"), placed.select(F.col("name").alias("h_name"), F.col("start").alias("h_start"), F.explode(F.sequence(first, last)).alias("chunk"), before.alias("before"))


def flag_readings(df: DataFrame, reading_id: Column, name: Column, ms: Column, value: Column, limit: Column, missing: Column, rules: SpikeRules | None = None, chunk_rows: int = CHUNK_ROWS, bucket_ms: int = DAY_MS, by_chart: bool = False) -> DataFrame:
    """Flags of the readings of `df`: name, reading_id, ms, flaw ('impossible', 'stuck' or 'spike'), distance, scatter.

    Only flagged readings have a row. Readings that are `missing` or have no time are left out first; repeats of one
    (reading_id, time) count once; ties in time are ordered by id. `limit` is the source's physical maximum (null: none);
    below zero is impossible. A source in which one value makes up more than half of the readings is idle: neither stuck
    nor spiking. A source whose scatter is zero has no spikes. A null name is a source of its own. An empty table gives an
    empty result. `chunk_rows` and `bucket_ms` change how the work is cut, never the result; only readings of one source in one
    millisecond are not split. `by_chart`: spikes are what the chart itself marks in both directions of time, in runs of
    at most `spike_run`, without the exact check.
    """
    rules = rules or SpikeRules()
    good = df.where(~missing).select(reading_id.alias("reading_id"), name.alias("name"), ms.alias("ms"), value.alias("value"), limit.cast("double").alias("limit")).where("ms is not null")
    large = _units(good, chunk_rows, bucket_ms)
    short = good
    if large is not None:
        names, rows, chunks = large
        short = good.join(names, F.col("name").eqNullSafe(F.col("h_name")), "left_anti")
    short = short.select("reading_id", "name", "ms", "value", "limit", F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("before"))
    flags = short.repartition("name").sortWithinPartitions("name", "ms", "reading_id").mapInPandas(_flag_whole(rules, by_chart), _FLAGS)
    if large is None:
        return flags
    long = rows.join(sized_broadcast(chunks), F.col("name").eqNullSafe(F.col("h_name")) & (F.col("start") == F.col("h_start"))).select("reading_id", "name", "ms", "value", "limit", "chunk", "before")
    parts = cut(long.repartition("name", "chunk").sortWithinPartitions("name", "chunk", "ms", "reading_id").mapInPandas(_chart_parts(rules, chunk_rows), _PARTS))
    stats = sized_broadcast(_source_stats(parts))
    marked = parts.where("seg >= 0").join(stats, F.col("name").eqNullSafe(F.col("s_name"))).select("name", "chunk", "seg", "rank", "reading_id", "ms", "away", "flag", "lone", "scatter", "idle")
    # a segment's impossible and stuck readings have no place in its order (rank -1) and come first
    more = marked.repartition("name", "chunk", "seg").sortWithinPartitions("name", "chunk", "seg", "rank").mapInPandas(_judge_parts(rules, by_chart), _FLAGS)
    return flags.unionByName(more)
