"""Continuous periods and gaps from overlapping time intervals.

Every record sets a run of exact milliseconds. Runs are cut at fixed time shards, and each (entity, shard) holds a run
bitmap: sorted disjoint runs as offset, length and the number of records that begin in the run, packed as 32-bit
integers. Bitmaps are built per task before the shuffle, united after it (of large inputs in salted parts first, so that no
task unites all bitmaps of a hot entity and day), and then give their set runs (periods) and clear runs (gaps). Only runs that touch a shard's border and one summary per shard are stitched per entity, so the
work of one task is bounded by the time span, not by the number of records of a hot entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.neighbours import SPLIT_BYTES
from chronoweave.plans.scale import plan_bytes, whole_groups

SHARD_MS = 86_400_000


def unite(key: np.ndarray, begin: np.ndarray, end: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Union of half-open runs per key; runs that touch become one. Returns key, begin, end and summed count, sorted."""
    if not len(key):
        return key, begin, end, count
    order = np.lexsort((begin, key))
    key, begin, end, count = key[order], begin[order], end[order], count[order]
    # one running maximum serves all keys: each key's times are moved above those of the keys before it
    low = int(begin.min())
    lift = (key - key[0]).astype(np.int64) * (int(end.max()) - low + 2)
    b, e = begin - low + lift, np.maximum.accumulate(end - low + lift)
    first = np.r_[True, (b[1:] > e[:-1]) | (key[1:] != key[:-1])]
    at = np.flatnonzero(first)
    return key[at], begin[at], e[np.r_[at[1:] - 1, len(e) - 1]] + low - lift[at], np.add.reduceat(count, at)


def pack(begin: np.ndarray, end: np.ndarray, count: np.ndarray) -> bytes:
    """Runs of one shard, as offsets within the shard."""
    return np.stack([begin, end - begin, count]).astype("<u4").tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and count of the runs that `pack` stored."""
    x = np.frombuffer(data, "<u4").reshape(3, -1).astype(np.int64)
    return x[0], x[0] + x[1], x[2]


def _spans(key: np.ndarray) -> Iterator[tuple[int, int]]:
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    yield from zip(at.tolist(), np.r_[at[1:], len(key)].tolist(), strict=True)


#: Runs that a task holds before it gives out its bitmaps.
HELD_RUNS = 500_000

#: Parts in which the bitmaps of one entity and shard are united first.
SALTS = 64


def _maps(code: np.ndarray, keys: pd.Index, b: np.ndarray, e: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    spans = list(_spans(code))
    who = [keys[code[i]] for i, _ in spans]
    return pd.DataFrame({"entity": [w[0] if isinstance(w[0], str) else None for w in who], "shard": np.array([w[1] for w in who], np.int64), "bitmap": [pack(b[i:j], e[i:j], n[i:j]) for i, j in spans]})


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bitmaps of the runs of a task."""
    held: list[pd.DataFrame] = []
    size = 0

    def give() -> pd.DataFrame:
        x = pd.concat(held, ignore_index=True)
        code, keys = pd.factorize(pd.MultiIndex.from_frame(x[["entity", "shard"]]), use_na_sentinel=False)
        k, b, e, n = unite(code, x["b"].to_numpy(), x["e"].to_numpy(), x["n"].to_numpy())
        return _maps(k, keys, b, e, n)

    for x in batches:
        if x.empty:
            continue
        held.append(x)
        size += len(x)
        if size >= HELD_RUNS:
            yield give()
            held, size = [], 0
    if held:
        yield give()


def _unite_maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One bitmap per entity and shard of a partition that is sorted by them."""
    for x in whole_groups(batches, ["entity", "shard"], 2_000):
        code, keys = pd.factorize(pd.MultiIndex.from_frame(x[["entity", "shard"]]), use_na_sentinel=False)
        parts = [unpack(m) for m in x["bitmap"]]
        key = np.repeat(code, [len(p[0]) for p in parts])
        k, b, e, n = unite(key, *(np.concatenate([p[i] for p in parts]) for i in range(3)))
        yield _maps(k, keys, b, e, n)


def _extract(shard_ms: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in whole_groups(batches, ["entity", "shard"], 2_000):
            same = (x["shard"].to_numpy()[1:] == x["shard"].to_numpy()[:-1]) & ((x["entity"].to_numpy()[1:] == x["entity"].to_numpy()[:-1]) | (x["entity"].isna().to_numpy()[1:] & x["entity"].isna().to_numpy()[:-1]))
            group = np.cumsum(np.r_[True, ~same]) - 1
            parts = [unpack(d) for d in x["bitmap"]]
            sizes = [len(p[0]) for p in parts]
            key = np.repeat(group, sizes)
            k, b, e, n = unite(key, *(np.concatenate([p[i] for p in parts]) for i in range(3)))
            head = np.flatnonzero(np.r_[True, ~same])
            entity, base = x["entity"].to_numpy()[head], x["shard"].to_numpy()[head]
            off = base[k] * shard_ms
            lane = base[k]
            border = (b == 0) | (e == shard_ms)
            frames = [(k, np.where(border, "frag", "run"), off + b, off + e, n, np.where(border, -1, lane))]
            inner = np.flatnonzero(k[1:] == k[:-1])
            frames.append((k[inner], np.full(len(inner), "clear"), (off + e)[inner], (off + b)[inner + 1], np.zeros(len(inner), np.int64), lane[inner]))
            at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            to = np.r_[at[1:] - 1, len(k) - 1]
            frames.append((k[at], np.full(len(at), "edge"), (off + b)[at], (off + e)[to], np.zeros(len(at), np.int64), np.full(len(at), -1)))
            for g, kind, lo, hi, cnt, ln in frames:
                yield pd.DataFrame({"entity": entity[g], "part": kind, "begin_ms": lo, "end_ms": hi, "n": cnt, "lane": ln})

    return run


def merge_periods(df: DataFrame, entity: Column, begin_ms: Column, end_ms: Column, record: Column, version: Column | None = None, shard_ms: int = SHARD_MS) -> DataFrame:
    """Periods covered by at least one record, and the gaps between the periods of an entity.

    Columns: entity STRING, kind ('period' or 'gap'), begin_ms, end_ms BIGINT, n_records BIGINT (0 for gaps). Records that
    overlap or touch form one period. Records without both bounds, empty ones and reversed ones do not count. Of the
    records that share an id the one with the greatest version counts; records with a null id count each, but exact
    repeats of one once. A record is cut into one run per shard that it covers, so very long ones give many. A null entity is
    an entity of its own. An empty table gives an empty result.
    """
    if not 0 < shard_ms < 1 << 32:
        raise ValueError("a shard has less than 2^32 milliseconds")
    rec = df.select(entity.cast("string").alias("entity"), begin_ms.alias("b"), end_ms.alias("e"), record.alias("id"), (version if version is not None else F.lit(0)).alias("v")).where("b < e")
    once = rec.groupBy("id", F.when(F.col("id").isNull(), F.struct("entity", "b", "e")).alias("own")).agg(F.max_by(F.struct("entity", "b", "e"), F.struct("v", "b", "e")).alias("r")).select("r.*")
    first, last = F.floor(F.col("b") / shard_ms), F.floor((F.col("e") - 1) / shard_ms)
    cut = once.withColumn("first", first).withColumn("shard", F.explode(F.sequence(first, last)))
    base = F.col("shard") * F.lit(shard_ms)
    cut = cut.select("entity", "shard", (F.greatest("b", base) - base).alias("b"), (F.least("e", base + F.lit(shard_ms)) - base).alias("e"), (F.col("shard") == F.col("first")).cast("long").alias("n"))
    maps = cut.mapInPandas(_build, "entity string, shard long, bitmap binary")
    if plan_bytes(df) >= SPLIT_BYTES:
        salt = F.pmod(F.xxhash64("bitmap"), F.lit(SALTS))
        maps = maps.repartition(F.col("entity"), F.col("shard"), salt).sortWithinPartitions("entity", "shard").mapInPandas(_unite_maps, "entity string, shard long, bitmap binary")
    runs = maps.repartition("entity", "shard").sortWithinPartitions("entity", "shard").mapInPandas(_extract(shard_ms), "entity string, part string, begin_ms long, end_ms long, n long, lane long")
    w = Window.partitionBy("entity", "lane", "part").orderBy("begin_ms", "end_ms")
    tied = runs.withColumn("next", F.lead("begin_ms").over(w)).withColumn("new", F.when((F.col("part") == "frag") & (F.lag("end_ms").over(w) == F.col("begin_ms")), 0).otherwise(1))
    tied = tied.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = tied.groupBy("entity", "lane", "part", "island").agg(F.min("begin_ms").alias("lo"), F.max("end_ms").alias("hi"), F.sum("n").alias("n"), F.max("next").alias("next"))
    edge, clear = F.col("part") == "edge", F.col("part") == "clear"
    return out.where(~edge | (F.col("next") > F.col("hi"))).select(
        "entity",
        F.when(edge | clear, "gap").otherwise("period").alias("kind"),
        F.when(edge, F.col("hi")).otherwise(F.col("lo")).alias("begin_ms"),
        F.when(edge, F.col("next")).otherwise(F.col("hi")).alias("end_ms"),
        F.col("n").alias("n_records"),
    )
