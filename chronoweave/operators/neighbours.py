"""Positions and nearest marked neighbours of rows in time order, also where one series holds most of the rows.

Without `split_ms` each series is one window partition. With it, rows are partitioned by (series, time bucket): what
happens inside a bucket is a window function; across buckets one small summary row per bucket carries the counts and the
outermost marks. Buckets of more than `SPLIT_ROWS` rows are halved until about so many are in one, so no task holds more,
whatever the series. Both directions are running windows, so the work grows with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.plans.scale import plan_bytes, sized_broadcast

SERIES, BUCKET, POS = "__series", "__bucket", "__pos"

#: Rows above which a bucket is halved.
SPLIT_ROWS = 1_000_000

#: Buckets are counted only if the input is planned to have at least so many bytes; less than that one task can hold anyway.
SPLIT_BYTES = 64 << 20


def _with_buckets(x: DataFrame, ms: str, split_ms: int) -> DataFrame:
    """Adds the begin of each row's time bucket. Rows without a time come first, as they do in the order within one partition."""
    at = F.col(ms)
    day = F.floor(at / F.lit(split_ms)) * F.lit(split_ms)
    if plan_bytes(x) < SPLIT_BYTES:
        return x.withColumn(BUCKET, F.coalesce(day, F.lit(-(1 << 62))))
    x = x.withColumn(BUCKET, F.coalesce(day, F.lit(-(1 << 62))))
    heavy = x.where(at.isNotNull()).groupBy(F.col(SERIES).alias("__hs"), F.col(BUCKET).alias("__hb")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > SPLIT_ROWS)
    # a bucket of n rows is cut into 2^k parts of equal length
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("__n") / SPLIT_ROWS)))
    heavy = heavy.select("__hs", "__hb", F.greatest(F.lit(1).cast("long"), (F.lit(split_ms) / parts).cast("long")).alias("__len"))
    x = x.join(sized_broadcast(heavy), (F.col(SERIES) == F.col("__hs")) & (F.col(BUCKET) == F.col("__hb")), "left")
    finer = F.col(BUCKET) + F.floor((at - F.col(BUCKET)) / F.col("__len")) * F.col("__len")
    return x.withColumn(BUCKET, F.coalesce(finer, F.col(BUCKET))).drop("__hs", "__hb", "__len")


def add_neighbours(df: DataFrame, by: list[str], ms: str, order: str, marks: dict[str, Column], split_ms: int | None = None, strict: bool = False, following: bool = True) -> DataFrame:
    """Adds `__pos` (1-based position in the series) and, per mark, `__prev_<name>` and `__next_<name>`.

    A mark is a struct or value that is null where a row does not carry it. The neighbours are structs (pos, v) of the
    nearest row with the mark, at or before and at or after this row; with `strict` before and after it; without `following`
    only those before.
    """
    keys = [F.struct(*[F.col(b) for b in by]).alias(SERIES)] if by else [F.lit(0).alias(SERIES)]
    x = df.withColumn(SERIES, keys[0])
    if split_ms is not None:
        x = _with_buckets(x, ms, split_ms)
    part = [SERIES] if split_ms is None else [SERIES, BUCKET]
    w = Window.partitionBy(*part).orderBy(ms, order)
    x = x.withColumn(POS, F.row_number().over(w).cast("long"))
    for name, mark in marks.items():
        x = x.withColumn(f"__m_{name}", F.when(mark.isNotNull(), F.struct(F.col(POS).alias("pos"), mark.alias("v"))))
    if split_ms is not None:
        agg = [F.count(F.lit(1)).alias("__n")]
        for name in marks:
            m = F.col(f"__m_{name}")
            at = F.when(m.isNotNull(), F.col(POS))
            agg += [F.min_by(m, at).alias(f"__f_{name}"), F.max_by(m, at).alias(f"__l_{name}")]
        s = x.groupBy(SERIES, BUCKET).agg(*agg)
        ws, back = Window.partitionBy(SERIES).orderBy(BUCKET), Window.partitionBy(SERIES).orderBy(F.desc(BUCKET))
        s = s.withColumn("__before", F.sum("__n").over(ws) - F.col("__n"))
        for name in marks:
            for side in ("f", "l"):
                c = F.col(f"__{side}_{name}")
                s = s.withColumn(f"__{side}_{name}", F.when(c.isNotNull(), F.struct((c["pos"] + F.col("__before")).alias("pos"), c["v"].alias("v"))))
        for name in marks:
            s = s.withColumn(f"__cp_{name}", F.last(f"__l_{name}", True).over(ws.rowsBetween(Window.unboundedPreceding, -1)))
            s = s.withColumn(f"__cn_{name}", F.last(f"__f_{name}", True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
        s = s.drop("__n", *[f"__{side}_{name}" for side in ("f", "l") for name in marks])
        x = x.join(s, [SERIES, BUCKET])
    before = F.lit(0) if split_ms is None else F.col("__before")
    edge = 1 if strict else 0
    # a frame that ends at the partition's end is recomputed for every row; the same from behind is a running one
    back = Window.partitionBy(*part).orderBy(F.desc(POS))
    for name in marks:
        m = F.col(f"__m_{name}")
        moved = F.when(m.isNotNull(), F.struct((m["pos"] + before).alias("pos"), m["v"].alias("v")))
        x = x.withColumn(f"__m_{name}", moved)
    for name in marks:
        x = x.withColumn(f"__prev_{name}", F.last(f"__m_{name}", True).over(w.rowsBetween(Window.unboundedPreceding, -edge)))
    for name in marks if following else ():
        x = x.withColumn(f"__next_{name}", F.last(f"__m_{name}", True).over(back.rowsBetween(Window.unboundedPreceding, -edge)))
    if split_ms is not None:
        for name in marks:
            x = x.withColumn(f"__prev_{name}", F.coalesce(f"__prev_{name}", f"__cp_{name}"))
            if following:
                x = x.withColumn(f"__next_{name}", F.coalesce(f"__next_{name}", f"__cn_{name}"))
    x = x.withColumn(POS, F.col(POS) + before)
    carried = [f"__{p}_{name}" for p in ("cp", "cn", "m") for name in marks]
    return x.drop(SERIES, BUCKET, "__before", *carried)


def drop_neighbours(df: DataFrame) -> DataFrame:
    """Removes what `add_neighbours` added."""
    return df.drop(POS, *[c for c in df.columns if c.startswith(("__prev_", "__next_"))])
