"""Irregular readings onto a regular grid by compact-kernel local polynomial regression.

Each reading is indexed by its slot. Readings are shuffled once, by (series, block of slots); those within the kernel's reach
of another block's grid times go there too. Inside a block, without another exchange, every reading adds its kernel-weighted
moments to the grid times within reach, and the moments are summed per slot together with empty grid rows. The fit at a
grid time is then the closed-form solution of the weighted normal equations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of a block, the unit of the shuffle: a hot series is spread over its blocks.
GRID_BLOCK = 512

#: Least determinant of the normal equations, relative to the sum of weights to the power of their size, by degree. Readings
#: that lie closer together than this says do not determine a slope or a curve; the fit is then of a lower degree.
LEAST_SPREAD = {1: 1e-2, 2: 1e-5}

UNIT_MS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def step_millis(step: Column) -> Column:
    """Milliseconds of a text such as '30s' or '5m'; null for any other text and for zero."""
    n = F.try_to_number(F.regexp_extract(step, r"^\s*(\d{1,9})[smhd]\s*$", 1), F.lit("999999999")).cast("long")
    unit = F.regexp_extract(step, r"^\s*\d{1,9}([smhd])\s*$", 1)
    ms = F.lit(None).cast("long")
    for k, v in UNIT_MS.items():
        ms = F.when(unit == k, n * F.lit(v)).otherwise(ms)
    return F.when(ms > 0, ms)


def regular_series(readings: DataFrame, radius: int = 3, degree: int = 1, min_support: float = 1.5) -> DataFrame:
    """The regular series of `readings(source, step_ms, ms, value)`, from the first slot with a reading to the last.

    Slots are [k step, (k + 1) step) in epoch milliseconds, named by their start, which is the grid time. Returns source,
    step_ms, slot_ms, n (readings in the slot), value (the local fit of the given degree, 0 to 2, over the readings less
    than `radius` steps away, lower where the readings do not determine it), support (effective number of readings,
    (sum w)^2 / sum w^2) and mark: 'observed' (n > 0), 'filled' (support of at least `min_support`) or 'missing' (value
    is null). The kernel is (1 - |d|^3)^3, zero from `radius` steps on.

    Readings without time or step, or whose value is null or NaN, do not count; repeats of one (source, time, value) count
    once, different values of one time each. A null source is a source of its own. No readings, no rows.
    """
    if degree not in (0, 1, 2) or radius < 1:
        raise ValueError("degree must be 0, 1 or 2 and radius at least 1")
    good = readings.select("source", "step_ms", "ms", "value").where(F.col("ms").isNotNull() & F.col("step_ms").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    slot, cut = F.floor(F.col("ms") / F.col("step_ms")), F.lit(GRID_BLOCK)
    # a reading reaches the grid times from slot k - radius + 1 to k + radius; `b` is each block that has one of them
    low, high = F.floor((slot - (radius - 1)) / cut), F.floor((slot + radius) / cut)
    points = good.select("source", "step_ms", "ms", "value", F.explode(F.sequence(low, high)).alias("b"))
    ends = good.groupBy("source", "step_ms").agg(F.floor(F.min("ms") / F.col("step_ms")).alias("lo"), F.floor(F.max("ms") / F.col("step_ms")).alias("hi"))
    blocks = ends.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / cut), F.floor(F.col("hi") / cut))))
    nothing = F.lit(None).cast("long"), F.lit(None).cast("double")
    blocks = blocks.select("source", "step_ms", nothing[0].alias("ms"), nothing[1].alias("value"), "b", "lo", "hi")
    both = points.select("source", "step_ms", "ms", "value", "b", nothing[0].alias("lo"), nothing[0].alias("hi")).unionByName(blocks)
    # one exchange; what follows groups by more columns than these, so it stays inside the partitions
    both = both.repartition("source", "step_ms", "b").dropDuplicates(["source", "step_ms", "b", "ms", "value"])
    first, past = F.col("b") * cut, (F.col("b") + 1) * cut - 1
    from_, to = F.coalesce("lo", slot - (radius - 1)), F.coalesce("hi", slot + radius)
    near = both.withColumn("j", F.explode(F.sequence(F.greatest(from_, first), F.least(to, past)))).withColumn("k", slot)
    d = (F.col("ms") - F.col("j") * F.col("step_ms")) / (F.col("step_ms") * F.lit(float(radius)))
    near = near.withColumn("d", d).where(F.col("ms").isNull() | (F.abs("d") < 1)).withColumn("w", F.pow(1 - F.pow(F.abs("d"), 3), 3))
    y = F.col("value")
    sums = {"s0": F.col("w"), "q": F.col("w") * F.col("w"), "t0": F.col("w") * y}
    if degree >= 1:
        sums |= {"s1": F.col("w") * F.col("d"), "s2": F.col("w") * F.col("d") ** 2, "t1": F.col("w") * F.col("d") * y}
    if degree == 2:
        sums |= {"s3": F.col("w") * F.col("d") ** 3, "s4": F.col("w") * F.col("d") ** 4, "t2": F.col("w") * F.col("d") ** 2 * y}
    grid = F.max(F.col("ms").isNull())
    m = near.groupBy("source", "step_ms", "b", "j").agg(F.count_if(F.col("j") == F.when(F.col("ms").isNotNull(), F.col("k"))).alias("n"), grid.alias("grid"), *[F.sum(x).alias(s) for s, x in sums.items()]).where("grid")
    c = {s: F.col(s) for s in sums}
    fit = F.try_divide(c["t0"], c["s0"])
    if degree >= 1:
        det = c["s0"] * c["s2"] - c["s1"] * c["s1"]
        fit = F.when(det > LEAST_SPREAD[1] * c["s0"] * c["s0"], (c["s2"] * c["t0"] - c["s1"] * c["t1"]) / det).otherwise(fit)
    if degree == 2:
        a = c["s2"] * c["s4"] - c["s3"] * c["s3"]
        b = c["s1"] * c["s4"] - c["s2"] * c["s3"]
        e = c["s1"] * c["s3"] - c["s2"] * c["s2"]
        det = c["s0"] * a - c["s1"] * b + c["s2"] * e
        fit = F.when(det > LEAST_SPREAD[2] * c["s0"] * c["s0"] * c["s0"], (c["t0"] * a - c["t1"] * b + c["t2"] * e) / det).otherwise(fit)
    support = F.coalesce(F.try_divide(c["s0"] * c["s0"], c["q"]), F.lit(0.0))
    mark = F.when(F.col("n") > 0, "observed").when(support >= min_support, "filled").otherwise("missing")
    return m.select("source", "step_ms", (F.col("j") * F.col("step_ms")).alias("slot_ms"), "n", F.when(mark != "missing", fit).alias("value"), support.alias("support"), mark.alias("mark"))
