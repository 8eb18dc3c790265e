"""Exact percentiles per group by cumulative frequencies.

Rows become (group, value) counts. Groups of up to `RANGE_ROWS` rows are a window each. The counts of larger ones are sorted
by range over as many partitions as their rows ask for, so no task holds a whole hot group, and a frequent value is counted
in salted parts before it moves. Running sums within a range plus the totals of the ranges before it give every value's
last rank; a percentile is the first value that reaches its target rank. Counts of separate days or files add up to the
counts of all, so partial results can be put together without error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.plans.scale import keep, sized_broadcast

#: Groups with more rows than this are sorted by ranges of about this size.
RANGE_ROWS = 250_000

#: Parts in which the repeats of one (group, value) are counted before they meet.
SALTS = 4096


def value_counts(df: DataFrame, group: Iterable[str], value: str, count: str | None = None) -> DataFrame:
    """The partial result: rows per (group, value). Counts of several partials are put together by a union and this again."""
    n = F.count(F.lit(1)) if count is None else F.sum(count)
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*group, value).agg(n.alias("n"))


def _running(counts: DataFrame, ranges: int, group: str, value: str) -> DataFrame:
    """group, value, __c, high (rank of the value's last row), n of (group, value, __c) rows, sorted by `ranges` ranges."""
    placed = counts.repartitionByRange(ranges, group, value).withColumn("__range", F.spark_partition_id())
    per = Window.partitionBy("__range", group)
    once = placed.repartition("__range", group).groupBy("__range", group, value).agg(F.sum("__c").alias("__c"))
    # kept, because ranges are drawn by sampling and both readers must see the same ones
    run = keep(once.withColumn("__sum", F.sum("__c").over(per.orderBy(value))))
    total = run.groupBy(F.col(group).alias("__group"), F.col("__range").alias("__r")).agg(F.max("__sum").alias("__t"))
    w = Window.partitionBy("__group")
    total = total.select("__group", "__r", (F.sum("__t").over(w.orderBy("__r")) - F.col("__t")).alias("__before"), F.sum("__t").over(w).alias("n"))
    at = run.join(sized_broadcast(total), F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__r")))
    return at.select(group, value, "__c", (F.col("__before") + F.col("__sum")).alias("high"), "n")


def values_at_ranks(df: DataFrame, group: str, value: str, ranks: dict[str, Callable[[Column], Column]], distinct_by: str | None = None, count: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The values at given ranks (1 is the smallest) of every group; a rank is a function of the group's number n of values.

    Returns group, n and one column per rank. See `percentiles` for what counts.
    """
    if distinct_by is not None and count is not None:
        raise ValueError("counts have no rows to tell apart")
    keep = [c for c in (distinct_by, count) if c is not None]
    good = df.select(F.col(group), (F.col(value) + F.lit(0)).alias(value), *keep).where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    n = F.count(F.lit(1)) if count is None else F.sum(count)

    size = good.groupBy(F.col(group).alias("__hot")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > range_rows)
    hot = sized_broadcast(size)
    rows = hot.agg(F.sum("__n").alias("n")).first()["n"] or 0
    of_hot = F.col(group).eqNullSafe(F.col("__hot"))
    cold = (good.join(hot, of_hot, "left_anti") if rows else good).repartition(group)
    if distinct_by is not None:
        cold = cold.dropDuplicates([group, value, distinct_by])
    w = Window.partitionBy(group)
    counts = cold.groupBy(group, value).agg(n.alias("__c"))
    at = counts.select(group, value, "__c", F.sum("__c").over(w.orderBy(value)).alias("high"), F.sum("__c").over(w).alias("n"))
    if rows:
        large = good.join(hot, of_hot).drop("__hot", "__n")
        if distinct_by is not None:
            large = large.withColumn("__salt", F.pmod(F.xxhash64(distinct_by), F.lit(SALTS))).repartition(group, value, "__salt")
            large = large.dropDuplicates([group, value, "__salt", distinct_by]).groupBy(group, value, "__salt").agg(n.alias("__c")).drop("__salt")
        else:
            large = large.groupBy(group, value).agg(n.alias("__c"))
        at = at.unionByName(_running(large, -(-rows // range_rows), group, value))
    high = F.col("high")
    low = high - F.col("__c")
    picks = [(name, F.when((low < rank(F.col("n"))) & (rank(F.col("n")) <= high), F.col(value))) for name, rank in ranks.items()]
    hit = picks[0][1].isNotNull()
    for _, c in picks[1:]:
        hit = hit | c.isNotNull()
    return at.where(hit).select(group, "n", *[c.alias(name) for name, c in picks]).groupBy(group).agg(F.max("n").alias("n"), *[F.max(name).alias(name) for name, _ in picks])


def percentiles(df: DataFrame, group: str, value: str, marks: dict[str, Fraction], distinct_by: str | None = None, count: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Percentiles of `value` per `group`: for a mark p, the smallest value with at least ceil(p n) values not above it.

    `distinct_by`: rows that repeat it within group and value count once. `count`: a column of `value_counts` weights. Null
    and NaN values do not count; a group without any other value has no row. A null group is a group of its own. The
    error is zero. Returns group, n and one column per mark; -0.0 counts as 0.0.
    """

    def at(p: Fraction) -> Callable[[Column], Column]:
        num, den = Fraction(p).numerator, Fraction(p).denominator
        return lambda n: F.greatest(F.lit(1).cast("long"), F.call_function("div", n * F.lit(num) + F.lit(den - 1), F.lit(den).cast("long")))

    return values_at_ranks(df, group, value, {name: at(p) for name, p in marks.items()}, distinct_by, count, range_rows)


def interpolated(df: DataFrame, group: str, value: str, marks: dict[str, Fraction], methods: str | Iterable[str] = "linear", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Percentiles with interpolation between the two values around position (n - 1) p: 'linear', 'lower', 'higher',
    'nearest' (below one half the lower) or 'midpoint'. Exact, and no group is collected anywhere. With several methods
    there is a row per group and method, and a column `method`; the ranks are looked up once."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in marks.items():
        num, den = Fraction(p).numerator, Fraction(p).denominator

        def low(n: Column, num: int = num, den: int = den) -> Column:
            return F.call_function("div", (n - 1) * F.lit(num), F.lit(den).cast("long")) + 1

        ranks[f"__lo_{name}"] = low
        ranks[f"__hi_{name}"] = lambda n, low=low: F.least(low(n) + 1, n)
    x = values_at_ranks(df, group, value, ranks, range_rows=range_rows)

    def by(method: str) -> list[Column]:
        out = []
        for name, p in marks.items():
            num, den = Fraction(p).numerator, Fraction(p).denominator
            a, b = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
            rest = F.pmod((F.col("n") - 1) * F.lit(num), F.lit(den).cast("long"))
            part = rest / F.lit(float(den))
            new = {"linear": a + (b - a) * part, "lower": a, "higher": b, "nearest": F.when(part < 0.5, a).otherwise(b), "midpoint": (a + b) / 2}[method]
            out.append(F.when(rest == 0, a).otherwise(new).alias(name))
        return out

    if isinstance(methods, str):
        return x.select(group, "n", *by(methods))
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), *[c.cast("double").alias(name) for c, name in zip(by(m), marks, strict=True)]) for m in methods]))
    return x.select(group, "n", rows.alias("r")).select(group, "n", "r.*")
