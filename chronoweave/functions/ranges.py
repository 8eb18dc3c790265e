"""Algebra of time ranges as columns: a range is a struct of begin and end, in milliseconds (or any ordered type)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_range(begin: Column, end: Column) -> Column:
    """A range; null where a bound is null. A reversed one raises an error."""
    ok = F.when(end < begin, F.raise_error(F.lit("a range must not end before it begins"))).otherwise(F.struct(begin.alias("begin"), end.alias("end")))
    return F.when(begin.isNotNull() & end.isNotNull(), ok)


def equals(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def contains_time(a: Column, t: Column) -> Column:
    """Both ends included."""
    return (a["begin"] <= t) & (a["end"] >= t)


def contains(a: Column, b: Column) -> Column:
    return (a["begin"] <= b["begin"]) & (a["end"] >= b["end"])


def within(a: Column, b: Column) -> Column:
    return contains(b, a)


def overlaps(a: Column, b: Column) -> Column:
    """Exactly one end of b lies in a: neither containment nor equality."""
    return contains_time(a, b["begin"]) != contains_time(a, b["end"])


def disjoint(a: Column, b: Column) -> Column:
    """Nothing in common; ranges that touch are not disjoint."""
    return (a["end"] < b["begin"]) | (a["begin"] > b["end"])


def extents(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["begin"], b["begin"]).alias("begin"), F.greatest(a["end"], b["end"]).alias("end"))


def intersection(a: Column, b: Column) -> Column:
    """The common part; null if disjoint."""
    return F.when(~disjoint(a, b), F.struct(F.greatest(a["begin"], b["begin"]).alias("begin"), F.least(a["end"], b["end"]).alias("end")))


def duration(a: Column) -> Column:
    return a["end"] - a["begin"]


def with_begin(a: Column, begin: Column) -> Column:
    return time_range(begin, a["end"])


def with_end(a: Column, end: Column) -> Column:
    return time_range(a["begin"], end)
