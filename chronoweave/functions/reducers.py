"""Reducers as declarations: each gives a native aggregate over rows and a native expression over the columns of a row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.errors import ReducerError
from chronoweave.functions.validity import check_policy, valid

METHODS = ("linear", "lower", "higher", "nearest", "midpoint")


def pick(values: Column, position: Column, method: str) -> Column:
    """The element at a fractional position (0-based) of a sorted array."""
    low = F.floor(position).cast("int")
    part = position - low
    a = F.get(values, low)
    b = F.coalesce(F.get(values, low + 1), a)
    if method == "linear":
        out = a + (b - a) * part
    elif method == "lower":
        out = a
    elif method == "higher":
        out = b
    elif method == "nearest":
        out = F.when(part < 0.5, a).otherwise(b)
    else:
        out = (a + b) / 2
    return F.when(part == 0, a).otherwise(out)


@dataclass(frozen=True)
class Reducer:
    """kind: what it computes; policy: how missing values count; strict: under 'keep', missing values raise an error.

    No rows, or under 'ignore' no valid ones: sum, avg and count give 0, the others null; under 'none_if_empty' no rows
    give null.
    """

    kind: str
    policy: str = "keep"
    q: float | None = None
    method: str = "linear"
    strict: bool = False
    function: Callable | None = None
    returns: str = "double"

    def with_policy(self, policy: str) -> Reducer:
        return replace(self, policy=check_policy(policy))

    def over_rows(self, c: Column, kind: T.DataType, order: Column) -> Column:
        """The aggregate of a column; `order` is the rows' order, unique within a group."""
        if self.kind == "user":
            listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), c.alias("v")))), lambda x: x["v"])
            f = self.function
            return F.udf(lambda values: f(list(values)), self.returns, useArrow=True)(listed)
        ok = valid(c, kind)
        v, rank = c, order
        if self.policy == "ignore":
            v, rank = F.when(ok, c), F.when(ok, order)
        elif self.policy == "zero":
            v = F.when(ok, c).otherwise(F.lit(0).cast(kind))
        rows = F.count_if(ok) if self.policy == "ignore" else F.count(F.lit(1))
        match self.kind:
            case "sum":
                out = F.coalesce(F.sum(v), F.lit(0))
            case "avg":
                out = F.coalesce(F.avg(v), F.lit(0.0))
            case "max":
                out = F.max(v)
            case "min":
                out = F.min(v)
            case "count":
                out = rows
            case "first":
                out = F.min_by(F.struct(v.alias("v")), rank)["v"]
            case "last":
                out = F.max_by(F.struct(v.alias("v")), rank)["v"]
            case "keep":
                out = F.when(F.min(v).eqNullSafe(F.max(v)), F.min_by(F.struct(v.alias("v")), rank)["v"])
            case "difference":
                out = F.max(v) - F.min(v)
            case "median":
                out = F.median(v)
            case "stddev":
                out = F.stddev_pop(v)
            case "percentile" if self.method == "linear":
                out = F.percentile(v, F.lit(self.q / 100))
            case "percentile":
                arr = F.sort_array(F.collect_list(v))
                out = pick(arr, (F.size(arr) - 1) * F.lit(self.q) / F.lit(100.0), self.method)
            case _:
                raise ReducerError(f"no such reducer: {self.kind}")
        if self.policy == "propagate":
            out = F.when(F.count_if(~ok) == 0, out)
        elif self.policy == "none_if_empty":
            out = F.when(F.count(F.lit(1)) > 0, out)
        elif self.policy == "keep" and self.strict:
            out = F.when(F.count_if(~ok) > 0, F.raise_error(F.lit(f"{self.kind}: missing value"))).otherwise(out)
        return out

    def over_columns(self, cols: list[Column], kinds: list[T.DataType]) -> Column:
        """The same over the values of some columns of one row, in their order."""
        oks = [valid(c, k) for c, k in zip(cols, kinds, strict=True)]
        zero = self.policy == "zero"
        vals = [F.when(o, c).otherwise(F.lit(0)) if zero else c for c, o in zip(cols, oks, strict=True)]
        every = oks[0]
        for o in oks[1:]:
            every = every & o
        pairs = F.array(*[F.struct(v.alias("v"), (o if self.policy == "ignore" else F.lit(True)).alias("o")) for v, o in zip(vals, oks, strict=True)])
        kept = F.transform(F.filter(pairs, lambda x: x["o"]), lambda x: x["v"])
        seen = F.filter(kept, lambda x: x.isNotNull())
        n = F.size(kept)
        total = vals[0] if self.policy not in ("ignore",) else None
        match self.kind:
            case "sum" | "avg" if total is not None:
                for v in vals[1:]:
                    total = total + v
                out = total if self.kind == "sum" else total / F.lit(float(len(vals)))
            case "sum" | "avg":
                s = F.lit(0)
                for v, o in zip(cols, oks, strict=True):
                    s = s + F.when(o, v).otherwise(F.lit(0))
                out = s if self.kind == "sum" else F.coalesce(F.try_divide(s, n), F.lit(0.0))
            case "max":
                out = F.array_max(kept)
            case "min":
                out = F.array_min(kept)
            case "count":
                out = n
            case "first":
                out = F.get(kept, F.lit(0))
            case "last":
                out = F.get(kept, n - 1)
            case "keep":
                out = F.when(F.size(F.array_distinct(seen)) <= 1, F.get(kept, F.lit(0)))
            case "difference":
                out = F.array_max(kept) - F.array_min(kept)
            case "median":
                out = pick(F.array_sort(seen), (F.size(seen) - 1) / F.lit(2.0), "midpoint")
            case "stddev":
                mean = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.size(seen)
                out = F.sqrt(F.aggregate(seen, F.lit(0.0), lambda a, x: a + F.pow(x - mean, 2)) / F.size(seen))
            case "percentile":
                out = pick(F.array_sort(seen), (F.size(seen) - 1) * F.lit(self.q) / F.lit(100.0), self.method)
            case _:
                raise ReducerError(f"no such reducer over columns: {self.kind}")
        if self.kind in ("median", "stddev", "percentile"):
            out = F.when(F.size(seen) > 0, out)
        if self.policy == "propagate":
            out = F.when(every, out)
        elif self.policy == "keep" and self.strict:
            out = F.when(~every, F.raise_error(F.lit(f"{self.kind}: missing value"))).otherwise(out)
        return out


def _plain(kind: str) -> Callable[..., Reducer]:
    def make(policy: str | None = None, strict: bool = False) -> Reducer:
        return Reducer(kind, check_policy(policy), strict=strict)

    make.__name__ = kind
    make.__doc__ = f"The reducer {kind!r} under a missing-value policy."
    return make


total = _plain("sum")
avg = mean = _plain("avg")
maximum = _plain("max")
minimum = _plain("min")
count = _plain("count")
first = _plain("first")
last = _plain("last")
keep = _plain("keep")
difference = _plain("difference")
median = _plain("median")
stddev = stdev = _plain("stddev")


def percentile(q: float, method: str = "linear", policy: str | None = None) -> Reducer:
    """The q-th percentile (0 to 100), interpolated by `method`."""
    if not 0 <= q <= 100:
        raise ReducerError(f"a percentile lies between 0 and 100, not at {q}")
    if method not in METHODS:
        raise ReducerError(f"no such method: {method!r}; there are {', '.join(METHODS)}")
    return Reducer("percentile", check_policy(policy), q=q, method=method)


def user(function: Callable, returns: str = "double") -> Reducer:
    """Any function of the list of a group's values, in order, to one value of type `returns`; runs in Python, and a group's
    values come together in one task."""
    return Reducer("user", function=function, returns=returns)


BY_NAME = {"sum": total, "avg": avg, "mean": mean, "max": maximum, "min": minimum, "count": count, "first": first, "last": last, "keep": keep, "difference": difference, "median": median, "stddev": stddev, "stdev": stdev}


def reducer(what: Reducer | str | Callable) -> Reducer:
    """A reducer, one by name, or a user's function."""
    if isinstance(what, Reducer):
        return what
    if isinstance(what, str) and what in BY_NAME:
        return BY_NAME[what]()
    if callable(what):
        return user(what)
    raise ReducerError(f"not a reducer: {what!r}")
