"""Which values are valid, and the policies for those that are not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.errors import ReducerError

#: keep: as they are (aggregates skip nulls); ignore: left out; zero: 0; propagate: any makes the result null;
#: none_if_empty: null instead of a value for no rows.
POLICIES = ("keep", "ignore", "zero", "propagate", "none_if_empty")


def check_policy(policy: str | None) -> str:
    if policy is None:
        return "keep"
    if policy not in POLICIES:
        raise ReducerError(f"no such missing-value policy: {policy!r}; there are {', '.join(POLICIES)}")
    return policy


def valid(c: Column, kind: T.DataType) -> Column:
    """True where a value is neither null, NaN, an empty text, nor a text that reads as NaN. Never null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNotNull() & ~F.isnan(c)
    if isinstance(kind, T.StringType):
        return F.coalesce((c != "") & ~F.lower(F.trim(c)).isin("nan", "+nan", "-nan"), F.lit(False))
    return c.isNotNull()


def numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def as_number(c: Column, kind: T.DataType) -> Column:
    """The value as DOUBLE; null where it is no number. Integers of other numeric types stay what they are."""
    if numeric(kind):
        return c
    return c.try_cast("double")
