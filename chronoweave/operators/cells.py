"""What counts as missing in the domain tables; used by every operator that reads them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States that describe the interface, while its reading still counts.
READ_STATES = ("ok", "fail", "offline", "degraded")

# The states that an availability row can have.
DAY_STATES = ("up", "degraded", "down", "maint")

DAY_MS = 86_400_000
POLL_SECONDS = 300


def plain(col: Column | str) -> Column:
    """Lower case without outer white space; a blank text is null."""
    c = F.lower(F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"^\s+|\s+$", ""))
    return F.when(c != "", c)


def reading_missing(value: Column, status: Column) -> Column:
    """A reading is missing if null, NaN, or if its status says that nothing was read."""
    return value.isNull() | F.isnan(value) | F.coalesce(~plain(status).isin(*READ_STATES), F.lit(False))


def bytes_missing(count: Column, speed_mbit: Column) -> Column:
    """A byte count is missing if null, negative, or above what the line carries in one poll; without a speed there is no upper bound."""
    most = speed_mbit * F.lit(1e6 / 8 * POLL_SECONDS)
    return count.isNull() | (count < 0) | F.coalesce(count.cast("double") > most, F.lit(False))


def day_state(value: Column) -> Column:
    """The state of the day, or null where the text is no state."""
    c = plain(value)
    return F.when(c.isin(*DAY_STATES), c)
