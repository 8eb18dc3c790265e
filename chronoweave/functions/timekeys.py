"""Durations, index strings, calendar keys and time conversion: as columns, and as Python values for plan building."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoweave.errors import TimeError

# The units of a duration such as '30s' or '5m', in milliseconds.
UNIT_MS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}

# Formats of the calendar keys, and how the nice text of each is written.
CALENDAR = {"daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "yearly": "yyyy"}
NICE = {"day": "MMMM d yyyy", "month": "MMMM", "year": "yyyy"}

# Fixed value: the format of a time as text.
TEXT_FORMAT = "EEE, dd MMM yyyy HH:mm:ss z"


def duration_ms(text: str) -> int | None:
    """Milliseconds of a text that begins with a duration ('5m', also '5m-4754394'); None for others."""
    m = re.match(r"(\d+)([smhd])", text) if isinstance(text, str) else None
    return int(m[1]) * UNIT_MS[m[2]] if m else None


def need_duration(text: str) -> int:
    ms = duration_ms(text)
    if not ms:
        raise TimeError(f"not a duration: {text!r}")
    return ms


def position(ms: Column, duration: str) -> Column:
    """Number of the window that holds a time; times before 1970 are cut toward zero, as the index strings require."""
    return _div(ms, need_duration(duration))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def index_string(ms: Column, duration: str) -> Column:
    """'5m-4754394' and the like."""
    return F.concat(F.lit(f"{re.match(r'[0-9]+[smhd]', duration)[0]}-"), _div(ms, need_duration(duration)).cast("string"))


def index_strings(begin_ms: Column, end_ms: Column, duration: str) -> Column:
    """All index strings of a range, both ends included."""
    d = need_duration(duration)
    return F.transform(F.sequence(_div(begin_ms, d), _div(end_ms, d)), lambda p: F.concat(F.lit(f"{duration}-"), p.cast("string")))


def calendar_key(ms: Column, kind: str, tz: str = "UTC") -> Column:
    """'2014-09-17', '2014-09' or '2014' of a time in a time zone; the session's time zone has no say."""
    return F.date_format(_local(ms, tz), CALENDAR[kind])


def _local(ms: Column, tz: str) -> Column:
    """Wall-clock time as TIMESTAMP_NTZ."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))


def _utc_ms(local: Column, tz: str) -> Column:
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.convert_timezone(F.lit(tz), F.lit("UTC"), local))


def window_key(ms: Column, kind: str, duration: str | None, tz: str = "UTC") -> Column:
    """The key of the window that holds a time: fixed, calendar, or 'global'."""
    if kind == "fixed":
        return index_string(ms, duration)
    return calendar_key(ms, kind, tz) if kind in CALENDAR else F.lit("global")


_FIXED, _DAY, _MONTH, _YEAR = r"^(\d+)([smhd])-(-?\d+)$", r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{4})-(\d{2})$", r"^(\d{4})$"


def index_range(index: Column, tz: str = "UTC") -> tuple[Column, Column]:
    """Begin and end milliseconds of an index string; calendar ranges end one second before the next begins.

    A text that is no index gives nulls.
    """
    n = F.regexp_extract(index, _FIXED, 1).try_cast("long")
    unit = F.regexp_extract(index, _FIXED, 2)
    size = F.lit(None).cast("long")
    for u, ms in UNIT_MS.items():
        size = F.when(unit == u, n * F.lit(ms)).otherwise(size)
    at = F.regexp_extract(index, _FIXED, 3).try_cast("long")
    fixed = index.rlike(_FIXED)
    day, month, year = index.rlike(_DAY), index.rlike(_MONTH), index.rlike(_YEAR)
    text = F.when(day, index).when(month, F.concat(index, F.lit("-01"))).when(year, F.concat(index, F.lit("-01-01")))
    first = text.try_cast("date")
    after = F.when(day, F.date_add(first, 1)).when(month, F.add_months(first, 1)).when(year, F.add_months(first, 12))
    begin = F.when(fixed, at * size).otherwise(_utc_ms(first.cast("timestamp_ntz"), tz))
    end = F.when(fixed, (at + 1) * size).otherwise(_utc_ms(after.cast("timestamp_ntz"), tz) - 1000)
    return begin, end


def nice_index(index: Column, fmt: str | None = None) -> Column:
    """'September 17 2014' of a day, 'September' of a month, the year, any other index as it is; or by a format."""
    begin, _ = index_range(index)
    local = _local(begin, "UTC")
    if fmt is not None:
        return F.coalesce(F.date_format(local, fmt), index)
    return F.when(index.rlike(_DAY), F.date_format(local, NICE["day"])).when(index.rlike(_MONTH), F.date_format(local, NICE["month"])).otherwise(index)


def time_text(ms: Column, tz: str = "UTC") -> Column:
    """'Sat, 14 Mar 2015 07:32:22 UTC'."""
    out = F.date_format(_local(ms, tz), TEXT_FORMAT.removesuffix(" z"))
    return F.concat(out, F.lit(f" {tz}"))


def add_months(ms: Column, n: int) -> Column:
    """A time moved by months; the day is cut to the month's last, the time of day stays (UTC)."""
    day = F.floor(ms / UNIT_MS["d"])
    moved = F.add_months(F.date_from_unix_date(day.cast("int")), n)
    return F.unix_date(moved).cast("long") * UNIT_MS["d"] + F.pmod(ms, F.lit(UNIT_MS["d"]))


# Python values, for plan building


def to_ms(t: datetime | int) -> int:
    """Epoch milliseconds of an integer or an aware datetime; microseconds are cut. Naive datetimes raise."""
    if isinstance(t, bool) or not isinstance(t, (int, datetime)):
        raise TimeError(f"not a time: {t!r}")
    if isinstance(t, int):
        return t
    if t.tzinfo is None:
        raise TimeError(f"a datetime needs a time zone: {t!r}")
    return (t - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)


def from_ms(ms: int, tz: str = "UTC") -> datetime:
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=ms)).astimezone(ZoneInfo(tz))


def range_of_index(text: str, tz: str = "UTC") -> tuple[int, int]:
    """Begin and end milliseconds of an index string; a bad one raises."""
    if m := re.fullmatch(_FIXED[1:-1], text):
        d = int(m[1]) * UNIT_MS[m[2]]
        if d:
            return int(m[3]) * d, (int(m[3]) + 1) * d
    for pattern in (_DAY, _MONTH, _YEAR):
        if m := re.fullmatch(pattern[1:-1], text):
            part = [int(x) for x in m.groups()]
            y, mo, d = (part + [1, 1])[:3]
            try:
                first = datetime(y, mo, d)
                after = first + timedelta(days=1) if len(part) == 3 else datetime(y + mo // 12, mo % 12 + 1, 1) if len(part) == 2 else datetime(y + 1, 1, 1)
            except ValueError as e:
                raise TimeError(f"not an index: {text!r}") from e
            zone = ZoneInfo(tz)
            return to_ms(first.replace(tzinfo=zone).astimezone(UTC)), to_ms(after.replace(tzinfo=zone).astimezone(UTC)) - 1000
    raise TimeError(f"not an index: {text!r}")
