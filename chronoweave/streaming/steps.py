"""Fill, align, rate and take, one row after the other: the state that a stream keeps per series.

Every step turns a list of rows (time, values) in time order into output rows and keeps what it needs for the next list.
State is plain data, so that it can be stored between micro-batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

Row = tuple[int, list[Any]]


def is_valid(v: Any) -> bool:
    """Neither null, NaN, an empty text, nor a text that reads as NaN."""
    if v is None or v == "":
        return False
    if isinstance(v, str):
        return v.strip().lower() not in ("nan", "+nan", "-nan")
    return not (isinstance(v, float) and math.isnan(v))


def number(v: Any) -> float | None:
    """The value as a number, or None."""
    if not is_valid(v) or isinstance(v, bool):
        return None
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


@dataclass
class FillStep:
    """Missing values by zero, the value before, or linearly; a linear gap is held back until a valid value or the limit."""

    fields: list[int]
    method: str = "zero"
    limit: int | None = None
    last: dict[int, Any] = field(default_factory=dict)
    runs: dict[int, int] = field(default_factory=dict)
    held: list[Row] = field(default_factory=list)

    def push(self, rows: list[Row]) -> list[Row]:
        return self._linear(rows) if self.method == "linear" else [self._near(t, list(v)) for t, v in rows]

    def _near(self, t: int, v: list[Any]) -> Row:
        for f in self.fields:
            if is_valid(v[f]):
                self.last[f], self.runs[f] = v[f], 0
                continue
            self.runs[f] = self.runs.get(f, 0) + 1
            if self.limit is None or self.runs[f] <= self.limit:
                v[f] = 0 if self.method == "zero" else self.last.get(f, v[f])
        return t, v

    def _linear(self, rows: list[Row]) -> list[Row]:
        """Held rows start at the oldest open gap of any field; each field has its own anchor."""
        for t, v in rows:
            self.held.append((t, list(v)))
            n = len(self.held)
            for f in self.fields:
                if not is_valid(v[f]):
                    continue
                gap = self.runs.get(f, 0)
                a = self.last.get(f)
                if gap and a is not None and (self.limit is None or gap < self.limit):
                    x0, x1 = number(a[1]), number(v[f])
                    if x0 is not None and x1 is not None and t != a[0]:
                        for k in range(max(0, n - 1 - gap), n - 1):
                            at, cells = self.held[k]
                            cells[f] = x0 + (x1 - x0) * ((at - a[0]) / (t - a[0]))
                self.last[f] = (t, v[f])
            for f in self.fields:
                self.runs[f] = 0 if is_valid(v[f]) else self.runs.get(f, 0) + 1
        # a gap that can no longer be filled, too long or without a value before it, holds nothing back
        wait = max((r for f, r in self.runs.items() if f in self.last and (self.limit is None or r < self.limit)), default=0)
        out, self.held = self.held[: len(self.held) - wait], self.held[len(self.held) - wait :]
        return out

    def flush(self) -> list[Row]:
        """What is held back, unfilled."""
        out, self.held = self.held, []
        return out


@dataclass
class AlignStep:
    """Values at the multiples of `step_ms` between consecutive rows."""

    step_ms: int
    method: str = "linear"
    limit: int | None = None
    last: Row | None = None

    def push(self, rows: list[Row]) -> list[Row]:
        out: list[Row] = []
        for t, v in rows:
            if self.last is None:
                if t % self.step_ms == 0:
                    out.append((t, list(v)))
            else:
                pt, pv = self.last
                at = range((pt // self.step_ms + 1) * self.step_ms, t + 1, self.step_ms)
                many = self.limit is not None and len(at) > self.limit
                for g in at:
                    out.append((g, [None if many else self._value(a, b, (g - pt) / (t - pt)) for a, b in zip(pv, v, strict=True)]))
            self.last = (t, list(v))
        return out

    def _value(self, a: Any, b: Any, part: float) -> Any:
        if self.method == "hold":
            return a
        x, y = number(a), number(b)
        return None if x is None or y is None else x + (y - x) * part

    def flush(self) -> list[Row]:
        return []


@dataclass
class RateStep:
    """Change per second; the first value of each output row is the time of the row before."""

    allow_negative: bool = True
    last: Row | None = None

    def push(self, rows: list[Row]) -> list[Row]:
        out: list[Row] = []
        for t, v in rows:
            if self.last is not None:
                pt, pv = self.last
                out.append((t, [pt, *[self._rate(a, b, (t - pt) / 1000) for a, b in zip(pv, v, strict=True)]]))
            self.last = (t, list(v))
        return out

    def _rate(self, a: Any, b: Any, seconds: float) -> float | None:
        x, y = number(a), number(b)
        if x is None or y is None or seconds == 0:
            return None
        r = (y - x) / seconds
        return r if r >= 0 or self.allow_negative else None

    def flush(self) -> list[Row]:
        return []


@dataclass
class TakeStep:
    """The first rows."""

    limit: int
    seen: int = 0

    def push(self, rows: list[Row]) -> list[Row]:
        out = rows[: max(0, self.limit - self.seen)]
        self.seen += len(out)
        return out

    def flush(self) -> list[Row]:
        return []
