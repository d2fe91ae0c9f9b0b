"""Time windows of lists: by days back from now, or by a named field between two bounds; narrowings are disclosed."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lumenq.plans.prepare import Clamp
from lumenq.query.errors import QueryError


@dataclass(frozen=True)
class Clamped:
    field: str
    to: str
    reason: str


@dataclass(frozen=True)
class Window:
    """[start, end); ``end`` None is open."""

    column: str
    start: dt.datetime
    end: dt.datetime | None = None
    clamped: Clamped | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        c = F.col(self.column)
        kept = c >= F.lit(self.start)
        return df.filter(kept if self.end is None else kept & (c < F.lit(self.end)))


def _bound(days: int) -> str:
    return f"this view bounds its time window at {days} days"


def last_days(column: str, now: dt.datetime, days: int, most: int, clamp: Clamp | None = None) -> Window:
    """The tightest of the caller's, the route's and the planner's window; raising ``days`` to 1 isn't a narrowing."""
    limits = [(max(1, min(days, most)), _bound(most) if days > most else None)]
    if clamp and clamp.days < limits[0][0]:
        limits.append((clamp.days, clamp.reason))
    got, why = limits[-1]
    return Window(column, now - dt.timedelta(days=got), None, Clamped(column, f"{got}d", why) if why else None)


def between(default: str, allowed: tuple[str, ...], now: dt.datetime, field: str | None = None, start: dt.datetime | None = None, end: dt.datetime | None = None, days: int | None = None, default_days: int = 30, most: int = 365, clamp: Clamp | None = None) -> Window:
    """A half-open window on a whitelisted field. Without a lower bound it reaches ``most`` days back from the upper."""
    column = field or default
    if column not in allowed:
        raise QueryError("bad_time_field", f"{column}: one of {', '.join(allowed)}")
    floor = (end or now) - dt.timedelta(days=most)
    if start is None and end is None:
        wanted = default_days if days is None else days
        low, why = now - dt.timedelta(days=max(1, min(wanted, most))), _bound(most) if wanted > most else None
    else:
        low, why = (start, None) if start is not None else (floor, _bound(most))
    if end is not None and low >= end:
        raise QueryError("bad_window", "from must be earlier than to")
    if low < floor:
        low, why = floor, _bound(most)
    if clamp and now - dt.timedelta(days=clamp.days) > low:
        low, why = now - dt.timedelta(days=clamp.days), clamp.reason
    return Window(column, low, end, Clamped(column, f"{((end or now) - low).days}d", why) if why else None)
