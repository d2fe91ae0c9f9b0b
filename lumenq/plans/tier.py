"""Which part of a time window is read from the hot tier and which from the cold one."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from itertools import groupby, pairwise

Range = tuple[dt.datetime, dt.datetime]


def plan(watermark: dt.datetime, start: dt.datetime, end: dt.datetime, restored: Iterable[Range] = ()) -> dict[str, list[Range]]:
    """{"hot": ranges, "cold": ranges}, half-open, disjoint, together exactly [start, end).

    What lies before the watermark is cold, but for ranges restored to the hot tier. All bounds cut the window into
    elementary pieces, each piece has one tier, and neighbours of a tier are one range.
    """
    out: dict[str, list[Range]] = {"hot": [], "cold": []}
    restored = [(a, b) for a, b in restored if a < b]
    cuts = sorted({start, end, *(t for t in [watermark, *(x for r in restored for x in r)] if start < t < end)})
    pieces = [(a, b, "hot" if a >= watermark or any(lo <= a < hi for lo, hi in restored) else "cold") for a, b in pairwise(cuts) if a < b] if start < end else []
    for tier, run in groupby(pieces, key=lambda p: p[2]):
        run = list(run)
        out[tier].append((run[0][0], run[-1][1]))
    return out


def bucket(t: dt.datetime, granularity: str) -> Range:
    """The UTC day, ISO week (from Monday) or month that holds ``t``."""
    day = t.astimezone(dt.timezone.utc).replace(hour=0, minute=0, second=0, microsecond=0)
    match granularity:
        case "day":
            return day, day + dt.timedelta(days=1)
        case "week":
            day -= dt.timedelta(days=day.weekday())
            return day, day + dt.timedelta(days=7)
        case "month":
            first = day.replace(day=1)
            return first, (first + dt.timedelta(days=31)).replace(day=1)
    raise ValueError(granularity)


def months(start: dt.datetime, end: dt.datetime) -> list[tuple[int, int]]:
    """(year, month) of every month that [start, end) touches, for pruning partitions."""
    out, t = [], bucket(start, "month")[0]
    while t < end:
        out.append((t.year, t.month))
        t = bucket(t, "month")[1]
    return out
