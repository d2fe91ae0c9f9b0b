"""Sorting, keyset and offset pages, capped counts, and the list envelope."""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from lumenq.plans.window import Clamped
from lumenq.query.errors import QueryError

COUNT_CAP = 10_000


@dataclass(frozen=True)
class Sort:
    """A bare key sorts downwards, ``-key`` upwards. Nulls come last, ties go by ``tie``, then by ``also``."""

    key: str
    down: bool = True
    tie: str = "id"
    also: tuple[str, ...] = ()

    @staticmethod
    def parse(text: str | None, allowed: tuple[str, ...], default: str, tie: str = "id", also: tuple[str, ...] = ()) -> "Sort":
        name = text or default
        key = name.removeprefix("-")
        if key not in allowed:
            raise QueryError("bad_sort", f"{key}: one of {', '.join(allowed)}")
        return Sort(key, not name.startswith("-"), tie, also)

    def order(self) -> list[Column]:
        c, ties = F.col(self.key), [F.col(t) for t in (self.tie, *self.also)]
        return [c.desc_nulls_last(), *[t.desc() for t in ties]] if self.down else [c.asc_nulls_last(), *[t.asc() for t in ties]]


@dataclass(frozen=True)
class Cursor:
    key: str
    value: dt.datetime | str | None
    id: str
    also: tuple[str, ...] = ()

    def encode(self) -> str:
        if isinstance(self.value, dt.datetime):
            v = "t:" + self.value.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        else:
            v = "n:" if self.value is None else "s:" + self.value
        return base64.urlsafe_b64encode("|".join((self.key, self.id, *self.also, v)).encode()).decode().rstrip("=")

    @staticmethod
    def decode(text: str, key: str, temporal: bool, uuids: bool = True, also: int = 0) -> "Cursor":
        try:
            got, ident, *more, v = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)).decode().split("|", 2 + also)
            kind, v = v[:2], v[2:]
            if len(more) != also:
                raise ValueError(text)
        except (ValueError, binascii.Error) as e:
            raise QueryError("bad_cursor", "malformed") from e
        if uuids:
            try:
                uuid.UUID(ident)
            except ValueError as e:
                raise QueryError("bad_cursor", "id") from e
        if got != key:
            raise QueryError("bad_cursor", f"of a list sorted by {got}, not {key}")
        if kind == "n:" and not v:
            return Cursor(key, None, ident, tuple(more))
        if kind not in ("t:", "s:") or (kind == "t:") != temporal:
            raise QueryError("bad_cursor", "kind")
        if not temporal:
            return Cursor(key, v, ident, tuple(more))
        try:
            return Cursor(key, dt.datetime.fromisoformat(v), ident, tuple(more))
        except ValueError as e:
            raise QueryError("bad_cursor", "timestamp") from e


def after(sort: Sort, cursor: Cursor) -> Column:
    """Rows behind the cursor's row in the sort's order, nulls of the key being last."""
    k, t, v, i = F.col(sort.key), F.col(sort.tie), F.lit(cursor.value), F.lit(cursor.id)
    t = t.cast("string") if sort.tie != "id" else t
    behind, same = (t < i if sort.down else t > i), t == i
    for name, value in zip(sort.also, cursor.also):
        c, x = F.col(name).cast("string"), F.lit(value)
        behind, same = behind | (same & (c < x if sort.down else c > x)), same & (c == x)
    if cursor.value is None:  # among the nulls, which come last
        return k.isNull() & behind
    return (k < v if sort.down else k > v) | ((k == v) & behind) | k.isNull()


def page(df: DataFrame, sort: Sort, limit: int, cursor: Cursor | None = None, offset: int = 0) -> DataFrame:
    """One page in total order; Spark takes it as a top-k, without sorting the whole."""
    rows = df if cursor is None else df.filter(after(sort, cursor))
    rows = rows.orderBy(*sort.order())
    return (rows.offset(offset) if offset else rows).limit(limit)


def capped_count(df: DataFrame, cap: int = COUNT_CAP) -> DataFrame:
    """(total, total_is_capped): counting stops past ``cap``. Rows without columns are taken a few partitions at a time
    until there are enough, so of many rows a few partitions are read and no task gets those of the others."""
    n = len(df.select(F.lit(True)).take(cap + 1))
    return df.sparkSession.range(1).select(F.lit(min(n, cap)).cast("bigint").alias("total"), F.lit(n > cap).alias("total_is_capped"))


@dataclass(frozen=True)
class Listing:
    """A list's page (a DataFrame), its capped count (one row) and what was narrowed."""

    data: DataFrame
    count: DataFrame
    clamped: Clamped | None
    sort: Sort
    limit: int

    def envelope(self) -> dict[str, Any]:
        """The page's rows with the cursor of the next one; ``limit`` rows at most reach the driver."""
        rows = [r.asDict(recursive=True) for r in self.data.collect()]
        total = self.count.first()
        cursor = None
        if len(rows) == self.limit:
            v = rows[-1][self.sort.key]
            cursor = Cursor(self.sort.key, v if v is None or isinstance(v, (dt.datetime, str)) else str(v), str(rows[-1][self.sort.tie]), tuple(str(rows[-1][c]) for c in self.sort.also)).encode()
        return {"data": rows, "total": total["total"], "total_is_capped": total["total_is_capped"], "next_cursor": cursor, "clamped": self.clamped}
