"""A search from text to a page of rows: parse, resolve, prepare, window, lower, sort, page, count."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame

from lumenq.operators.symbols import hydrate
from lumenq.plans import lower, paging, prepare, window
from lumenq.query import Resource, from_legacy, parse, resolve
from lumenq.query.tree import Node, from_json
from lumenq.scope import ALL, Scope

# The time column and the sort keys of each list.
TIME = {Resource.ISSUES: "last_seen", Resource.OCCURRENCES: "occurred_at", Resource.EVENTS: "occurred_at", Resource.SESSIONS: "last_event_at", Resource.TRANSACTIONS: "occurred_at", Resource.PERSONS: "last_seen", Resource.DEVICES: "last_seen"}
SORTS = {
    Resource.ISSUES: ("last_seen", "first_seen", "times_seen", "users_seen"),
    Resource.OCCURRENCES: ("occurred_at",),
    Resource.EVENTS: ("occurred_at", "name", "distinct_id", "session_id"),
    Resource.SESSIONS: ("started_at", "last_event_at", "events_count", "errors_count"),
    Resource.TRANSACTIONS: ("occurred_at", "duration_ms", "name"),
    Resource.PERSONS: ("last_seen", "distinct_id", "first_seen", "sessions_count", "events_count", "errors_count"),
    Resource.DEVICES: ("last_seen", "family", "os_name", "browser", "distinct_id", "sessions_count", "events_count", "errors_count"),
}
TIES = {Resource.SESSIONS: ("session_id", "app_id"), Resource.PERSONS: ("distinct_id", "app_id"), Resource.DEVICES: ("device_key", "app_id")}  # apps share these


def tree(query: str | dict | None = None, filters: Iterable[str] = (), q: str | None = None) -> Node:
    """The tree of a query text or its JSON form, or else of the older parameters."""
    if isinstance(query, dict):
        return from_json(query)
    return parse(query) if query is not None else from_legacy(filters, q)


def rows(df: DataFrame, resource: Resource, node: Node, now: dt.datetime, days: int = 30, scope: Scope = ALL, environments: DataFrame | None = None, occurrences: DataFrame | None = None, body: bool = True, most: int = 365, blobs: DataFrame | None = None) -> tuple[DataFrame, window.Window]:
    """All rows that pass within scope and window, and the window that was used. ``blobs``: the pool of stack traces, for
    rows that have only the key of theirs; it is joined if the search asks for stacks."""
    p = prepare.prepare(resolve(node, resource), resource, now, environments, scope, body)
    w = window.last_days(TIME[resource], now, days, most, p.clamp)
    base = w.apply(scope.apply(df))
    if resource is Resource.EVENTS:
        base = base.filter("name is null or name <> '$screen'")  # the list leaves screen views to the screens' reports
    if blobs is not None and any(t.field.column == "stacktrace" for t in prepare.tests(p.node)):
        base = hydrate(base, blobs)
    found = lower.apply(base, p.node, resource, p.context, occurrences, scope, w.start)
    if not body and resource is not Resource.ISSUES:
        found = found.drop(*[c for c in found.columns if c in lower.BODY])
    return found, w


def listing(df: DataFrame, resource: Resource, node: Node, now: dt.datetime, sort: str | None = None, limit: int = 50, cursor: str | None = None, **kw) -> paging.Listing:
    """One page with its count; ``cursor`` continues a list in the same sort."""
    tie, *also = TIES.get(resource, ("id",))
    s = paging.Sort.parse(sort, SORTS[resource], TIME[resource], tie, tuple(also))
    found, w = rows(df, resource, node, now, **kw)
    temporal = dict(found.dtypes)[s.key].startswith("timestamp")
    c = paging.Cursor.decode(cursor, s.key, temporal, uuids=resource is Resource.ISSUES, also=len(also)) if cursor else None
    return paging.Listing(paging.page(found, s, limit, c), paging.capped_count(found), w.clamped, s, limit)
