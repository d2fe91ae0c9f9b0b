"""Searchable fields by resource: their types, operators and where they are stored."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field as default


class Resource(enum.Enum):
    ISSUES = "issues"
    OCCURRENCES = "occurrences"
    EVENTS = "events"
    SESSIONS = "sessions"
    DEVICES = "devices"
    PERSONS = "persons"
    TRANSACTIONS = "transactions"


class Cost(enum.IntEnum):
    INDEXED, BOUNDED, SCAN = range(3)


@dataclass(frozen=True)
class Field:
    """kind: str, enum, int, bool, duration or time. store: column, json (with ``prefix`` inside it), tag or rollup."""

    name: str
    kind: str
    ops: frozenset[str]
    column: str
    resources: frozenset[Resource]
    store: str = "column"
    prefix: str = ""
    aliases: tuple[str, ...] = ()
    options: tuple[str, ...] = ()
    cost: Cost = Cost.BOUNDED
    extra: dict = default(default_factory=dict, compare=False, hash=False)


# Operator sets, value lists and shorthands of the language.
EQ = frozenset("eq ne in has".split())
TEXT = EQ | {"like", "contains"}
ORD = frozenset("eq ne gt gte lt lte has".split())
WORKFLOW = frozenset("eq ne contains".split())
LEVELS = ("debug", "info", "warning", "error", "fatal")
STATUSES = ("unresolved", "resolved", "ignored")
SYMBOLICATION = ("pending", "processing", "symbolicated", "failed", "skipped", "unsupported")
SHORTHANDS = {"unresolved": ("is", "unresolved"), "resolved": ("is", "resolved"), "ignored": ("is", "ignored"), "handled": ("handled", "true"), "unhandled": ("handled", "false")}


def _on(names: str) -> frozenset[Resource]:
    return frozenset(map(Resource, names.split()))


def _f(names: str, kind: str, ops: frozenset[str], column: str, on: str, **kw) -> Field:
    name, *aliases = names.split()
    return Field(name, kind, ops, column, _on(on), aliases=tuple(aliases), **kw)


_I = {"cost": Cost.INDEXED}
_SCAN = {"cost": Cost.SCAN}


def _json(name: str, column: str, on: str, prefix: str = "", **kw) -> Field:
    return _f(name, "str", TEXT, column, on, store="json", prefix=prefix, **kw)


# The fields of the language, with their spellings, and where each may be used.
FIELDS: tuple[Field, ...] = (
    _f("is status", "enum", EQ, "status", "issues", options=STATUSES, **_I),
    _f("level", "enum", EQ, "level", "issues occurrences", options=LEVELS),
    _f("type", "str", TEXT, "type", "issues"),
    _f("culprit", "str", TEXT, "culprit", "issues"),
    _f("title", "str", TEXT, "title", "issues", **_SCAN),
    _f("timesSeen", "int", ORD, "times_seen", "issues"),
    _f("usersSeen", "int", ORD, "users_seen", "issues"),
    _f("firstSeen", "time", ORD, "first_seen", "issues", **_I),
    _f("lastSeen", "time", ORD, "last_seen", "issues", **_I),
    _f("workflow", "str", WORKFLOW, "workflow_name", "issues occurrences events"),
    _f("environment", "str", EQ, "environment_id", "issues", store="rollup"),
    _f("release", "str", TEXT, "release", "issues", store="rollup"),
    _f("handled", "bool", EQ, "handled", "issues", store="rollup"),
    _f("handled", "bool", EQ, "handled", "occurrences"),
    _f("environment", "str", EQ, "environment_id", "occurrences events sessions", **_I),
    _f("release", "str", TEXT, "release", "occurrences events sessions"),
    _f("distinctId distinct_id", "str", TEXT, "distinct_id", "occurrences events persons sessions transactions issues", **_I),
    _f("session session_id", "str", TEXT, "session_id", "occurrences events sessions transactions", **_I),
    _f("deviceKey", "str", EQ, "device_key", "occurrences devices sessions issues", **_I),
    _f("screen", "str", TEXT, "screen", "issues occurrences"),
    _f("symbolication", "enum", EQ, "symbolication_status", "occurrences", options=SYMBOLICATION),
    _f("message", "str", TEXT, "message", "occurrences", **_SCAN),
    _json("context", "context", "occurrences events sessions"),
    _json("user", "event_user", "occurrences"),
    _json("sdk", "sdk", "occurrences"),
    _json("os", "context", "occurrences", "os"),
    _json("browser", "context", "occurrences", "runtime"),
    _json("device", "context", "occurrences", "device"),
    _json("app", "context", "occurrences", "app"),
    _json("contexts", "contexts", "occurrences events"),
    _json("extra", "extra", "occurrences events transactions"),
    _json("properties", "properties", "events"),
    _json("traits", "properties", "persons", **_SCAN),
    _f("stack", "str", TEXT, "stacktrace", "occurrences", store="json", extra={"array": True}, **_SCAN),
    _f("name", "str", TEXT, "name", "events transactions"),
    _f("op", "str", TEXT, "op", "transactions"),
    _f("duration duration_ms", "duration", ORD, "duration_ms", "transactions sessions", **_SCAN),
    _f("url", "str", TEXT, "url", "transactions", **_SCAN),
    _f("http.status", "int", ORD, "http_status", "transactions"),
    _f("http.method", "str", EQ, "http_method", "transactions"),
    _f("browser", "str", TEXT, "browser", "devices"),
    _f("device.family", "str", TEXT, "family", "devices"),
    _f("device.model", "str", TEXT, "model", "devices"),
    _f("device.arch", "str", TEXT, "arch", "devices"),
    _f("os.name", "str", TEXT, "os_name", "devices"),
    _f("os.version", "str", TEXT, "os_version", "devices"),
    _f("startedAt", "time", ORD, "started_at", "sessions", **_I),
    _f("eventsCount", "int", ORD, "events_count", "sessions"),
    _f("errorsCount", "int", ORD, "errors_count", "sessions"),
)
TAG = _f("tag", "str", TEXT, "tags", "issues occurrences events transactions", store="tag", **_I)

_BY_NAME = {(n, r): f for f in FIELDS for n in (f.name, *f.aliases) for r in f.resources}


def lookup(name: str, r: Resource) -> Field | None:
    return _BY_NAME.get((name, r))


def tag_field(r: Resource) -> Field | None:
    return TAG if r in TAG.resources else None
