"""Typed searches as boolean columns.

Negation is pushed to the leaves, where it keeps null rows (``!f:v`` is true of a row without f). On issues, what is
asked of occurrences becomes *probes*: all probes of a search are answered by one aggregation of the scoped and
time-bounded occurrences by issue, whose flags are joined to the issues, however the search nests them.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Mapping
from dataclasses import dataclass, field as default
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from lumenq.query.catalog import Resource
from lumenq.query.errors import QueryError
from lumenq.query.resolve import Before, Resolved, Test, like_escape
from lumenq.query.tree import And, Not, Or, Text
from lumenq.scope import Scope

TEXT_COLUMNS = {
    Resource.OCCURRENCES: (("message", "exception_type", "exception_value"), ("contexts", "extra", "tags")),
    Resource.EVENTS: (("name", "distinct_id"), ("contexts", "extra", "properties", "tags")),
    Resource.SESSIONS: (("session_id", "distinct_id", "device_key", "release"), ("context",)),
    Resource.TRANSACTIONS: (("name", "url"), ("tags", "extra")),
    Resource.PERSONS: (("distinct_id",), ("properties",)),
    Resource.DEVICES: (("device_key", "family", "model", "os_name", "browser"), ()),
}
# What is withheld, from output and from predicates, where event bodies may not be read. An event's
# properties and a person's traits are no part of a body.
BODY = {"stacktrace", "stacktrace_symbolicated", "breadcrumbs", "context", "contexts", "extra", "tags", "sdk", "debug_meta", "event_user", "ip_address", "culprit"}
_FLIP = {"gt": "lte", "gte": "lt", "lt": "gte", "lte": "gt"}
_COMPARE = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}


@dataclass
class Context:
    """now: the clock of relative times. environments: ids by name. body: whether payload columns may be matched."""

    now: dt.datetime
    environments: Mapping[str, tuple[str, ...]] = default(default_factory=dict)
    body: bool = True


@dataclass
class Lowered:
    condition: Column
    probes: dict[str, Column] = default(default_factory=dict)
    unbounded: set[str] = default(default_factory=set)


def instant(spec: Any, now: dt.datetime) -> Column:
    """A typed time as a timestamp column."""
    if not isinstance(spec, Before):
        return F.lit(spec)
    base = F.lit(now)
    if spec.months:
        return base - F.make_ym_interval(F.lit(0), F.lit(spec.months))
    return base - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(spec.seconds).cast("decimal(18,6)"))


def plain(c: Column, op: str, value: Any, negate: bool) -> Column:
    """A test of an ordinary column."""
    match op:
        case "has":
            return c.isNull() if negate else c.isNotNull()
        case "eq" | "ne":
            if (op == "eq") != negate:
                return c == value
            return ~c.eqNullSafe(value)
        case "in":
            inside = c.isin(*value) if not isinstance(value, Column) else value
            return ~F.coalesce(inside, F.lit(False)) if negate else inside
        case "like" | "contains":
            return ~F.coalesce(c.ilike(value), F.lit(False)) if negate else c.ilike(value)
    return _COMPARE[_FLIP[op] if negate else op](c, value)


def json_path(path: str) -> str:
    return "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in path.split("."))


def json_test(c: Column, path: str | None, op: str, value: Any, negate: bool) -> Column:
    """A test inside a JSON column. Equality wants a string there: the number 5 isn't "5"; malformed JSON has nothing."""
    if path is None:
        return plain(c, op, value, negate) if op == "has" else _not_null(c.ilike(value) if op in ("like", "contains") else c == value, negate)
    at = json_path(path)
    if op in ("like", "contains"):
        return _not_null(F.get_json_object(c, at).ilike(value), negate)
    doc = F.try_parse_json(c)
    found = F.try_variant_get(doc, at, "variant")
    if op == "has":
        return _not_null(found.isNotNull(), negate)
    text = F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(doc, at, "string"))
    return _not_null(text.isin(*value) if op == "in" else text == value, negate)


def stack_test(c: Column, path: str | None, op: str, value: Any, negate: bool) -> Column:
    """Some frame's field passes; on the whole stack only presence can be asked."""
    if path is None:
        if op != "has":
            raise QueryError("bad_op", "stack needs a field: stack.function, stack.filename, ...")
        return _not_null(F.size(c) > 0, negate)
    test = (lambda f: f.getField(path).isNotNull()) if op == "has" else (lambda f: plain(f.getField(path).cast("string"), op, value, False))
    return _not_null(F.exists(c, lambda f: F.coalesce(test(f), F.lit(False))), negate)


def tag_test(c: Column, key: str | None, op: str, value: Any, negate: bool) -> Column:
    """A test of one tag, or, without a key, of any."""
    if key is not None:
        found = F.try_element_at(c, F.lit(key))
        return _not_null(F.map_contains_key(c, key) if op == "has" else plain(found, op, value, False), negate)
    if op == "has":
        return _not_null(F.size(c) > 0, negate)
    return _not_null(F.exists(F.map_values(c), lambda v: F.coalesce(plain(v, op, value, False), F.lit(False))), negate)


def _not_null(c: Column, negate: bool) -> Column:
    known = F.coalesce(c, F.lit(False))
    return ~known if negate else known


def as_text(df_type: str, c: str) -> Column:
    return F.to_json(c) if df_type.startswith(("map", "struct", "array")) else F.col(c).cast("string")


class Lowerer:
    def __init__(self, resource: Resource, ctx: Context, types: Mapping[str, str], occurrence_types: Mapping[str, str] | None = None):
        self.resource, self.ctx, self.types, self.occ = resource, ctx, types, dict(occurrence_types or {})
        self.out = Lowered(F.lit(True))

    def run(self, node: Resolved) -> Lowered:
        self.out.condition = self.node(node, False)
        return self.out

    def node(self, node: Resolved, negate: bool) -> Column:
        match node:
            case Not(of):
                return self.node(of, not negate)
            case And(of) | Or(of):
                parts = [self.node(x, negate) for x in of]
                if not parts:
                    return F.lit(isinstance(node, And) != negate)
                both = isinstance(node, And) != negate
                return functools.reduce(lambda a, b: a & b if both else a | b, parts)
            case Text(text):
                return self.text(text, negate)
        return self.leaf(node, negate)

    def probe(self, c: Column, negate: bool, bounded: bool = True) -> Column:
        """A flag of the issue: some occurrence passes ``c``."""
        name = f"_probe{len(self.out.probes)}"
        self.out.probes[name] = c
        if not bounded:
            self.out.unbounded.add(name)
        return _not_null(F.col(name), negate)

    def leaf(self, t: Test, negate: bool) -> Column:
        f = t.field
        if f.store == "rollup":
            raise QueryError("not_searchable", f"{f.name} on {self.resource.name.lower()}", t.at)
        if f.column in BODY and (f.store != "column" or self.resource is not Resource.ISSUES) and not self.ctx.body:
            raise QueryError("withheld", f.name, t.at)
        issues = self.resource is Resource.ISSUES
        if f.store == "tag":
            if issues:
                return self.probe(tag_test(F.col("tags"), t.path, t.op, t.value, False), negate, bounded=False)
            return tag_test(F.col("tags"), t.path, t.op, t.value, negate)
        if f.column == "workflow_name":
            made = F.col("workflow_id").isNotNull() & plain(F.col("workflow_name"), t.op, t.value, False)
            if issues:
                return self.probe(F.col("workflow_id").isNotNull() & plain(F.col("workflow_name"), "eq" if t.op == "ne" else t.op, t.value, False), negate != (t.op == "ne"), bounded=False)
            return _not_null(made, negate)
        if issues and f.column in ("distinct_id", "device_key", "screen"):
            return self.probe(plain(F.col(f.column), t.op, t.value, False), negate)
        if f.column == "environment_id":
            ids = [i for n in (t.value if t.op == "in" else [t.value]) for i in self.ctx.environments.get(n, ())] if t.op != "has" else []
            if t.op == "has":
                return plain(F.col("environment_id"), "has", None, negate)
            inside = F.col("environment_id").isin(*ids) if ids else F.lit(False)
            return _not_null(inside, negate != (t.op == "ne"))
        if f.store == "json":
            if f.extra.get("array"):
                return stack_test(F.col(f.column), t.path, t.op, t.value, negate)
            return json_test(F.col(f.column), t.path, t.op, t.value, negate)
        if f.kind == "time":
            return plain(F.col(f.column), t.op, None if t.op == "has" else instant(t.value, self.ctx.now), negate)
        if f.column == "duration_ms" and self.resource is Resource.SESSIONS:
            seconds = (F.unix_micros("last_event_at") - F.unix_micros("started_at")) / 1e6
            return plain(seconds, t.op, None if t.value is None else t.value / 1000, negate)
        if f.column == "duration_ms" and t.op == "has":
            return F.lit(not negate)
        return plain(F.col(f.column), t.op, t.value, negate)

    def _any(self, columns, types, pattern: str) -> Column:
        found = [F.coalesce(as_text(types[c], c).ilike(pattern), F.lit(False)) for c in columns if c in types]
        return functools.reduce(Column.__or__, found, F.lit(False))

    def text(self, text: str, negate: bool) -> Column:
        pattern = f"%{like_escape(text)}%"
        if self.resource is Resource.ISSUES:
            own = self._any(("title", "type", "culprit"), self.types, pattern)
            if not self.ctx.body:
                return ~own if negate else own
            payload = self.probe(self._any(("contexts", "extra", "tags"), self.occ, pattern), False)
            return ~(own | payload) if negate else own | payload
        head, body = TEXT_COLUMNS[self.resource]
        found = self._any((*head, *body) if self.ctx.body else head, self.types, pattern)
        return ~found if negate else found


def apply(df: DataFrame, node: Resolved, resource: Resource, ctx: Context, occurrences: DataFrame | None = None, scope: Scope = Scope(), since: dt.datetime | None = None, issue: str = "id") -> DataFrame:
    """Rows of ``df`` that pass. On issues, ``occurrences`` answer the probes, within ``scope`` and from ``since``."""
    low = Lowerer(resource, ctx, dict(df.dtypes), dict(occurrences.dtypes) if occurrences is not None else None).run(node)
    if not low.probes:
        return df.filter(low.condition)
    if occurrences is None:
        raise QueryError("not_searchable", "no occurrences to ask")
    rows = scope.apply(occurrences).filter(F.col("issue_id").isNotNull())
    recent = F.lit(True) if since is None else F.col("occurred_at") >= F.lit(since)
    tests = {n: c if n in low.unbounded else c & recent for n, c in low.probes.items()}
    # an occurrence that passes no probe says nothing: left out at the scan, before anything is shuffled
    rows = rows.filter(functools.reduce(Column.__or__, tests.values()))
    flags = rows.groupBy(F.col("issue_id").alias("_issue"), F.col("app_id").alias("_app")).agg(*[F.bool_or(c).alias(n) for n, c in tests.items()])
    joined = df.join(flags, (df[issue] == flags["_issue"]) & (df["app_id"] == flags["_app"]), "left")
    return joined.filter(low.condition).select(*[df[c] for c in df.columns])
