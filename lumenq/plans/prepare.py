"""What must be known before a search is lowered: its environments, its cost, and the window its cost allows."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lumenq.plans.lower import Context
from lumenq.query.catalog import Cost, Resource
from lumenq.query.errors import QueryError
from lumenq.query.resolve import Resolved, cost as cost_of
from lumenq.query.tree import And, Not, Or, Text
from lumenq.scope import Scope

SCAN_DAYS = 30
REASON = "a search that reads every row is bounded in time"


@dataclass(frozen=True)
class Clamp:
    days: int
    reason: str


@dataclass(frozen=True)
class Prepared:
    node: Resolved
    context: Context
    cost: Cost
    clamp: Clamp | None


def tests(node: Resolved):
    match node:
        case Not(of):
            yield from tests(of)
        case And(of) | Or(of):
            for x in of:
                yield from tests(x)
        case Text():
            return
        case _:
            yield node


def prepare(node: Resolved, resource: Resource, now: dt.datetime, environments: DataFrame | None = None, scope: Scope = Scope(), body: bool = True, scan_days: int = SCAN_DAYS) -> Prepared:
    """Reject what can't be searched, look up the environments a search names, and clamp costly searches."""
    names: set[str] = set()
    for t in tests(node):
        if t.field.store == "rollup":
            raise QueryError("not_searchable", f"{t.field.name} on {resource.name.lower()}", t.at)
        if t.field.column == "environment_id" and t.value is not None:
            names |= set(t.value if isinstance(t.value, tuple) else (t.value,))
    ids: dict[str, tuple[str, ...]] = {}
    if names and environments is not None:
        rows = environments.filter(F.col("env_name").isin(*sorted(names)))
        if scope.app_id is not None:
            rows = rows.filter(F.col("app_id") == scope.app_id)
        for r in rows.select("env_name", "id").collect():  # one row per app and named environment
            ids[r[0]] = (*ids.get(r[0], ()), r[1])
    cost = cost_of(node)
    clamp = Clamp(scan_days, REASON) if cost is Cost.SCAN else None
    return Prepared(node, Context(now, ids, body), cost, clamp)
