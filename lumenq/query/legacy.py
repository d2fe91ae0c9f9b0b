"""Older filter spellings: ``field:op:value`` lists, as trees and as whitelisted filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from urllib.parse import unquote

from lumenq.query.errors import QueryError
from lumenq.query.lexer import is_ident
from lumenq.query.tree import MAX_TERMS, And, Node, Not, Pred, Text

SIGNS = {"contains": "~", "gt": ">", "lt": "<"}


def split3(item: str, at: int) -> tuple[str, str, str]:
    """(field, op, decoded value)."""
    parts = item.split(":", 2)
    if len(parts) < 3:
        raise QueryError("bad_value", item, at)
    return parts[0], parts[1], unquote(parts[2], errors="replace")


def from_legacy(filters: Iterable[str], q: str | None = None) -> Node:
    """The conjunction of the filters and of the free text ``q``; ``eq`` and ``neq`` values are literal."""
    filters = list(filters)
    if len(filters) > MAX_TERMS:
        raise QueryError("too_many_terms", str(MAX_TERMS))
    out: list[Node] = [_one(x, i) for i, x in enumerate(filters)]
    if q and q.strip():
        out.append(Text(q.strip()))
    return out[0] if len(out) == 1 else And(tuple(out))


def _one(item: str, at: int) -> Node:
    field, op, value = split3(item, at)
    prefix = ""
    if field == "tag":
        key, _, value_ = value.partition("=")
        if not key or not value_ or not is_ident(key) and any(map(str.isspace, key)):
            raise QueryError("bad_value", f"tag: {value}", at)
        field, value, prefix = (f"tag.{key}", value_, "") if is_ident(key) else ("tag", value_, f"{key}=")
    if not is_ident(field):
        raise QueryError("unknown_field", field, at)
    if op in ("eq", "neq"):
        p = Pred(field, prefix + value, True, at)
        return Not(p) if op == "neq" else p
    if op not in SIGNS:
        raise QueryError("bad_op", op, at)
    return Pred(field, prefix + SIGNS[op] + value, False, at)


@dataclass(frozen=True)
class Allowed:
    """kind: str, enum, num or tag."""

    kind: str
    ops: frozenset[str]
    options: tuple[str, ...] = ()


def whitelisted(filters: Iterable[str], allow: Mapping[str, Allowed]) -> list[tuple[str, str, str]]:
    """(field, op, value) of each filter, if the field, its operator and its value are allowed."""
    out = []
    for i, item in enumerate(filters):
        field, op, value = split3(item, i)
        spec = allow.get(field)
        if spec is None:
            raise QueryError("unknown_field", field, i)
        if op not in spec.ops:
            raise QueryError("bad_op", f"{op} on {field}", i)
        key, eq, rest = value.partition("=")
        good = {"num": value.lstrip("+-").isdigit(), "enum": value in spec.options, "tag": bool(key and eq and rest)}.get(spec.kind, True)
        if not good:
            raise QueryError("bad_value", f"{field}: {value}", i)
        out.append((field, op, value))
    return out
