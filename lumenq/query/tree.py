"""Syntax tree of a search, with its JSON form."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from lumenq.query.errors import QueryError

MAX_DEPTH = 8
MAX_TERMS = 64


@dataclass(frozen=True)
class Pred:
    field: str
    value: str
    quoted: bool = False
    at: int = 0


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Not:
    of: "Node"


@dataclass(frozen=True)
class And:
    of: tuple["Node", ...] = ()


@dataclass(frozen=True)
class Or:
    of: tuple["Node", ...] = ()


Node = Pred | Text | Not | And | Or


def depth(node: Node) -> int:
    """Nesting by negation and by groups below the top."""
    match node:
        case Not(of):
            return 1 + depth(of)
        case And(of) | Or(of):
            return max((depth(x) + isinstance(x, (And, Or)) for x in of), default=0)
    return 0


def terms(node: Node) -> int:
    match node:
        case Not(of):
            return terms(of)
        case And(of) | Or(of):
            return sum(map(terms, of))
    return 1


def to_json(node: Node) -> Any:
    match node:
        case Pred(field, value, quoted, at):
            return {"Pred": {"field": field, "value": value, "quoted": quoted, "at": at}}
        case Text(text):
            return {"Text": text}
        case Not(of):
            return {"Not": to_json(of)}
    return {type(node).__name__: [to_json(x) for x in node.of]}


def from_json(data: Any) -> Node:
    """The tree of its JSON form, within the same bounds as a text."""

    def build(x: Any) -> Node:
        if not isinstance(x, dict) or len(x) != 1:
            raise QueryError("malformed", "a node is an object with one key")
        ((kind, v),) = x.items()
        if kind == "Pred" and isinstance(v, dict) and isinstance(v.get("field"), str) and isinstance(v.get("value"), str):
            return Pred(v["field"], v["value"], bool(v.get("quoted", False)), int(v.get("at", 0)))
        if kind == "Text" and isinstance(v, str):
            return Text(v)
        if kind == "Not":
            return Not(build(v))
        if kind in ("And", "Or") and isinstance(v, list):
            return (And if kind == "And" else Or)(tuple(map(build, v)))
        raise QueryError("malformed", kind)

    node = build(data)
    if depth(node) > MAX_DEPTH:
        raise QueryError("too_deep", str(MAX_DEPTH))
    if terms(node) > MAX_TERMS:
        raise QueryError("too_many_terms", str(MAX_TERMS))
    return node
