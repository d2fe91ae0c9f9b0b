"""The search language: text to syntax tree to typed predicates. Pure Python; ``lumenq.plans.lower`` makes columns."""

from lumenq.query.catalog import Resource
from lumenq.query.errors import QueryError
from lumenq.query.legacy import from_legacy
from lumenq.query.parser import parse
from lumenq.query.render import render
from lumenq.query.resolve import resolve

__all__ = ["QueryError", "Resource", "from_legacy", "parse", "render", "resolve"]
