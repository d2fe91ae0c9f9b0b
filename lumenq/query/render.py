"""The canonical text of a tree: implicit AND, parentheses only where an OR stands in an AND or under a negation."""

from __future__ import annotations

import re

from lumenq.query.lexer import is_ident
from lumenq.query.tree import And, Node, Not, Or, Pred, Text


def _quote(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def render(node: Node) -> str:
    match node:
        case Pred(field, value, quoted):
            plain = not quoted and value and not re.search(r'[\s()"\\]', value)
            return f"{field}:{value if plain else _quote(value)}"
        case Text(text):
            head = re.split("[:=]", text)[0]
            plain = text and not re.search(r'[\s()"\\]', text) and text[0] != "!" and text.lower() not in ("and", "or") and not (head != text and is_ident(head))
            return text if plain else _quote(text)
        case Not(of):
            inner = render(of)
            return f"!({inner})" if isinstance(of, (And, Or)) and len(of.of) != 1 else f"!{inner}"
        case And(of):
            return " ".join(f"({render(x)})" if isinstance(x, (Or, And)) and len(x.of) > 1 else render(x) for x in of)
        case Or(of):
            return " OR ".join(f"({render(x)})" if isinstance(x, Or) and len(x.of) > 1 else render(x) for x in of)
    raise TypeError(node)
