"""Errors of the search language; ``code`` says which, ``at`` where."""

from __future__ import annotations


class QueryError(ValueError):
    def __init__(self, code: str, detail: str = "", at: int | None = None):
        super().__init__(f"{code}: {detail}" + (f" (at {at})" if at is not None else ""))
        self.code, self.detail, self.at = code, detail, at
