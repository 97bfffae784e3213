"""Errors of the predicate language."""

from __future__ import annotations


class QueryParseError(ValueError):
    """What is wrong with a query text, and where: ``start`` and ``end`` are character offsets."""

    def __init__(self, kind: str, start: int, end: int, detail: str = "") -> None:
        self.kind, self.start, self.end = kind, start, end
        super().__init__(f"{kind} at {start}..{end}" + (f": {detail}" if detail else ""))
