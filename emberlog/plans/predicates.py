"""Predicates in negation normal form.

Logic is two-valued: a test of a missing or wrongly typed value is false, and its negation true.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Const:
    value: bool


@dataclass(frozen=True)
class Leaf:
    """A test on a field, or on a meta-field when ``subject`` begins with a dollar sign.

    Tests: defined, text_eq, text_any, contains, starts_with, ends_with, regex, bytes_eq, int_eq,
    int_any, bit_test (mask, value), number (low, low closed, high, high closed), duration (the same,
    in seconds), time (ns, ns), is_true, is_null, kinds, finite, level (set of 0..3), span_set.
    """

    subject: str
    test: str
    arg: Any = None
    negated: bool = False


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


Predicate = Const | Leaf | And | Or
TRUE, FALSE = Const(True), Const(False)


def both(*items: Predicate) -> Predicate:
    flat: list[Predicate] = []
    for p in items:
        if p == FALSE:
            return FALSE
        if isinstance(p, And):
            flat += p.items
        elif p != TRUE:
            flat.append(p)
    flat = list(dict.fromkeys(flat))
    return TRUE if not flat else flat[0] if len(flat) == 1 else And(tuple(flat))


def either(*items: Predicate) -> Predicate:
    flat: list[Predicate] = []
    for p in items:
        if p == TRUE:
            return TRUE
        if isinstance(p, Or):
            flat += p.items
        elif p != FALSE:
            flat.append(p)
    flat = list(dict.fromkeys(flat))
    return FALSE if not flat else flat[0] if len(flat) == 1 else Or(tuple(flat))


def invert(p: Predicate) -> Predicate:
    """The complement, with negation at the leaves."""
    if isinstance(p, Const):
        return Const(not p.value)
    if isinstance(p, Leaf):
        return Leaf(p.subject, p.test, p.arg, not p.negated)
    if isinstance(p, And):
        return either(*map(invert, p.items))
    return both(*map(invert, p.items))


def subjects(p: Predicate) -> set[str]:
    if isinstance(p, Leaf):
        return {p.subject}
    return set().union(*map(subjects, p.items)) if isinstance(p, (And, Or)) else set()


def span_set(ids) -> Leaf:
    """Rows whose span is one of ``ids``; the programmatic counterpart of an ``in`` list of spans."""
    return Leaf("$span", "span_set", tuple(sorted(ids)))
