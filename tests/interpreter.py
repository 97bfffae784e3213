"""A row interpreter of predicates: what the columns must agree with."""

from __future__ import annotations

import math
import re
import uuid

from emberlog.functions.model import Duration, Stamp
from emberlog.plans.predicates import And, Const, Leaf, Or


def holds(p, row: dict) -> bool:
    """``row``: fields by name and meta-fields by name with a dollar sign; a missing key is missing."""
    if isinstance(p, Const):
        return p.value
    if isinstance(p, And):
        return all(holds(x, row) for x in p.items)
    if isinstance(p, Or):
        return any(holds(x, row) for x in p.items)
    assert isinstance(p, Leaf)
    found = p.subject in row and test(p.test, p.arg, row[p.subject])
    return found != p.negated


def kind(v) -> str:
    for k, t in (("null", type(None)), ("bool", bool), ("int", int), ("float", float), ("string", str), ("bytes", bytes), ("uuid", uuid.UUID), ("duration", Duration), ("timestamp", Stamp)):
        if isinstance(v, t):
            return k
    raise TypeError(v)


def within(x, arg) -> bool:
    low, low_closed, high, high_closed = arg
    if isinstance(x, float) and not math.isfinite(x):
        return False
    return (low is None or x > low or low_closed and x == low) and (high is None or x < high or high_closed and x == high)


def test(name: str, arg, v) -> bool:
    k = kind(v)
    if name == "defined":
        return True
    if name in ("text_eq", "text_any"):
        wanted = (arg,) if name == "text_eq" else arg
        return k == "string" and v in wanted or k == "uuid" and any(w.lower() == str(v) for w in wanted)
    if name in ("contains", "starts_with", "ends_with", "regex"):
        return k == "string" and bool({"contains": lambda: arg in v, "starts_with": lambda: v.startswith(arg), "ends_with": lambda: v.endswith(arg), "regex": lambda: re.search(arg, v)}[name]())
    if name == "bytes_eq":
        return k == "bytes" and v == arg or k == "string" and v.encode() == arg
    if name == "int_eq":
        return k == "int" and v == arg
    if name == "int_any":
        return k == "int" and v in arg
    if name == "number":
        return k in ("int", "float") and within(v, arg)
    if name == "duration":
        return k == "duration" and within(v.seconds, arg)
    if name == "time":
        return k == "timestamp" and arg[0] // 10**6 <= v.millis <= arg[1] // 10**6
    if name == "is_true":
        return v is True
    if name == "is_null":
        return v is None
    if name == "kinds":
        return k in arg
    if name == "finite":
        return k == "float" and math.isfinite(v)
    if name == "level":
        return v in arg
    raise ValueError(name)
