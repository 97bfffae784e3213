"""Predicates to Spark columns, over a map of tagged values or over plain typed columns.

Positive tests are emitted bare, so that they reach the scan; only negated ones are wrapped, as
``NOT coalesce(test, false)``, which makes the logic two-valued.
"""

from __future__ import annotations

import math
import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.model import KIND, signed
from emberlog.plans.lexer import I64_MAX
from emberlog.plans.predicates import And, Const, Leaf, Or, Predicate

MAX = 1.7976931348623157e308
META_COLUMNS = {
    "$level": "level", "$target": "target", "$message": "message", "$service": "service", "$timestamp": "ts_ns",
    "$span": "span_id", "$parent_span": "parent_span", "$span_duration": "span_duration_ns",
}


def as_uuid(text: str) -> str | None:
    try:
        return str(uuid.UUID(text)) if len(text) in (32, 36, 38, 45) else None
    except ValueError:
        return None


def compile_predicate(p: Predicate, binding: Binding) -> Column:
    if isinstance(p, Const):
        return F.lit(p.value)
    if isinstance(p, Leaf):
        test = binding.leaf(p)
        if not p.negated:
            return F.lit(False) if test is None else test
        return F.lit(True) if test is None else ~F.coalesce(test, F.lit(False))
    parts = [compile_predicate(x, binding) for x in p.items]
    out = parts[0]
    for x in parts[1:]:
        out = out & x if isinstance(p, And) else out | x
    return out


def integers(v: Column, arg: tuple) -> Column | None:
    """Bounds on an integer column as integer bounds, whatever the literals are; None is never."""
    low, low_closed, high, high_closed = arg
    if any(isinstance(x, float) and not math.isfinite(x) for x in (low, high) if x is not None):
        return None
    if low is not None:
        low = math.ceil(low) if low_closed or low != math.floor(low) else math.floor(low) + 1
    if high is not None:
        high = math.floor(high) if high_closed or high != math.floor(high) else math.floor(high) - 1
    if (low is not None and low >= 2**64) or (high is not None and high < -(2**63)):
        return None
    low = None if low is not None and low < -(2**63) else low
    high = None if high is not None and high >= 2**64 else high
    if low is None and high is None:
        return v.isNotNull()
    if low is not None and high is not None and low >= high:
        return (v == F.lit(_exact(low))) if low == high else None
    tests = [v >= F.lit(_exact(low))] if low is not None else []
    tests += [v <= F.lit(_exact(high))] if high is not None else []
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def _exact(x: int):
    from decimal import Decimal

    return x if -(2**63) <= x <= I64_MAX else Decimal(x)


def reals(v: Column, arg: tuple) -> Column:
    """Bounds on a float column; the open end is the largest finite number, which keeps out inf and NaN."""
    low, low_closed, high, high_closed = arg
    low = -MAX if low is None else float(low)
    high = MAX if high is None else float(high)
    lower = v >= F.lit(low) if low_closed else v > F.lit(low)
    upper = v <= F.lit(high) if high_closed else v < F.lit(high)
    return lower & upper & (F.lit(True) if math.isfinite(high) and math.isfinite(low) else v.between(-MAX, MAX))


def text_test(v: Column, test: str, arg) -> Column | None:
    if test == "text_eq":
        return v == F.lit(arg)
    if test == "text_any":
        return v.isin(*arg)
    if test == "contains":
        return v.contains(F.lit(arg))
    if test == "starts_with":
        return v.startswith(F.lit(arg))
    if test == "ends_with":
        return v.endswith(F.lit(arg))
    if test == "regex":
        return v.rlike(arg)
    return None


class Binding:
    """Gives the columns of meta-fields; fields come from the two kinds of binding."""

    def __init__(self, metas: dict[str, Column | None]) -> None:
        self.metas = metas

    def leaf(self, p: Leaf) -> Column | None:
        """The test as a column, NULL or false where it fails; None when it can never hold."""
        return self.meta(p) if p.subject[0] == "$" else self.field(p.subject, p.test, p.arg)

    def meta(self, p: Leaf) -> Column | None:
        v = self.metas.get(p.subject)
        if v is None:
            return None
        if p.test == "defined":
            return v.isNotNull()
        if p.test == "level":
            return v == p.arg[0] if len(p.arg) == 1 else v.isin(*p.arg)
        if p.test == "int_eq":
            return v == F.lit(signed(p.arg)) if -(2**63) <= p.arg < 2**64 else None
        if p.test == "span_set":
            return v.isin(*map(signed, p.arg)) if p.arg else None
        if p.test == "time":
            low, high = max(p.arg[0], -(2**63)), min(p.arg[1], I64_MAX)
            return (v == F.lit(low)) if low == high else v.between(F.lit(low), F.lit(high))
        if p.test == "number":
            return integers(v, p.arg)
        return text_test(v, p.test, p.arg)

    def field(self, name: str, test: str, arg) -> Column | None:
        raise NotImplementedError


def meta_columns(df: DataFrame, given: dict[str, Column] | None = None) -> dict[str, Column | None]:
    given = given or {}
    out: dict[str, Column | None] = {}
    for meta, name in META_COLUMNS.items():
        out[meta] = given.get(meta, F.col(name) if name in df.columns else None)
    return out


class DynamicBinding(Binding):
    """Fields in a map from key to a value tagged with its kind."""

    def __init__(self, df: DataFrame, fields: str = "fields", metas: dict[str, Column] | None = None) -> None:
        super().__init__(meta_columns(df, metas))
        self.fields = F.col(fields)

    def field(self, name: str, test: str, arg) -> Column | None:
        if test == "defined":
            return F.map_contains_key(self.fields, name)
        v = self.fields[name]
        kind, s, i, f = v["kind"], v["s"], v["i"], v["f"]

        def of(k: str, t: Column | None) -> Column | None:
            return None if t is None else (kind == KIND[k]) & t

        if test in ("text_eq", "text_any"):
            found = [u for u in map(as_uuid, (arg,) if test == "text_eq" else arg) if u]
            text = of("string", text_test(s, test, arg))
            return text | of("uuid", s.isin(*found)) if found else text
        if test in ("contains", "starts_with", "ends_with", "regex"):
            return of("string", text_test(s, test, arg))
        if test == "bytes_eq":
            return of("bytes", v["b"] == F.lit(arg)) | of("string", s.cast("binary") == F.lit(arg))
        if test == "int_eq":
            return of("int", i == F.lit(arg).cast("decimal(20,0)") if abs(arg) <= I64_MAX else i == F.lit(_exact(arg)))
        if test == "int_any":
            return of("int", i.isin(*[F.lit(_exact(x)).cast("decimal(20,0)") for x in arg]))
        if test == "bit_test":
            return of("int", i.cast("long").bitwiseAND(arg[0]) == arg[1])
        if test == "number":
            whole, real = integers(i, arg), of("float", reals(f, arg))
            return real if whole is None else of("int", whole) | real
        if test == "duration":
            return of("duration", reals(f, arg))
        if test == "time":
            return of("timestamp", i.between(arg[0] // 10**6, arg[1] // 10**6))
        if test == "is_true":
            return of("bool", i == 1)
        if test == "is_null":
            return kind == KIND["null"]
        if test == "kinds":
            return kind == KIND[arg[0]] if len(arg) == 1 else kind.isin(*[KIND[k] for k in arg])
        if test == "finite":
            return of("float", f.between(-MAX, MAX))
        raise ValueError(test)


def kind_of(data_type: T.DataType) -> str | None:
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(data_type, T.BinaryType):
        return "bytes"
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(data_type, T.DecimalType):
        return "int" if data_type.scale == 0 else "float"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    return None


class TypedBinding(Binding):
    """Any DataFrame: a column is a field, NULL is missing, and the kind follows from the type.

    ``kinds`` overrides it, for instance a double of seconds as ``duration`` or a string as ``uuid``.
    Tests that the kind rules out fold to constants before a plan exists.
    """

    def __init__(self, df: DataFrame, kinds: dict[str, str] | None = None, metas: dict[str, Column] | None = None) -> None:
        super().__init__(meta_columns(df, metas))
        self.types = {f.name: f.dataType for f in df.schema}
        self.kinds = {n: kind_of(t) for n, t in self.types.items()} | (kinds or {})

    def field(self, name: str, test: str, arg) -> Column | None:
        kind = self.kinds.get(name)
        if kind is None:
            return None
        v = F.col(f"`{name}`")
        if test == "defined":
            return v.isNotNull()
        if test == "kinds":
            return v.isNotNull() if kind in arg else None
        if test in ("text_eq", "text_any") and kind == "uuid":
            found = [u for u in map(as_uuid, (arg,) if test == "text_eq" else arg) if u]
            return F.lower(v).isin(*found) if found else None
        if test in ("text_eq", "text_any", "contains", "starts_with", "ends_with", "regex"):
            return text_test(v, test, arg) if kind == "string" else None
        if test == "bytes_eq":
            return None if kind not in ("string", "bytes") else v.cast("binary") == F.lit(arg)
        if test in ("int_eq", "int_any"):
            if kind != "int":
                return None
            fits = [x for x in ((arg,) if test == "int_eq" else arg) if -(2**63) <= x <= I64_MAX or isinstance(self.types[name], T.DecimalType)]
            return None if not fits else v == F.lit(_exact(fits[0])) if len(fits) == 1 else v.isin(*map(_exact, fits))
        if test == "bit_test":
            return v.bitwiseAND(F.lit(arg[0])) == arg[1] if kind == "int" else None
        if test == "number":
            return integers(v, arg) if kind == "int" else reals(v, arg) if kind == "float" else None
        if test == "duration":
            return reals(v, arg) if kind == "duration" else None
        if test == "time":
            return self.time(v, self.types[name], arg) if kind == "timestamp" else None
        if test == "is_true":
            return v == F.lit(True) if kind == "bool" else None
        if test == "is_null":
            return None
        if test == "finite":
            return v.between(-MAX, MAX) if kind == "float" else None
        raise ValueError(test)

    def time(self, v: Column, data_type: T.DataType, arg: tuple[int, int]) -> Column | None:
        """Bounds as literals of the column's own type, so that they reach the scan."""
        low, high = -(-arg[0] // 1000), arg[1] // 1000
        if low > high:
            return None
        if isinstance(data_type, T.DateType):
            day = 86400 * 10**6
            low, high = -(-low // day), high // day
            texts = [(datetime(1970, 1, 1) + timedelta(days=x)).strftime("%Y-%m-%d") for x in (low, high)]
            return v.between(*(F.expr(f"date'{x}'") for x in texts)) if low <= high else None
        name = "timestamp_ntz" if isinstance(data_type, T.TimestampNTZType) else "timestamp"
        zone = "" if name == "timestamp_ntz" else "+00:00"
        texts = [(datetime(1970, 1, 1) + timedelta(microseconds=x)).isoformat(sep=" ", timespec="microseconds") for x in (low, high)]
        return v.between(*(F.expr(f"{name}'{x}{zone}'") for x in texts))
