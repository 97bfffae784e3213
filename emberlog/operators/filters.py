"""Programmatic filters and the query builder; all parts of a query are ANDed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.binding import Binding, DynamicBinding, TypedBinding, compile_predicate
from emberlog.plans.lexer import I64_MAX
from emberlog.plans.parser import parse
from emberlog.plans.predicates import TRUE, Predicate, subjects

ALL_LEVELS = 0b1111


@dataclass(frozen=True)
class TimeFilter:
    """Nanoseconds, inclusive at both ends."""

    low: int = 0
    high: int = I64_MAX

    @property
    def trivial(self) -> bool:
        return self.low <= 0 and self.high >= I64_MAX

    def column(self, ts_ns: str = "ts_ns") -> Column:
        parts = ([F.col(ts_ns) >= self.low] if self.low > 0 else []) + ([F.col(ts_ns) <= self.high] if self.high < I64_MAX else [])
        return reduce(Column.__and__, parts) if parts else F.lit(True)


@dataclass(frozen=True)
class LevelFilter:
    """A set of levels as a mask: bit 0 debug, 1 info, 2 warn, 3 error."""

    mask: int = ALL_LEVELS

    @classmethod
    def all(cls) -> LevelFilter:
        return cls(ALL_LEVELS)

    @classmethod
    def empty(cls) -> LevelFilter:
        return cls(0)

    def with_level(self, level: int) -> LevelFilter:
        return LevelFilter(self.mask | 1 << level)

    def without_level(self, level: int) -> LevelFilter:
        return LevelFilter(self.mask & ~(1 << level))

    def contains(self, level: int) -> bool:
        return bool(self.mask >> level & 1)

    @property
    def trivial(self) -> bool:
        return self.mask & ALL_LEVELS == ALL_LEVELS

    def levels(self) -> list[int]:
        return [i for i in range(4) if self.contains(i)]

    def column(self, level: str = "level") -> Column:
        """An ``isin`` and not a shift, so that it reaches the scan."""
        if self.trivial:
            return F.lit(True)
        return F.col(level).isin(*self.levels()) if self.levels() else F.lit(False)


@dataclass(frozen=True)
class TargetFilter:
    targets: tuple[str, ...]

    def column(self, target: str = "target") -> Column:
        return F.col(target).isin(*self.targets) if self.targets else F.lit(False)


@dataclass(frozen=True)
class TargetLevelFilter:
    """A level mask for each target named, and one for the others; ``None`` lets no other pass."""

    masks: tuple[tuple[str, int], ...]
    default: int | None = ALL_LEVELS

    def column(self, target: str = "target", level: str = "level") -> Column:
        named = [t for t, _ in self.masks]
        by_mask: dict[int, list[str]] = {}
        for t, m in dict(self.masks).items():
            by_mask.setdefault(m, []).append(t)
        parts = [F.col(target).isin(*ts) & LevelFilter(m).column(level) for m, ts in by_mask.items() if m & ALL_LEVELS]
        if self.default:
            others = ~F.col(target).isin(*named) if named else F.lit(True)
            parts.append(others & LevelFilter(self.default).column(level))
        return reduce(Column.__or__, parts) if parts else F.lit(False)


def compact_levels(code: Sequence[int], targets: Sequence[str]) -> LevelFilter | TargetLevelFilter | None:
    """A compact filter: nothing, one mask, or ``[largest id, default mask, (id, mask)...]``.

    ``targets`` gives the target of each id; targets with ids beyond the largest never match.
    """
    if not code:
        return None
    if len(code) == 1:
        return LevelFilter(code[0])
    if len(code) % 2:
        raise ValueError("pairs of target and mask expected")
    largest, default, pairs = code[0], code[1], list(zip(code[2::2], code[3::2]))
    masks = {targets[i]: default for i in range(min(largest + 1, len(targets)))}
    masks |= {targets[i]: m for i, m in pairs if i <= largest and i < len(targets)}
    return TargetLevelFilter(tuple(masks.items()), None)


@dataclass(frozen=True)
class Query:
    """An immutable query: time, levels, targets and predicates."""

    time: TimeFilter = TimeFilter()
    levels: LevelFilter = LevelFilter()
    targets: TargetFilter | None = None
    target_levels: TargetLevelFilter | None = None
    predicates: tuple[Predicate, ...] = ()

    @staticmethod
    def expr(text: str, strict: bool = True) -> Query:
        return Query(predicates=(parse(text, strict),))

    @staticmethod
    def builder() -> QueryBuilder:
        return QueryBuilder()

    def column(self, binding: Binding) -> Column:
        parts = []
        if not self.time.trivial:
            parts.append(self.time.column())
        if not self.levels.trivial:
            parts.append(self.levels.column())
        parts += [f.column() for f in (self.targets, self.target_levels) if f is not None]
        parts += [compile_predicate(p, binding) for p in self.predicates if p != TRUE]
        return reduce(Column.__and__, parts) if parts else F.lit(True)

    def subjects(self) -> set[str]:
        return set().union(*map(subjects, self.predicates))


@dataclass(frozen=True)
class QueryBuilder:
    made: Query = field(default_factory=Query)

    def min_timestamp_ns(self, ns: int) -> QueryBuilder:
        return QueryBuilder(replace(self.made, time=replace(self.made.time, low=ns)))

    def max_timestamp_ns(self, ns: int) -> QueryBuilder:
        return QueryBuilder(replace(self.made, time=replace(self.made.time, high=ns)))

    def with_levels(self, levels: LevelFilter) -> QueryBuilder:
        return QueryBuilder(replace(self.made, levels=levels))

    def with_targets(self, targets: Iterable[str]) -> QueryBuilder:
        return QueryBuilder(replace(self.made, targets=TargetFilter(tuple(targets))))

    def with_target_levels(self, f: TargetLevelFilter) -> QueryBuilder:
        return QueryBuilder(replace(self.made, target_levels=f))

    def with_expr(self, text: str, strict: bool = True) -> QueryBuilder:
        return self.with_parsed_expr(parse(text, strict))

    def with_parsed_expr(self, p: Predicate) -> QueryBuilder:
        return QueryBuilder(replace(self.made, predicates=(*self.made.predicates, p)))

    def build(self) -> Query:
        return self.made


def as_query(q: Query | Predicate | str | None) -> Query:
    if q is None:
        return Query()
    if isinstance(q, str):
        return Query.expr(q)
    return q if isinstance(q, Query) else Query(predicates=(q,))


def bind(df: DataFrame) -> Binding:
    """The map of tagged values when there is one, the plain columns otherwise."""
    kinds = dict(df.dtypes)
    return DynamicBinding(df) if kinds.get("fields", "").startswith("map<") else TypedBinding(df)


def where(df: DataFrame, q: Query | Predicate | str | None, binding: Binding | None = None) -> DataFrame:
    """The rows that match.  Tests on parents and durations of spans bring those columns in first."""
    from emberlog.operators.spans import with_span_columns

    q = as_query(q)
    columns = df.columns
    need = q.subjects() & {"$parent_span", "$span_duration"}
    if need and binding is None and "span_id" in columns and not {"parent_span", "span_duration_ns"} <= set(columns):
        df = with_span_columns(df)
    out = df.where(q.column(binding or bind(df)))
    return out.select(*columns) if out.columns != columns else out
