"""Operators on the forest of spans.

A span's parent is the one its earliest Start record names.  Its duration is from the first record to
the last, over all rows given.  Anything per span is one partial aggregation and one shuffle on the
span; rows meet it again in a join that AQE may split where a span is hot.  Rows outside spans take no
part in that join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.model import END, START, START_WITH_PARENT
from emberlog.shared import materialise

ORDER = ("generation", "seq")
#: Levels an ancestor chain may have.
MAX_ANCESTORS = 8


def _place(df: DataFrame) -> F.Column:
    return F.struct(*[F.col(c) for c in ORDER if c in df.columns])


def span_table(logs: DataFrame) -> DataFrame:
    """Per span: span_id, parent_span, start_ts_ns, last_ts_ns, span_duration_ns, first and last place, rows, ended.

    Parents that no record belongs to appear as spans without records.
    """
    place = _place(logs)
    starts = F.col("span_kind").isin(START_WITH_PARENT, START)
    own = (
        logs.where(F.col("span_id").isNotNull())
        .groupBy("span_id")
        .agg(
            F.min_by(F.when(starts, F.col("parent_span_id")), F.when(starts, place)).alias("parent_span"),
            F.min_by("ts_ns", place).alias("start_ts_ns"),
            F.max_by("ts_ns", place).alias("last_ts_ns"),
            F.min(place).alias("first_place"),
            F.max(place).alias("last_place"),
            F.count("*").alias("n_rows"),
            F.coalesce(F.bool_or(F.col("span_kind") == END), F.lit(False)).alias("ended"),
        )
    )
    own = own.withColumn("span_duration_ns", F.abs(F.col("last_ts_ns") - F.col("start_ts_ns")))
    stubs = own.where(F.col("parent_span").isNotNull()).select(F.col("parent_span").alias("span_id")).distinct()
    stubs = stubs.join(own.select("span_id"), "span_id", "left_anti")
    return own.unionByName(stubs.withColumn("n_rows", F.lit(0).cast("long")), allowMissingColumns=True)


def _beside(logs: DataFrame, per_span: DataFrame, added: list[str]) -> DataFrame:
    """Columns ``added`` of the row's span; rows outside spans get nulls and are not shuffled."""
    found = logs.where(F.col("span_id").isNotNull()).join(per_span, "span_id", "left").select(*logs.columns, *added)
    kinds = dict(per_span.dtypes)
    outside = logs.where(F.col("span_id").isNull()).select(*logs.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in added])
    return found.unionByName(outside)


def with_span_columns(logs: DataFrame) -> DataFrame:
    """Adds parent_span and span_duration_ns to every row in a span."""
    added = ["parent_span", "span_duration_ns"]
    return _beside(logs.drop(*added), span_table(logs).select("span_id", *added), added)


def span_logs(logs: DataFrame, span_id: int) -> DataFrame:
    """All rows of one span."""
    return logs.where(F.col("span_id") == span_id)


def expand_spans(logs: DataFrame, matches: DataFrame) -> DataFrame:
    """All rows of the spans of ``matches``, each span once; matches outside spans drop out."""
    spans = matches.where(F.col("span_id").isNotNull()).select("span_id").distinct()
    return logs.join(spans, "span_id", "left_semi").select(*logs.columns)


def grouped_by_spans(logs: DataFrame, query) -> DataFrame:
    """Rows of matching spans with ``span_place``, the place of the span's newest match.

    Sorted by newest match first and newest row first within a span.
    """
    from emberlog.operators.filters import where

    matches = where(logs, query).where(F.col("span_id").isNotNull())
    newest = matches.groupBy("span_id").agg(F.max(_place(logs)).alias("span_place"))
    out = logs.join(newest, "span_id").select(*logs.columns, "span_place")
    return out.orderBy(F.col("span_place").desc(), "span_id", *[F.col(c).desc() for c in ORDER if c in logs.columns])


def with_first_record(logs: DataFrame, columns: Iterable[str] = ("ts_ns", "message")) -> DataFrame:
    """Adds ``first_*``: columns of the first record of the row's span."""
    columns = list(columns)
    first = logs.where(F.col("span_id").isNotNull()).groupBy("span_id").agg(F.min_by(F.struct(*columns), _place(logs)).alias("__f"))
    named = first.select("span_id", *[F.col("__f")[c].alias(f"first_{c}") for c in columns])
    return _beside(logs, named, [f"first_{c}" for c in columns])


def ancestors(spans: DataFrame, max_depth: int = MAX_ANCESTORS) -> DataFrame:
    """(span_id, depth, ancestor) for all spans up to ``max_depth`` levels; depth 1 is the parent.

    Each level is the one before joined once more to the edges.  Levels are written as they come, so none
    is computed twice, and they end when no span has a further ancestor.
    """
    edges = materialise(spans.where(F.col("parent_span").isNotNull()).select(F.col("span_id").alias("child"), "parent_span"))
    level = edges.select(F.col("child").alias("span_id"), F.lit(1).alias("depth"), F.col("parent_span").alias("ancestor"))
    out = level
    for depth in range(2, max_depth + 1):
        level = level.join(edges, F.col("ancestor") == F.col("child")).select(
            "span_id", F.lit(depth).alias("depth"), F.col("parent_span").alias("ancestor")
        )
        level = materialise(level)
        if level.isEmpty():
            break
        out = out.unionAll(level)
    return out


def ancestor_chain(spans: DataFrame, span_id: int, max_depth: int = MAX_ANCESTORS) -> list[int]:
    """Ancestors of one span, the root first, without itself; a cycle ends where it closes."""
    chain, seen, now = [], {span_id}, span_id
    for _ in range(max_depth):
        row = spans.where(F.col("span_id") == now).select("parent_span").first()
        if row is None or row[0] is None or row[0] in seen:
            break
        now = row[0]
        seen.add(now)
        chain.append(now)
    return chain[::-1]


def components(spans: DataFrame) -> DataFrame:
    """(span_id, root) for all spans, by pointer doubling: the rounds are the logarithm of the depth.

    A parent that is not among the spans is the root of those below it.  Spans on or below a cycle are
    labelled by the smallest span met on the way.
    """
    step = spans.select("span_id", F.coalesce("parent_span", "span_id").alias("up"), F.coalesce("parent_span", "span_id").alias("least"))
    step = materialise(step.withColumn("least", F.least("least", "span_id")))
    # after as many doublings as the number of spans has bits, only cycles still move
    for _ in range(step.count().bit_length() + 1):
        above = step.select(F.col("span_id").alias("__s"), F.col("up").alias("__u"), F.col("least").alias("__l"))
        after = step.join(above, F.col("up") == F.col("__s"), "left").select(
            "span_id", F.coalesce("__u", "up").alias("next"), F.least("least", F.coalesce("__l", "least")).alias("least"), "up"
        )
        after = materialise(after)
        moved = after.where(F.col("next") != F.col("up")).limit(1).count()
        step = after.select("span_id", F.col("next").alias("up"), "least")
        if not moved:
            break
    unknown = step.select("up").distinct().join(step.select(F.col("span_id").alias("up")), "up", "left_anti")
    roots = step.where(F.col("span_id") == F.col("up")).select("up").union(unknown).distinct().withColumnRenamed("up", "__r")
    done = step.join(roots, F.col("up") == F.col("__r"), "left")
    return done.select("span_id", F.when(F.col("__r").isNotNull(), F.col("up")).otherwise(F.col("least")).alias("root"))


def component(spans: DataFrame, seed: int) -> DataFrame | None:
    """(span_id) of the spans joined to ``seed`` by parent or child edges; None if it is unknown.

    The edges are computed once.  The search climbs to the root by single rows and goes down from there
    level by level; in a forest no span is met twice, and a cycle ends where it closes.
    """
    edges = materialise(spans.select("span_id", "parent_span"))
    root, met = seed, set()
    while True:
        met.add(root)
        row = edges.where(F.col("span_id") == root).select("parent_span").first()
        if row is None and root == seed:
            return None
        if row is None or row[0] is None or row[0] in met:
            break
        root = row[0]
    seen = edges.where(F.col("span_id") == root).select("span_id").distinct()
    if seen.isEmpty():  # a parent without a row of its own still joins its children
        seen = edges.sparkSession.createDataFrame([(root,)], "span_id long")
    seen = frontier = materialise(seen)
    while True:
        below = edges.join(frontier.select(F.col("span_id").alias("parent_span")), "parent_span", "left_semi").select("span_id").distinct()
        frontier = materialise(below.join(seen, "span_id", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def extend_component(component_: DataFrame, new_spans: DataFrame) -> DataFrame:
    """The component with those of the new spans that hang below it, however deep.

    New spans are fewer than old ones: the roots of their trees are found among themselves, and a tree
    whose root is a span of the component joins it.
    """
    inside = components(new_spans).join(component_.select(F.col("span_id").alias("root")), "root", "left_semi").select("span_id")
    return component_.select("span_id").union(inside).distinct()


def context(logs: DataFrame, spans: DataFrame, seed: int) -> DataFrame:
    """All rows of the component of a span."""
    found = component(spans, seed)
    if found is None:
        return logs.where(F.lit(False))
    return logs.join(found, "span_id", "left_semi").select(*logs.columns)
