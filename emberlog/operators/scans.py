"""Scans in arrival order: newest first, oldest first, both ways from an anchor, and saved rows.

A row's address is (generation, seq).  ``limit`` turns a sort into a top-n, which needs no full sort;
seeks are keyset conditions, so a page costs what it returns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from emberlog.operators.filters import where

#: Generations that stay readable.
RETAINED = 4


class Address(NamedTuple):
    generation: int
    seq: int


def _before(a: Address, inclusive: bool) -> Column:
    g, s = F.col("generation"), F.col("seq")
    return (g < a.generation) | ((g == a.generation) & (s <= a.seq if inclusive else s < a.seq))


def _after(a: Address, inclusive: bool = False) -> Column:
    g, s = F.col("generation"), F.col("seq")
    return (g > a.generation) | ((g == a.generation) & (s >= a.seq if inclusive else s > a.seq))


def _sorted(df: DataFrame, newest_first: bool, limit: int | None) -> DataFrame:
    keys = [F.col("generation"), F.col("seq")]
    out = df.orderBy(*[k.desc() if newest_first else k.asc() for k in keys])
    return out if limit is None else out.limit(limit)


def newest_generation(df: DataFrame) -> int | None:
    return df.agg(F.max("generation")).first()[0]


def retained(df: DataFrame, generations: int = RETAINED) -> DataFrame:
    """The newest generations; older ones are what a ring of that size has overwritten."""
    newest = newest_generation(df)
    return df if newest is None else df.where(F.col("generation") > newest - generations)


def rotate(df: DataFrame, capacity: int) -> DataFrame:
    """Generations of at most ``capacity`` rows by arrival; ``seq`` must count rows from 0."""
    return df.withColumn("generation", F.floor(F.col("seq") / capacity).cast("int"))


def reverse_scan(df: DataFrame, query=None, limit: int | None = None, seek: Address | None = None) -> DataFrame:
    """Matches from the newest, or from ``seek`` on backwards."""
    out = where(df, query)
    return _sorted(out if seek is None else out.where(_before(seek, True)), True, limit)


def forward_scan(df: DataFrame, query=None, limit: int | None = None) -> DataFrame:
    """Matches of the retained generations from the oldest."""
    return _sorted(where(retained(df), query), False, limit)


def forward_scan_from_oldest(df: DataFrame, query=None, limit: int | None = None) -> DataFrame:
    """Matches of all generations present, from the oldest."""
    return _sorted(where(df, query), False, limit)


def last_address(df: DataFrame) -> Address | None:
    row = df.agg(F.max(F.struct("generation", "seq"))).first()[0]
    return None if row is None else Address(*row)


def bidirectional(df: DataFrame, query=None, split: Address | None = None) -> tuple[DataFrame, DataFrame]:
    """(existing rows backwards, rows after the split forwards); the split is the last row by default."""
    split = split or last_address(df) or Address(-1, -1)
    found = where(df, query)
    return _sorted(found.where(_before(split, True)), True, None), _sorted(found.where(_after(split)), False, None)


def bidirectional_from(df: DataFrame, anchor: Address, query=None) -> tuple[DataFrame, DataFrame] | None:
    """As ``bidirectional`` around a row, which goes backwards; None when the row is gone."""
    if not is_alive(df, anchor):
        return None
    return bidirectional(df, query, anchor)


def lookup_row(df: DataFrame, a: Address) -> DataFrame:
    return df.where((F.col("generation") == a.generation) & (F.col("seq") == a.seq))


def is_alive(df: DataFrame, a: Address) -> bool:
    return lookup_row(df, a).limit(1).count() > 0


def each(df: DataFrame, query, visit: Callable[[Row], bool]) -> int:
    """Calls ``visit`` with matches from the newest until it returns false; the number of calls."""
    seen = 0
    for row in reverse_scan(df, query).toLocalIterator():
        seen += 1
        if not visit(row):
            break
    return seen


def iterate(df: DataFrame, query=None, newest_first: bool = False) -> Iterator[Row]:
    return _sorted(where(df, query), newest_first, None).toLocalIterator()


def project_saved(df: DataFrame, saved: DataFrame) -> DataFrame:
    """The saved rows that still exist; ``saved`` holds addresses."""
    return df.join(saved.select("generation", "seq").distinct(), ["generation", "seq"]).select(*df.columns)


def generations(df: DataFrame) -> DataFrame:
    """Per generation: rows, first and last seq and timestamp."""
    return df.groupBy("generation").agg(
        F.count("*").alias("n_rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min("ts_ns").alias("min_ts_ns"), F.max("ts_ns").alias("max_ts_ns")
    )
