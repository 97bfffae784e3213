"""Pieces shared by the operators: shared-folder materialising, skew-safe lookups, Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.shared import dropping_shuffles, materialise, remove, shared_path

__all__ = ["arrow_map", "byte_values", "dropping_shuffles", "flat_bytes", "labelled_sample", "learnable", "lookup", "materialise", "release", "remove", "shared_path", "within"]

#: A key is hot when it stands for more than one in HOT_SHARE of all rows, or in the number of partitions where
#: that is more; so at most as many keys are hot, and no other fills a partition.
HOT_SHARE = 1000

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts at exactly these six bytes.
ASCII_SPACE = b"\t\n\x0b\x0c\r "


def lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    weight: str,
    spread: Column,
    total: int | None = None,
) -> DataFrame:
    """Left-outer join of ``left`` to ``right``, which is unique on ``key``, without a hot task.

    ``weight`` is a column of ``right``: how many left rows carry the key.  Keys above one in
    ``share`` (``HOT_SHARE`` or the number of partitions) of ``total`` number at most ``share`` whatever
    the input, so that part of ``right`` is broadcast; their left rows take the value there and are spread over the shuffle by
    ``spread``.  All other keys meet in a shuffled join in which no key is hot.  ``key`` must not be
    null on the right; null left keys find nothing.
    """
    if total is None:
        total = right.agg(F.sum(weight)).first()[0] or 0
    share = max(HOT_SHARE, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    values = [c for c in right.columns if c != key]
    hot = right.where(F.col(weight) * share > F.lit(total)).select(
        F.col(key).alias("__hk"), F.struct(*values).alias("__hv")
    )
    cold = right.where(F.col(weight) * share <= F.lit(total)).select(
        F.lit(0).cast("int").alias("__rs"), F.col(key).alias("__rk"), F.struct(*values).alias("__rv")
    )
    out = left.join(F.broadcast(hot), F.col(key) == F.col("__hk"), "left")
    away = F.col("__hv").isNotNull() | F.col(key).isNull()
    out = out.withColumn(
        "__ls", F.when(away, F.pmod(F.xxhash64(spread), F.lit(9973)).cast("int") + 1).otherwise(F.lit(0))
    )
    out = out.join(cold, (F.col("__ls") == F.col("__rs")) & (F.col(key) == F.col("__rk")), "left")
    found = F.coalesce(F.col("__hv"), F.col("__rv"))
    return out.select(*[F.col(f"`{c}`") for c in left.columns], *[found[c].alias(c) for c in values])


def byte_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def release() -> None:
    """Gives memory that this Python worker has freed back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def arrow_map(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` under one name, so that plans read alike."""
    return df.mapInArrow(function, schema)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and the n + 1 offsets of its rows; null is empty."""
    column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def learnable(doc_id: str | Column, modulus: int, held: int) -> tuple[Column, Column]:
    """(held out, usable for learning) by crc32 of the id as text."""
    rest = F.pmod(F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(-1)).cast("string")), F.lit(modulus))
    return rest == held, rest != held


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, modulus: int, held: int, rows: int
) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold, with label ``y``.

    The fold rule is applied to the labels, so held-out labels are never read for learning.  The
    sample is the ``rows`` labels with the smallest hash of their id: bounded, so it may be
    broadcast to the documents.  Repeated labels of one document count as their largest.
    """
    _, usable = learnable("doc_id", modulus, held)
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.max(target).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .select(F.col("doc_id").alias("__id"), "y")
    )
    return docs.join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).drop("__id")


def within(sample: DataFrame, most: int) -> DataFrame:
    """Of a bounded sample, in the order of ``place``, the rows that fit into a total ``weight`` of ``most``.

    A row that doesn't fit is left out as a whole.  Only the two numbers of each row meet in the driver.
    """
    made = materialise(sample)
    room, out = most, []
    for place, weight in sorted(tuple(r) for r in made.select("place", "weight").collect()):
        if weight > room:
            out.append(place)
        else:
            room -= weight
    return made.where(~F.col("place").isin(out)) if out else made
