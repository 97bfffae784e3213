"""Schemas, kinds and levels of log records, and a small record builder."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Codes of the kinds a field value may have.
KIND = {"null": 0, "string": 1, "bytes": 2, "int": 3, "float": 4, "bool": 5, "uuid": 6, "duration": 7, "timestamp": 8}
LEVEL_NAMES = ("debug", "info", "warn", "error")
#: Kinds of span events on a record.
START_WITH_PARENT, START, CURRENT, END = range(4)

VALUE = T.StructType(
    [
        T.StructField("kind", T.ByteType(), False),
        T.StructField("s", T.StringType()),
        T.StructField("b", T.BinaryType()),
        T.StructField("i", T.DecimalType(20, 0)),
        T.StructField("f", T.DoubleType()),
    ]
)
LOGS = T.StructType(
    [
        T.StructField("generation", T.IntegerType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts_ns", T.LongType(), False),
        T.StructField("ts", T.TimestampType()),
        T.StructField("level", T.ByteType(), False),
        T.StructField("target", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("service", T.StringType()),
        T.StructField("span_id", T.LongType()),
        T.StructField("parent_span_id", T.LongType()),
        T.StructField("span_kind", T.ByteType()),
        T.StructField("fields", T.MapType(T.StringType(), VALUE), False),
    ]
)


@dataclass(frozen=True)
class Duration:
    seconds: float


@dataclass(frozen=True)
class Stamp:
    """A timestamp value: milliseconds since the epoch, never negative."""

    millis: int


@dataclass(frozen=True)
class Span:
    id: int
    parent: int | None = None
    kind: int = CURRENT


def signed(span_id: int) -> int:
    """Span ids are unsigned 64-bit numbers, kept as the long of the same bits."""
    return span_id - 2**64 if span_id >= 2**63 else span_id


def value(x: Any) -> dict:
    """A field value as the struct of the fields map."""
    out: dict[str, Any] = {"kind": 0, "s": None, "b": None, "i": None, "f": None}
    if x is None:
        return out
    if isinstance(x, bool):
        return out | {"kind": KIND["bool"], "i": Decimal(int(x))}
    if isinstance(x, int):
        return out | {"kind": KIND["int"], "i": Decimal(x)}
    if isinstance(x, float):
        return out | {"kind": KIND["float"], "f": x}
    if isinstance(x, str):
        return out | {"kind": KIND["string"], "s": x}
    if isinstance(x, (bytes, bytearray)):
        return out | {"kind": KIND["bytes"], "b": bytes(x)}
    if isinstance(x, uuid.UUID):
        return out | {"kind": KIND["uuid"], "s": str(x)}
    if isinstance(x, Duration):
        return out | {"kind": KIND["duration"], "f": x.seconds}
    if isinstance(x, Stamp):
        return out | {"kind": KIND["timestamp"], "i": Decimal(max(0, x.millis))}
    if isinstance(x, datetime):
        return out | {"kind": KIND["timestamp"], "i": Decimal(max(0, int(x.timestamp() * 1000)))}
    raise TypeError(f"no log value: {type(x).__name__}")


def record(
    seq: int, ts_ns: int, level: int | str = 1, *, span: Span | None = None, service: str | None = None, generation: int = 0, **fields: Any
) -> dict:
    """One row of ``LOGS``.  String fields ``msg`` and ``target`` become columns; of other kinds they are dropped."""
    level = LEVEL_NAMES.index(level) if isinstance(level, str) else level
    pulled = {k: fields.pop(k) for k in ("msg", "target") if k in fields}
    text = {k: v for k, v in pulled.items() if isinstance(v, str)}
    parent = span.parent if span and span.parent is not None else None
    return {
        "generation": generation, "seq": seq, "ts_ns": ts_ns, "ts": datetime.fromtimestamp(ts_ns // 1000 / 1e6),
        "level": level, "target": text.get("target", ""), "message": text.get("msg", ""), "service": service,
        "span_id": None if span is None else signed(span.id), "parent_span_id": None if parent is None else signed(parent),
        "span_kind": None if span is None else span.kind, "fields": {k: value(v) for k, v in fields.items()},
    }


def logs(spark: SparkSession, records: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[f.name] for f in LOGS) for r in records], LOGS)
