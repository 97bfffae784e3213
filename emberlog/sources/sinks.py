"""Where logs go: text lines, files, rotating directories, functions; and the string that names a sink."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.display import iso_ns, shown

ROTATE_BYTES = 16 << 20
KINDS = ("stdout", "pretty", "file", "dir", "socket", "off")


def lines(df: DataFrame, pretty: bool = False) -> DataFrame:
    """One text line per record, ``value``: level, time, message and fields."""
    level = F.element_at(F.array(*map(F.lit, ("DEBUG", "INFO ", "WARN ", "ERROR"))), F.col("level").cast("int") + 1)
    pairs = F.transform(F.array_sort(F.map_keys("fields")), lambda k: F.concat(k, F.lit("="), shown(F.col("fields")[k])))
    time = iso_ns(F.col("ts_ns"))
    if not pretty:
        named = [F.when(F.col(c) != "", F.concat(F.lit(f"{n}="), F.col(c))) for c, n in (("target", "target"), ("message", "msg"))]
        return df.select(F.concat_ws(" ", F.trim(level), time, *named, F.array_join(pairs, " ")).alias("value"))
    color = F.element_at(F.array(*map(F.lit, ("\x1b[34m", "\x1b[32m", "\x1b[33m", "\x1b[31m"))), F.col("level").cast("int") + 1)
    head = F.concat(color, level, F.lit("\x1b[0m"))
    at = F.when(F.col("target") != "", F.concat(F.lit("\x1b[2m"), F.col("target"), F.lit("\x1b[0m")))
    return df.select(F.concat_ws(" ", F.substring(time, 12, 12), head, at, F.col("message"), F.array_join(pairs, " ")).alias("value"))


def print_lines(df: DataFrame, pretty: bool = False, out=print) -> None:
    for row in lines(df, pretty).toLocalIterator():
        out(row["value"])


def append_file(data: bytes, path: str) -> None:
    """A single log file, appended to."""
    with open(path, "ab") as f:
        f.write(data)


class RotatingDirectory:
    """Log files of a directory; one that reaches ``limit`` bytes moves to ``archive/``."""

    def __init__(self, folder: str, limit: int = ROTATE_BYTES, name: str = "current.log") -> None:
        self.folder, self.limit, self.name = Path(folder), limit, name
        (self.folder / "archive").mkdir(parents=True, exist_ok=True)

    def write(self, data: bytes) -> None:
        path = self.folder / self.name
        append_file(data, str(path))
        if path.stat().st_size >= self.limit:
            number = len(os.listdir(self.folder / "archive"))
            path.rename(self.folder / "archive" / f"{number:06d}.log")


def to_function(df: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str, **options):
    """A stream into a function of micro-batches."""
    return df.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint).options(**options)


@dataclass(frozen=True)
class SinkConfig:
    """``[SERVICE@]KIND[:PATH]``."""

    kind: str
    path: str | None = None
    service: str | None = None


def parse_sink(text: str) -> SinkConfig:
    service, at, rest = text.partition("@")
    if not at:
        service, rest = "", text
    kind, colon, path = rest.partition(":")
    if kind not in KINDS:
        raise ValueError(f"unknown sink: {kind!r}")
    if (kind in ("file", "dir", "socket")) != bool(colon and path):
        raise ValueError(f"sink {kind!r} {'needs' if not path else 'takes no'} path")
    return SinkConfig(kind, path or None, service or None)
