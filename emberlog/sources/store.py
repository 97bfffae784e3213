"""Logs at rest: append by generation, snapshots, and their validation.

Parquet does what a bucket's dictionaries, deltas and zone maps do: strings are dictionary-encoded,
row groups carry minimum and maximum of ``ts_ns``, and ``generation`` is the partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.display import whole
from emberlog.functions.model import KIND, LOGS
from emberlog.operators.filters import where
from emberlog.operators.scans import RETAINED


class ValidationError(ValueError):
    """A snapshot that breaks a rule of the log schema."""


def append(df: DataFrame, path: str) -> None:
    """Adds rows; within a file they keep arrival order, so time statistics stay narrow."""
    df.sortWithinPartitions("generation", "seq").write.mode("append").partitionBy("generation").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOGS).parquet(path)


def write_snapshot(df: DataFrame, path: str, generation: int) -> None:
    """One generation as a snapshot of its own, with its number of rows and its time range beside it (``_range``)."""
    df.where(F.col("generation") == generation).sortWithinPartitions("seq").write.mode("overwrite").parquet(path)
    _range_of(df.sparkSession.read.parquet(path)).coalesce(1).write.mode("overwrite").json(f"{path}/_range")


def _range_of(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.min("ts_ns"), F.lit(0)).alias("first_ns"), F.coalesce(F.max("ts_ns"), F.lit(0)).alias("last_ns"))


def _range_broken(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """Whether the rows differ in number or time range from what was written beside them."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{path}/_range")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return False
    told = spark.read.schema("rows long, first_ns long, last_ns long").json(f"{path}/_range/*.json").first()
    return told is None or tuple(told) != tuple(_range_of(df).first())


def load_snapshot(spark: SparkSession, path: str, full: bool = False) -> DataFrame:
    """A snapshot, checked: ``full`` also reads every row."""
    df = spark.read.parquet(path)
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = [f.name for f in LOGS if have.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValidationError(f"columns missing or of another type: {', '.join(wrong)}")
    if full and _range_broken(spark, df, path):
        raise ValidationError("rows or time range differ from what the snapshot says")
    if full and (broken := validate(df)):
        raise ValidationError(", ".join(f"{k}: {v} rows" for k, v in broken.items()))
    return df


def validate(df: DataFrame) -> dict[str, int]:
    """Rows that break each rule; empty when all hold.  One pass."""
    span, kind, up = F.col("span_id"), F.col("span_kind"), F.col("parent_span_id")
    rules = {
        "level": ~F.col("level").between(0, 3) | F.col("level").isNull(),
        "timestamp": F.col("ts_ns").isNull() | (F.col("ts_ns") < 0),
        "text": F.col("target").isNull() | F.col("message").isNull(),
        "span": (span == 0) | (span.isNull() != kind.isNull()) | ~F.coalesce(kind.between(0, 3), F.lit(True)),
        "parent": up.isNotNull() & (F.coalesce(kind, F.lit(9)) != 0),
        "fields": F.col("fields").isNull() | F.exists(F.map_values("fields"), lambda v: v.isNull() | ~v["kind"].between(0, 8)),
    }
    rules |= {"time": F.col("ts").isNotNull() & (F.unix_micros("ts") != whole(F.col("ts_ns"), 1000)), "value": F.exists(F.map_values("fields"), lambda v: ~_fits(v))}
    row = df.agg(*[F.count_if(F.coalesce(r, F.lit(False))).alias(k) for k, r in rules.items()]).first()
    repeated = df.groupBy("generation", "seq").count().where("count > 1").count()
    found = {k: row[k] for k in rules if row[k]}
    return found | ({"address": repeated} if repeated else {})


def _fits(v):
    """Whether a value has the column of its kind and no other, within the kind's range."""
    kind = v["kind"]
    held = F.concat(*[F.when(v[c].isNotNull(), c).otherwise("") for c in "sbif"])
    want = F.element_at(F.array(*map(F.lit, ("", "s", "b", "i", "f", "i", "s", "f", "i"))), kind.cast("int") + 1)
    own = (
        F.when(kind == KIND["int"], v["i"].between(F.lit("-9223372036854775808").cast("decimal(20,0)"), F.lit("18446744073709551615").cast("decimal(20,0)")))
        .when(kind == KIND["bool"], v["i"].isin(0, 1))
        .when(kind == KIND["timestamp"], v["i"] >= 0)
        .when(kind == KIND["uuid"], v["s"].rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"))
        .otherwise(F.lit(True))
    )
    return F.when(kind.between(0, 8), (held == want) & F.coalesce(own, F.lit(True))).otherwise(F.lit(True))


def query_snapshot(spark: SparkSession, path: str, query=None) -> DataFrame:
    """Matches of a snapshot, newest first."""
    return where(load_snapshot(spark, path), query).orderBy(F.col("seq").desc())


def drop_old(spark: SparkSession, path: str, keep: int = RETAINED) -> list[int]:
    """Removes the generations a ring of ``keep`` has overwritten; returns them."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if s.getPath().getName().startswith("generation="))
    old = [g for g in found if g <= found[-1] - keep]
    for g in old:
        fs.delete(hadoop.Path(f"{path}/generation={g}"), True)
    return old
