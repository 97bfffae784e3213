"""A synthetic workload of spans with request, response and storage records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.display import whole
from emberlog.functions.model import KIND, LOGS

HANDLERS = ("list_users", "get_user", "update_user", "create_order", "list_orders")
METHODS = ("GET", "POST", "PUT")


def workload(spark: SparkSession, spans: int, seed: int = 7, per_generation: int = 1 << 20) -> DataFrame:
    """Four records a span, made where they are needed: request, storage, storage, response."""
    base = spark.range(spans * 4).withColumnRenamed("id", "seq")
    pick = lambda n, salt: F.pmod(F.xxhash64(F.floor(F.col("seq") / 4), F.lit(seed + salt)), F.lit(n))
    step = F.col("seq") % 4
    span = F.shiftleft(F.lit(1).cast("long"), 62) + F.floor(F.col("seq") / 4)
    parent = F.when(pick(3, 1) == 0, F.lit(None).cast("long")).otherwise(F.shiftleft(F.lit(1).cast("long"), 62) + F.floor(F.col("seq") / 40) * 10)
    parent = F.when(parent == span, F.lit(None)).otherwise(parent)
    nothing = {"s": "string", "b": "binary", "i": "decimal(20,0)", "f": "double"}

    def tagged(kind: str, **given):
        return F.struct(F.lit(KIND[kind]).cast("byte").alias("kind"), *[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in nothing.items()])

    handler = F.element_at(F.array(*map(F.lit, HANDLERS)), (pick(len(HANDLERS), 2) + 1).cast("int"))
    method = F.element_at(F.array(*map(F.lit, METHODS)), (pick(len(METHODS), 3) + 1).cast("int"))
    request = F.create_map(F.lit("handler"), tagged("string", s=handler), F.lit("method"), tagged("string", s=method))
    storage = F.create_map(F.lit("user_id"), tagged("int", i=pick(5000, 4)), F.lit("amount"), tagged("float", f=pick(10_000, 5) / 100.0))
    response = F.create_map(
        F.lit("status"), tagged("int", i=F.when(pick(20, 6) == 0, 500).otherwise(200)), F.lit("elapsed"), tagged("duration", f=pick(2000, 7) / 1000.0)
    )
    ts_ns = F.lit(1_700_000_000_000_000_000).cast("long") + F.floor(F.col("seq") / 4) * 1_000_000 + step * (pick(400_000, 8) + 1)
    out = base.select(
        F.floor(F.col("seq") / per_generation).cast("int").alias("generation"),
        "seq",
        ts_ns.alias("ts_ns"),
        F.timestamp_micros(whole(ts_ns, 1000)).alias("ts"),
        F.when((step == 3) & (pick(20, 6) == 0), 3).otherwise(F.when(step == 0, 1).otherwise(0)).cast("byte").alias("level"),
        F.when(step.isin(1, 2), "app::db").otherwise("app::http").alias("target"),
        F.element_at(F.array(*map(F.lit, ("Request received", "Row fetched", "Row updated", "Request done"))), (step + 1).cast("int")).alias("message"),
        F.lit("api").alias("service"),
        span.alias("span_id"),
        F.when(step == 0, parent).alias("parent_span_id"),
        F.when(step == 0, F.when(parent.isNull(), 1).otherwise(0)).when(step == 3, 3).otherwise(2).cast("byte").alias("span_kind"),
        F.when(step == 0, request).when(step == 3, response).otherwise(storage).alias("fields"),
    )
    return out.select(*[F.col(f.name).cast(f.dataType) for f in LOGS])
