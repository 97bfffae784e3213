"""The supplied tables as logs: events with typed columns or with tagged fields, and a forest of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.display import whole
from emberlog.functions.model import KIND, LOGS

#: Rows of a generation, as in a bucket of the log engine this describes.
GENERATION_ROWS = 1_048_575


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ns(ts) -> F.Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def events(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Typed columns; the level follows from the type of event, which is also the target.

    ``err_value`` is ``value`` on errors and missing elsewhere.  ``spread`` deals the narrow rows of the
    table out to all cores, however few pieces its file comes in, for queries that do much with each.
    """
    e = table(spark, sf_dir, "events")
    if spread:
        e = e.repartition("event_id")
    kind = F.col("event_type")
    level = F.when(kind == "error", 3).when(kind == "purchase", 2).when(kind.isin("signup", "view"), 1).otherwise(0)
    return e.select(
        *e.columns,
        F.when(kind == "error", F.col("value")).alias("err_value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.floor(F.col("event_id") / GENERATION_ROWS).cast("int").alias("generation"),
        F.col("event_id").alias("seq"),
        ns(F.col("ts")).alias("ts_ns"),
        level.cast("byte").alias("level"),
        kind.alias("target"),
        F.col("props").alias("message"),
    )


def tagged(kind: str, **given) -> F.Column:
    nothing = {"s": "string", "b": "binary", "i": "decimal(20,0)", "f": "double"}
    return F.struct(F.lit(KIND[kind]).cast("byte").alias("kind"), *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in nothing.items()])


def _pair(key: F.Column, value: F.Column) -> F.Column:
    return F.struct(key.alias("key"), value.alias("v"))


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in the schema of logs: value (float), user_id and k (int), err_value on errors only,
    mixed (an int where k is even, a float where it is odd) and note (null where k is below 10)."""
    e = events(spark, sf_dir)
    pairs = F.array(
        _pair(F.lit("value"), tagged("float", f=F.col("value"))),
        _pair(F.lit("user_id"), tagged("int", i=F.col("user_id"))),
        _pair(F.lit("kind"), tagged("string", s=F.col("event_type"))),
        _pair(F.when(F.col("k").isNotNull(), F.lit("k")), tagged("int", i=F.col("k"))),
        _pair(F.when(F.col("err_value").isNotNull(), F.lit("err_value")), tagged("float", f=F.col("err_value"))),
        _pair(F.when(F.col("k").isNotNull(), F.lit("mixed")), F.when(F.col("k") % 2 == 0, tagged("int", i=F.col("k"))).otherwise(tagged("float", f=F.col("k") / 2.0))),
        _pair(F.when(F.col("k") < 10, F.lit("note")), tagged("null")),
        _pair(F.lit("elapsed"), tagged("duration", f=F.col("value") / 1000.0)),
        _pair(F.lit("at"), tagged("timestamp", i=F.unix_millis(F.col("ts").cast("timestamp")))),
        _pair(F.lit("big"), tagged("bool", i=(F.col("value") > 100).cast("int"))),
    )
    fields = F.map_from_entries(F.filter(pairs, lambda p: p["key"].isNotNull()))
    out = e.select(
        "generation", "seq", "ts_ns", F.col("ts").cast("timestamp").alias("ts"), "level", "target", "message", F.lit(None).cast("string").alias("service"),
        F.lit(None).cast("long").alias("span_id"), F.lit(None).cast("long").alias("parent_span_id"), F.lit(None).cast("byte").alias("span_kind"), fields.alias("fields"),
    )
    return out.select(*[F.col(f.name).cast(f.dataType) for f in LOGS])


def uuid_text(text: F.Column) -> F.Column:
    """A UUID from the MD5 of a text."""
    h = F.md5(text)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def typed_logs(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """The events with one field of every kind: n (int), u (int beyond the signed range), x (float), id (uuid),
    ok (bool), wait (duration), at (timestamp), raw (bytes), kind (string) and none (null where k is below 10).
    A third each has the service api, the service web, and none."""
    e = events(spark, sf_dir, spread)
    unsigned = F.col("user_id").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")
    pairs = F.array(
        _pair(F.lit("n"), tagged("int", i=F.col("event_id"))),
        _pair(F.lit("u"), tagged("int", i=unsigned)),
        _pair(F.lit("x"), tagged("float", f=F.col("value"))),
        _pair(F.lit("id"), tagged("uuid", s=uuid_text(F.col("event_id").cast("string")))),
        _pair(F.lit("ok"), tagged("bool", i=(F.col("value") > 100).cast("int"))),
        _pair(F.lit("wait"), tagged("duration", f=F.col("value") / 1000.0)),
        _pair(F.lit("at"), tagged("timestamp", i=F.unix_millis(F.col("ts").cast("timestamp")))),
        _pair(F.lit("raw"), tagged("bytes", b=F.col("event_type").cast("binary"))),
        _pair(F.lit("kind"), tagged("string", s=F.col("event_type"))),
        _pair(F.when(F.col("k") < 10, F.lit("none")), tagged("null")),
    )
    service = F.when(F.col("user_id") % 3 == 0, "api").when(F.col("user_id") % 3 == 1, "web")
    nothing = F.lit(None)
    out = e.select(
        "generation", "seq", "ts_ns", F.col("ts").cast("timestamp").alias("ts"), "level", "target", "message", service.alias("service"),
        nothing.alias("span_id"), nothing.alias("parent_span_id"), nothing.alias("span_kind"), F.map_from_entries(F.filter(pairs, lambda p: p["key"].isNotNull())).alias("fields"),
    )
    return out.select(*[F.col(f.name).cast(f.dataType) for f in LOGS])


#: Spans with smaller ids are roots of the deep forest.
ROOTS = 64


def deep_logs(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """A forest of deep trees: every event is a span, below the span of half its number down to ``ROOTS``.

    A span has a Start and an End record, ``value`` milliseconds apart.
    """
    e = events(spark, sf_dir, spread).withColumn("span_id", F.col("event_id") + 1)
    parent = F.when(F.col("span_id") >= ROOTS, F.floor(F.col("span_id") / 2).cast("long"))
    took = F.floor(F.coalesce("value", F.lit(0.0)) * 1000).cast("long") * 1000
    common = [F.lit(0).alias("generation"), F.col("span_id"), F.col("level"), F.col("target"), F.col("message")]
    first = e.select(*common, (2 * F.col("event_id")).alias("seq"), F.col("ts_ns"), F.when(parent.isNull(), 1).otherwise(0).alias("span_kind"), parent.alias("parent_span_id"))
    last = e.select(*common, (2 * F.col("event_id") + 1).alias("seq"), (F.col("ts_ns") + took).alias("ts_ns"), F.lit(3).alias("span_kind"), F.lit(None).alias("parent_span_id"))
    both = first.unionByName(last).withColumn("ts", F.timestamp_micros(whole(F.col("ts_ns"), 1000)))
    both = both.withColumns({"service": F.lit(None), "fields": F.expr("map()")})
    return both.select(*[F.col(f.name).cast(f.dataType) for f in LOGS])


def customer_span(key) -> F.Column:
    return key * 2 + 1


def order_span(key) -> F.Column:
    return key * 2 + 2


def span_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of spans: an order is a Start under its customer, a line a record of its order.

    A line's time is the later of ship date and order date.  Rows have typed columns; ``seq`` follows time.
    """
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    starts = o.select(
        ns(F.col("o_orderdate")).alias("ts_ns"), order_span(F.col("o_orderkey")).alias("span_id"), customer_span(F.col("o_custkey")).alias("parent_span_id"),
        F.lit(0).cast("byte").alias("span_kind"), F.lit(1).cast("byte").alias("level"), F.lit("orders").alias("target"), F.col("o_orderpriority").alias("message"),
        F.col("o_totalprice").alias("amount"), F.lit(0).alias("line"),
    )
    dated = l.join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = dated.select(
        ns(F.greatest("l_shipdate", "o_orderdate")).alias("ts_ns"), order_span(F.col("l_orderkey")).alias("span_id"), F.lit(None).cast("long").alias("parent_span_id"),
        F.lit(2).cast("byte").alias("span_kind"), F.lit(0).cast("byte").alias("level"), F.lit("lineitem").alias("target"), F.col("l_returnflag").alias("message"),
        F.col("l_extendedprice").alias("amount"), F.col("l_linenumber").alias("line"),
    )
    both = starts.unionByName(lines)
    # arrival order is time order, a Start before what it starts
    return both.select(F.lit(0).alias("generation"), (whole(F.col("ts_ns"), 1000) * 4 + F.col("span_kind")).cast("long").alias("seq"), *both.columns)
