"""Registered queries over sources, sinks and streams: what is written comes back as it was.

All of them write into the shared folder, read back, and remove what they wrote once the result is
materialised.  Streams run until they have taken what is there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import display
from emberlog.operators.scans import Address
from emberlog.plans import datasets
from emberlog.plans.registry import _DEEP, EVENTS, registered
from emberlog.shared import materialise, remove, shared_path
from emberlog.sources import binary_log, generator, server, sinks, store
from emberlog.sources.producer import Logger, SocketSink
from emberlog.streaming import live


def cleared(stem: str):
    """The query gets a fresh folder of its own; its result is materialised and the folder removed."""

    def wrap(run: Callable[[SparkSession, str, str], DataFrame]):
        @wraps(run)
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            path = shared_path(spark, stem)
            try:
                return materialise(run(spark, sf_dir, path))
            finally:
                remove(spark, path)

        return query

    return wrap


# binary format

_UUID = "regexp_replace(md5(CAST(event_id AS VARCHAR)), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5')"


@registered("q_binary_round_trip", EVENTS + f"""SELECT ts_ns, CAST(level AS INTEGER) AS level, event_type AS target, props AS message, event_id AS n, CAST(user_id::HUGEINT + 9223372036854775808 AS VARCHAR) AS u, value AS x, {_UUID} AS id,
  value > 100 AS ok, CAST(CAST(value / 1000.0 AS FLOAT) AS DOUBLE) AS wait, epoch_us(ts) // 1000 AS at, hex(event_type) AS raw, coalesce(k < 10, false) AS has_none FROM ev""")
@cleared("binary")
def binary_round_trip(spark, sf_dir, path):
    """Every kind of value through the binary files; a duration keeps the four bytes the format has for it."""
    binary_log.write_files(datasets.typed_logs(spark, sf_dir, spread=True), path)
    v = F.col("fields")
    return binary_log.read_files(spark, path).select(
        "ts_ns", F.col("level").cast("int").alias("level"), "target", "message", display.as_i64(v["n"]).alias("n"), v["u"]["i"].cast("string").alias("u"), display.as_f64(v["x"]).alias("x"),
        v["id"]["s"].alias("id"), display.as_bool(v["ok"]).alias("ok"), v["wait"]["f"].alias("wait"), display.whole(display.as_timestamp_ns(v["at"]), 10**6).alias("at"), F.hex(v["raw"]["b"]).alias("raw"),
        F.map_contains_key("fields", "none").alias("has_none"),
    )


@registered("q_binary_spans", _DEEP + "SELECT span_id, ts_ns, parent AS parent_span_id, CASE WHEN parent IS NULL THEN 1 ELSE 0 END AS span_kind FROM hp UNION ALL SELECT span_id, end_ns, NULL, 3 FROM hp")
@cleared("binary")
def binary_spans(spark, sf_dir, path):
    """Spans, their kinds and parents through the binary files."""
    binary_log.write_files(datasets.deep_logs(spark, sf_dir, spread=True), path)
    return binary_log.read_files(spark, path).select("span_id", "ts_ns", "parent_span_id", F.col("span_kind").cast("int").alias("span_kind"))


@registered("q_binary_rejected", "SELECT count(*) AS records, CAST(0 AS BIGINT) AS rejected FROM events")
@cleared("binary")
def binary_rejected(spark, sf_dir, path):
    binary_log.write_files(datasets.typed_logs(spark, sf_dir, spread=True), path)
    return binary_log.rejected(spark, path).agg(F.sum("records").alias("records"), F.sum("rejected").alias("rejected"))


# stores and snapshots


@registered("q_store_round_trip", EVENTS + "SELECT generation, seq, ts_ns, CAST(level AS INTEGER) AS level, value AS x FROM ev")
@cleared("store")
def store_round_trip(spark, sf_dir, path):
    store.append(datasets.typed_logs(spark, sf_dir), path)
    return store.load(spark, path).select("generation", "seq", "ts_ns", F.col("level").cast("int").alias("level"), display.as_f64(F.col("fields")["x"]).alias("x"))


@registered("q_store_retained", "SELECT generation, count(*) AS n FROM (SELECT CAST(event_id * 6 // (SELECT max(event_id) + 1 FROM events) AS INTEGER) AS generation FROM events) WHERE generation >= 2 GROUP BY 1")
@cleared("store")
def store_retained(spark, sf_dir, path):
    """Six generations in arrival order, of which a ring of four has lost the first two."""
    logs = datasets.typed_logs(spark, sf_dir)
    rows = (logs.agg(F.max("seq")).first()[0] or 0) + 1
    store.append(logs.withColumn("generation", F.floor(F.col("seq") * 6 / rows).cast("int")), path)
    store.drop_old(spark, path)
    return store.load(spark, path).groupBy("generation").agg(F.count("*").alias("n"))


@registered("q_snapshot", EVENTS + "SELECT seq, event_type AS target FROM ev WHERE generation = 0 AND value > 50")
@cleared("snapshot")
def snapshot(spark, sf_dir, path):
    """One generation as a snapshot, read back after all its rows have been checked."""
    store.write_snapshot(datasets.typed_logs(spark, sf_dir), path, 0)
    store.load_snapshot(spark, path, full=True)
    return store.query_snapshot(spark, path, "x > 50").select("seq", "target")


@registered("q_snapshot_faults", "SELECT 'level' AS rule, count(*) AS n FROM events WHERE event_type = 'error' UNION ALL SELECT 'value', count(*) FROM events WHERE event_type = 'click'")
def snapshot_faults(spark, sf_dir):
    """What validation finds in rows with a level, and others with a value, that cannot be."""
    logs = datasets.typed_logs(spark, sf_dir)
    error, click = F.col("target") == "error", F.col("target") == "click"
    twice = F.transform_values("fields", lambda k, v: F.when(k == "ok", v.withField("s", F.lit("x"))).otherwise(v))
    broken = logs.withColumn("level", F.when(error, F.lit(7)).otherwise(F.col("level")).cast("byte")).withColumn("fields", F.when(click, twice).otherwise(F.col("fields")))
    return spark.createDataFrame(list(store.validate(broken).items()), "rule string, n long")


# sinks


def _few(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = datasets.typed_logs(spark, sf_dir)
    return logs.withColumn("fields", F.map_filter("fields", lambda k, v: k.isin("kind", "n", "ok")))


_LINE = "CASE level WHEN 3 THEN 'ERROR' WHEN 2 THEN 'WARN' WHEN 1 THEN 'INFO' ELSE 'DEBUG' END"
_FIELDS = "' kind=' || event_type || ' n=' || event_id || ' ok=' || (value > 100)"


@registered("q_sink_lines", EVENTS + f"SELECT {_LINE} || ' ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z target=' || event_type || ' msg=' || props || {_FIELDS} AS value FROM ev")
@cleared("lines")
def sink_lines(spark, sf_dir, path):
    """Plain lines, through a text sink and back."""
    sinks.lines(_few(spark, sf_dir)).write.text(path)
    return spark.read.text(path)


_COLOR = "chr(27) || CASE level WHEN 3 THEN '[31mERROR' WHEN 2 THEN '[33mWARN ' WHEN 1 THEN '[32mINFO ' ELSE '[34mDEBUG' END || chr(27) || '[0m'"


@registered("q_sink_pretty", EVENTS + f"SELECT strftime(ts, '%H:%M:%S.') || substr(strftime(ts, '%f'), 1, 3) || ' ' || {_COLOR} || ' ' || chr(27) || '[2m' || event_type || chr(27) || '[0m ' || props || {_FIELDS} AS value FROM ev")
def sink_pretty(spark, sf_dir):
    return sinks.lines(_few(spark, sf_dir), pretty=True)


_NATION = "SELECT n_nationkey AS key, n_name AS name FROM nation"


def _local(path: str) -> str:
    """Producers append to files: the shared folder as a mounted directory."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"producers need a mounted folder, not {path}")
    return path.removeprefix("file://")


def _produce(spark: SparkSession, sf_dir: str, log: Logger) -> None:
    """A record for each row of ``nation``, which is small by nature."""
    for r in datasets.table(spark, sf_dir, "nation").toLocalIterator():
        log.info(r["n_name"], key=int(r["n_nationkey"]))


def _nations(df: DataFrame) -> DataFrame:
    return df.select(display.as_i64(F.col("fields")["key"]).alias("key"), F.col("message").alias("name"))


@registered("q_sink_file", _NATION)
@cleared("file")
def sink_file(spark, sf_dir, path):
    """Half of the records are made before there is a sink and wait for it."""
    from pathlib import Path

    Path(_local(path)).mkdir(parents=True)
    log = Logger("app")
    _produce(spark, sf_dir, log)
    log.configure(f"file:{_local(path)}/app.log")
    return _nations(binary_log.read_files(spark, path))


@registered("q_sink_directory", _NATION)
@cleared("directory")
def sink_directory(spark, sf_dir, path):
    """Files of a rotating directory, archived ones included."""
    log = Logger("app")
    log.attach(sinks.RotatingDirectory(_local(path), limit=200).write)
    _produce(spark, sf_dir, log)
    return _nations(binary_log.read_files(spark, path))


@registered("q_sink_socket", "SELECT n_nationkey AS key, n_name AS name, 'api' AS service FROM nation")
@cleared("socket")
def sink_socket(spark, sf_dir, path):
    """Producer, socket, server, landing folder and stream, one after the other."""
    import tempfile

    with tempfile.TemporaryDirectory(prefix="emberlog-") as folder:  # the socket's own place; no data
        listening = server.LogServer(f"{folder}/s", _local(f"{path}/in")).start()
        sink = SocketSink(f"{folder}/s", "api")
        log = Logger("app")
        log.attach(sink.write)
        with log.span("all"):
            _produce(spark, sf_dir, log)
        sink.close()
        listening.stop()
    landed = live.binary_landing(spark, f"{path}/in")
    return _appended(landed.where(F.map_contains_key("fields", "key")).select("fields", "message", "service"), path).select(display.as_i64(F.col("fields")["key"]).alias("key"), F.col("message").alias("name"), "service")


@registered("q_workload", "SELECT m AS message, count(*) AS n, count(DISTINCT c_custkey) AS spans FROM customer, (VALUES ('Request received'), ('Row fetched'), ('Row updated'), ('Request done')) v(m) GROUP BY 1")
def workload(spark, sf_dir):
    """As many spans as there are customers."""
    made = generator.workload(spark, datasets.table(spark, sf_dir, "customer").count())
    return made.groupBy("message").agg(F.count("*").alias("n"), F.count_distinct("span_id").alias("spans"))


# streams


def _appended(stream: DataFrame, path: str) -> DataFrame:
    """All that an appending stream gives for what is there now."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def _landed(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    store.append(df, f"{path}/in")
    return live.landing(spark, f"{path}/in")


@registered("q_stream_tail", EVENTS + "SELECT seq FROM ev WHERE event_type = 'error' AND value > 50")
@cleared("stream")
def stream_tail(spark, sf_dir, path):
    return _appended(live.tail(_landed(spark, datasets.typed_logs(spark, sf_dir), path), '$level = "error" && x > 50').select("seq"), path)


@registered("q_stream_backfill", EVENTS + "SELECT seq, CASE WHEN seq <= 499 THEN 'past' ELSE 'new' END AS part FROM ev WHERE value > 50")
@cleared("stream")
def stream_backfill(spark, sf_dir, path):
    """History up to a row and the stream after it; no row is in both."""
    logs = datasets.typed_logs(spark, sf_dir)
    past, ahead = live.backfill_and_tail(logs, _landed(spark, logs, path), "x > 50", Address(0, 499))
    return past.select("seq", F.lit("past").alias("part")).unionAll(_appended(ahead.select("seq", F.lit("new").alias("part")), path))


@registered("q_stream_targets", "SELECT DISTINCT event_type AS target FROM events")
@cleared("stream")
def stream_targets(spark, sf_dir, path):
    return _appended(live.new_targets(_landed(spark, datasets.typed_logs(spark, sf_dir), path)), path)


@registered("q_stream_ingest", EVENTS + "SELECT generation, seq, ts_ns FROM ev")
@cleared("stream")
def stream_ingest(spark, sf_dir, path):
    """Into a store, by micro-batches."""
    stream = _landed(spark, datasets.typed_logs(spark, sf_dir), path)
    live.ingest(stream, f"{path}/store", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return store.load(spark, f"{path}/store").select("generation", "seq", "ts_ns")


@registered("q_stream_binary", EVENTS + "SELECT ts_ns, event_id AS n FROM ev WHERE event_type = 'view'")
@cleared("stream")
def stream_binary(spark, sf_dir, path):
    """A stream of binary files."""
    binary_log.write_files(datasets.typed_logs(spark, sf_dir, spread=True), f"{path}/in")
    found = live.tail(live.binary_landing(spark, f"{path}/in"), '$target = "view"')
    return _appended(found.select("ts_ns", display.as_i64(F.col("fields")["n"]).alias("n")), path)


@registered("q_stream_replaced", EVENTS + "SELECT seq FROM ev WHERE seq % 2 = 0 AND event_type = 'error' OR seq % 2 = 1 AND event_type = 'view'")
@cleared("stream")
def stream_replaced(spark, sf_dir, path):
    """A live query whose condition is replaced between the even and the odd rows' arrival."""
    logs = datasets.typed_logs(spark, sf_dir)

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("seq").write.mode("append").parquet(f"{path}/out")

    spark.createDataFrame([], "seq long").write.parquet(f"{path}/out")
    query = live.LiveQuery(_landed(spark, logs.where(F.col("seq") % 2 == 0), path), '$level = "error"', keep, f"{path}/progress")
    query.start().awaitTermination()
    store.append(logs.where(F.col("seq") % 2 == 1), f"{path}/in")
    query.update('$target = "view"').awaitTermination()
    return spark.read.schema("seq long").parquet(f"{path}/out")


def _last_batches(stream: DataFrame, mode: str, path: str) -> DataFrame:
    """All rows that a stream in update or complete mode gave, with the batch they came in."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/out")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out")


@registered("q_stream_span_states", _DEEP + "SELECT span_id, parent AS parent_span, end_ns - ts_ns AS span_duration_ns, CAST(2 AS BIGINT) AS n_rows, true AS ended FROM hp")
@cleared("stream")
def stream_span_states(spark, sf_dir, path):
    """State of all spans, in update mode; what came last holds."""
    made = _last_batches(live.span_states(_landed(spark, datasets.deep_logs(spark, sf_dir), path)), "update", path)
    last = made.groupBy("span_id").agg(F.max_by(F.struct("parent_span", "span_duration_ns", "n_rows", "ended"), F.struct("batch", "n_rows")).alias("s"))
    return last.select("span_id", "s.*")


@registered("q_stream_open_spans", _DEEP + "SELECT span_id, parent AS parent_span, end_ns - ts_ns AS span_duration_ns, CAST(2 AS BIGINT) AS n_rows, true AS ended, ts_ns <= (SELECT max(ts_ns) FROM hp) - 7200000000000 AS closed FROM hp")
@cleared("stream")
def stream_open_spans(spark, sf_dir, path):
    """Spans leave the state an hour after their last record, judged with ten minutes for late ones.

    Whether a span has left is compared for those whose time is over by another fifty minutes.
    """
    made = _last_batches(live.open_spans(_landed(spark, datasets.deep_logs(spark, sf_dir), path)), "update", path)
    last = made.groupBy("span_id").agg(F.max_by(F.struct("parent_span", "start_ts_ns", "span_duration_ns", "n_rows", "ended"), F.struct("batch", "closed")).alias("s"), F.bool_or("closed").alias("left"))
    newest = datasets.events(spark, sf_dir).agg(F.max("ts_ns")).first()[0]
    due = F.col("s.start_ts_ns") <= F.lit((newest or 0) - 7_200_000_000_000)
    return last.select("span_id", "s.parent_span", "s.span_duration_ns", "s.n_rows", "s.ended", (due & F.col("left")).alias("closed"))


@registered("q_stream_growth", _DEEP + "SELECT span_id FROM hp WHERE root = 43")
@cleared("stream")
def stream_growth(spark, sf_dir, path):
    """A component that grows with every micro-batch, kept as a table a batch."""
    spark.createDataFrame([(43,)], "span_id long").write.parquet(f"{path}/c0")
    held = [f"{path}/c0"]

    def grow(batch: DataFrame, number: int) -> None:
        grown = live.grow_component(spark.read.parquet(held[-1]), batch)
        grown.write.parquet(f"{path}/c{number + 1}")
        held.append(f"{path}/c{number + 1}")

    stream = _landed(spark, datasets.deep_logs(spark, sf_dir), path)
    stream.writeStream.foreachBatch(grow).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(held[-1])


