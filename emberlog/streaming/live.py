"""Live logs: tails, backfill with tail, span state, new targets, notification.

The same compiled predicates serve batch and stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from emberlog.functions.model import END, LOGS, START, START_WITH_PARENT
from emberlog.operators.filters import where
from emberlog.operators.scans import Address, bidirectional, last_address
from emberlog.operators.spans import extend_component


def landing(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of parquet files of logs."""
    reader = spark.readStream.schema(LOGS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def binary_landing(spark: SparkSession, path: str, service: str | None = None) -> DataFrame:
    """A stream of binary log files, in name order."""
    from emberlog.sources.binary_log import register

    register(spark)
    return spark.readStream.format("emberlog").option("service", service or "").load(path)


def tail(stream: DataFrame, query=None) -> DataFrame:
    """New matches as they arrive, late ones too."""
    return where(stream, query)


def backfill_and_tail(history: DataFrame, stream: DataFrame, query=None, anchor: Address | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches up to the anchor, newest first; matches after it as a stream); no row is in both."""
    anchor = anchor or last_address(history) or Address(-1, -1)
    past, _ = bidirectional(history, query, anchor)
    after = (F.col("generation") > anchor.generation) | ((F.col("generation") == anchor.generation) & (F.col("seq") > anchor.seq))
    return past, where(stream, query).where(after)


def span_states(stream: DataFrame) -> DataFrame:
    """Per span so far: parent, start, last timestamp, duration and whether it ended; update or complete mode.

    Every span stays in the state; ``open_spans`` lets spans leave it.
    """
    place = F.struct("generation", "seq")
    starts = F.col("span_kind").isin(START_WITH_PARENT, START)
    state = stream.where(F.col("span_id").isNotNull()).groupBy("span_id").agg(
        F.min_by(F.when(starts, F.col("parent_span_id")), F.when(starts, place)).alias("parent_span"),
        F.min_by("ts_ns", place).alias("start_ts_ns"),
        F.max_by("ts_ns", place).alias("last_ts_ns"),
        F.count("*").alias("n_rows"),
        F.coalesce(F.bool_or(F.col("span_kind") == END), F.lit(False)).alias("ended"),
    )
    return state.withColumn("span_duration_ns", F.abs(F.col("last_ts_ns") - F.col("start_ts_ns")))


STATES = "span_id long, parent_span long, start_ts_ns long, last_ts_ns long, n_rows long, ended boolean, span_duration_ns long, closed boolean"
#: Groups that spans are kept in by the hash of their id; a group's spans are one table in the state.
BUCKETS = 256
#: Columns of a kept span: the places of its parent's, its first and its last record, and when it leaves.  A record is a span of its own
#: before spans are folded.  ``named`` is 0 while no Start has come, 1 for a Start without a parent, 2 for one with a parent.
_KEPT = (
    "span_id", "named", "parent", "parent_generation", "parent_seq", "start_generation", "start_seq", "start_ts_ns", "last_generation", "last_seq", "last_ts_ns", "n_rows", "ended", "due_ms",
)
#: Rows of a group that are held before they are folded.
_HELD_ROWS = 65_536


def open_spans(stream: DataFrame, ttl: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """As ``span_states`` in update mode, with an end: a span leaves the state when event time has passed
    ``ttl`` since its last record, with a last row that is ``closed``.

    State is kept per span, however long the span runs; ``late`` is how far behind records may come.
    Spans are folded a group of ``BUCKETS`` at a time, by whole columns.
    """
    rows = stream.where(F.col("span_id").isNotNull()).withWatermark("ts", late)
    wait_ms = int(stream.sparkSession.sql(f"SELECT CAST(unix_millis(TIMESTAMP '1970-01-02' + INTERVAL {ttl}) - unix_millis(TIMESTAMP '1970-01-02') AS LONG)").first()[0])
    starts = F.coalesce(F.col("span_kind").isin(START_WITH_PARENT, START), F.lit(False))
    named = F.when(~starts, 0).when(F.col("parent_span_id").isNull(), 1).otherwise(2)
    # without nulls, so that no id passes through a double
    narrow = rows.select(
        F.pmod(F.xxhash64("span_id"), F.lit(BUCKETS)).alias("bucket"), "span_id", named.cast("long").alias("named"), F.coalesce("parent_span_id", F.lit(0)).alias("parent"),
        F.col("generation").cast("long").alias("generation"), "seq", "ts_ns", F.coalesce(F.col("span_kind") == END, F.lit(False)).cast("long").alias("ended"), "ts",
    )
    return narrow.groupBy("bucket").applyInPandasWithState(_span_states(wait_ms), STATES, "spans binary", "update", "EventTimeTimeout")


def _fold(spans):
    """One row per span of a table of partial spans, in order of arrival; the first to come holds where places are equal."""
    import numpy as np

    n = len(spans["span_id"])
    if not n:
        return spans
    came = np.arange(n)
    order = np.argsort(spans["span_id"], kind="stable")
    ids = spans["span_id"][order]
    heads = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))

    def least(*keys):
        return np.lexsort((*keys[::-1], spans["span_id"]))[heads]

    tails = np.append(heads[1:], n) - 1
    parent = least(spans["named"] == 0, spans["parent_generation"], spans["parent_seq"])
    start = least(spans["start_generation"], spans["start_seq"])
    last = np.lexsort((-came, spans["last_seq"], spans["last_generation"], spans["span_id"]))[tails]
    out = {c: spans[c][parent] for c in _KEPT[:5]} | {c: spans[c][start] for c in _KEPT[5:8]} | {c: spans[c][last] for c in _KEPT[8:11]}
    return out | {
        "n_rows": np.add.reduceat(spans["n_rows"][order], heads), "ended": np.maximum.reduceat(spans["ended"][order], heads), "due_ms": np.maximum.reduceat(spans["due_ms"][order], heads),
    }


def _span_states(wait_ms: int):
    def step(key, frames, state):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        def joined(parts):
            return {c: np.concatenate([p[c] for p in parts]) for c in _KEPT}

        def only(spans, chosen):
            return {c: x[chosen] for c, x in spans.items()}

        def rows(spans, closed: bool):
            parent = pd.arrays.IntegerArray(spans["parent"].copy(), spans["named"] != 2)
            return pd.DataFrame(
                {
                    "span_id": spans["span_id"], "parent_span": parent, "start_ts_ns": spans["start_ts_ns"], "last_ts_ns": spans["last_ts_ns"], "n_rows": spans["n_rows"],
                    "ended": spans["ended"] != 0, "span_duration_ns": np.abs(spans["last_ts_ns"] - spans["start_ts_ns"]), "closed": closed,
                }
            )

        watermark = state.getCurrentWatermarkMs()
        kept = {c: np.zeros(0, "int64") for c in _KEPT}
        if state.exists:
            table = pa.ipc.open_stream(state.get[0]).read_all()
            kept = {c: table[c].to_numpy() for c in _KEPT}
        fresh, held = [], 0
        for frame in () if state.hasTimedOut else frames:
            f = {c: frame[c].to_numpy("int64") for c in ("span_id", "named", "parent", "generation", "seq", "ts_ns", "ended")}
            place = {f"{of}_{c}": f[c] for of in ("parent", "start", "last") for c in ("generation", "seq")}
            fresh.append({c: f[c] for c in ("span_id", "named", "parent", "ended")} | place | {"start_ts_ns": f["ts_ns"], "last_ts_ns": f["ts_ns"], "n_rows": np.ones(len(frame), "int64"), "due_ms": np.zeros(len(frame), "int64")})
            held += len(frame)
            if held > _HELD_ROWS:
                fresh = [_fold(joined(fresh))]
                held = 0
        if fresh:
            fresh = _fold(joined(fresh))
            again = np.isin(kept["span_id"], fresh["span_id"])
            touched = _fold(joined([only(kept, again), fresh]))
            # a span that is already past its time leaves with the next batch
            touched["due_ms"] = np.maximum(touched["last_ts_ns"] // 10**6 + wait_ms, watermark + 1)
            yield rows(touched, False)
            kept = only(kept, ~again)
        over = kept["due_ms"] < watermark
        if over.any():
            yield rows(only(kept, over), True)
            kept = only(kept, ~over)
        if fresh:
            kept = joined([kept, touched])
        if not len(kept["span_id"]):
            state.remove()
            return
        sink = pa.BufferOutputStream()
        table = pa.table(kept)
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as f:
            f.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
        # the group is called again when the first of its spans is over
        state.setTimeoutTimestamp(max(int(kept["due_ms"].min()), watermark, 1))

    return step


def new_targets(stream: DataFrame) -> DataFrame:
    """Each target once, when it is first seen."""
    return stream.select("target").dropDuplicates(["target"])


def grow_component(component_: DataFrame, batch: DataFrame) -> DataFrame:
    """The component (span_id) with the spans of a micro-batch that hang below it, however deep.

    Only the batch's Start records with a parent are looked at; the component stays a table.
    """
    edges = batch.where(F.col("parent_span_id").isNotNull()).groupBy("span_id").agg(F.min("parent_span_id").alias("parent_span"))
    return extend_component(component_, edges)


class UpdateSignal(StreamingQueryListener):
    """Calls back after each micro-batch that brought rows."""

    def __init__(self, on_update: Callable[[int], None]) -> None:
        self.on_update = on_update

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.on_update(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def ingest(stream: DataFrame, path: str, checkpoint: str, on_update: Callable[[DataFrame, int], None] | None = None):
    """Appends a stream to a store, by generation, and calls ``on_update`` after each batch."""
    from emberlog.sources.store import append

    def write(batch: DataFrame, number: int) -> None:
        append(batch, path)
        if on_update:
            on_update(batch, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


class LiveQuery:
    """A tail whose query can be replaced: the old stream stops and the new one goes on from its checkpoint.

    Both queries share the source's progress, so every row is judged once, by the query then in force.
    """

    def __init__(self, stream: DataFrame, query, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
        self.stream, self.query, self.sink, self.checkpoint, self.running = stream, query, sink, checkpoint, None

    def start(self, **trigger):
        def write(batch: DataFrame, number: int) -> None:
            self.sink(where(batch, self.query), number)

        writer = self.stream.writeStream.foreachBatch(write).option("checkpointLocation", self.checkpoint)
        self.running = writer.trigger(**(trigger or {"availableNow": True})).start()
        return self.running

    def update(self, query, **trigger):
        if self.running is not None:
            self.running.stop()
        self.query = query
        return self.start(**trigger)
