"""Filters, scans, spans, aggregates, stores, the binary format, sinks and streams on small records."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from emberlog.functions.display import as_i64, iso_ms, iso_ns, seconds
from emberlog.functions.model import END, START, Duration, Span, Stamp, logs, record
from emberlog.operators import aggregates, scans, spans
from emberlog.operators.aggregates import Key
from emberlog.operators.filters import LevelFilter, Query, TargetLevelFilter, compact_levels, where
from emberlog.operators.scans import Address
from emberlog.sources import binary_log, sinks, store
from emberlog.sources.generator import workload
from emberlog.streaming import live

HOUR = 3_600_000_000_000


def seqs(df) -> list[int]:
    return [r["seq"] for r in df.select("seq").collect()]


@pytest.fixture(scope="module")
def tree(spark):
    """root 1 with children 2 and 3; 4 below 2; 9 alone; one record outside spans."""
    made = [
        record(0, 10, span=Span(1, None, START), msg="root"), record(1, 20, span=Span(2, 1, 0), msg="mid", handler="h1"), record(2, 25, span=Span(3, 1, 0)),
        record(3, 30, 3, span=Span(4, 2, 0), msg="leaf fail"), record(4, 31, msg="outside"), record(5, 40, span=Span(4)), record(6, 45, span=Span(2, None, END), generation=1),
        record(7, 50, span=Span(9, None, START), msg="alone", generation=1), record(8, 90, span=Span(1, None, END), generation=1),
    ]
    return logs(spark, made).cache()


def test_level_filter():
    f = LevelFilter.empty().with_level(3).with_level(0)
    assert f.levels() == [0, 3] and f.without_level(0).levels() == [3] and f.contains(3) and not f.contains(1)
    assert LevelFilter.all().trivial


def test_builder_and_compact(tree):
    q = Query.builder().min_timestamp_ns(20).max_timestamp_ns(45).with_levels(LevelFilter(0b1010)).with_expr("$span").build()
    assert sorted(seqs(where(tree, q))) == [1, 2, 3, 5, 6]
    assert compact_levels([], []) is None
    assert compact_levels([0b1000], []).levels() == [3]
    assert sorted(seqs(tree.where(TargetLevelFilter((), 0b1000).column()))) == [3]
    assert sorted(seqs(tree.where(compact_levels([0, 0b1000], [""]).column()))) == [3]


def test_level_and_time_against_sorted_lists(spark):
    rng = random.Random(5)
    made, now = [], 0
    for i in range(3000):
        now += rng.randint(0, 5)
        made.append((now, rng.randint(0, 3)))
    df = logs(spark, [record(i, t, lv, generation=i // 1000) for i, (t, lv) in enumerate(made)]).cache()
    for _ in range(4):
        mask, low = rng.randint(1, 15), rng.randint(0, now)
        high = rng.randint(low, now)
        q = Query.builder().with_levels(LevelFilter(mask)).min_timestamp_ns(low).max_timestamp_ns(high).build()
        want = [i for i, (t, lv) in enumerate(made) if low <= t <= high and mask >> lv & 1]
        assert seqs(scans.forward_scan_from_oldest(df, q)) == want
        assert seqs(scans.reverse_scan(df, q)) == want[::-1]


def test_scans(spark, tree):
    assert seqs(scans.reverse_scan(tree, "$span", limit=3)) == [8, 7, 6]
    assert seqs(scans.reverse_scan(tree, "$span", seek=Address(0, 3))) == [3, 2, 1, 0]
    back, ahead = scans.bidirectional_from(tree, Address(0, 3))
    assert (seqs(back), seqs(ahead)) == ([3, 2, 1, 0], [4, 5, 6, 7, 8])
    assert scans.bidirectional_from(tree, Address(5, 1)) is None
    back, ahead = scans.bidirectional(tree)
    assert len(seqs(back)) == 9 and not seqs(ahead)
    seen = []
    assert scans.each(tree, "$span", lambda r: seen.append(r["seq"]) or len(seen) < 2) == 2
    assert seen == [8, 7]
    assert [r["seq"] for r in scans.iterate(tree, "$level = \"error\"")] == [3]
    assert scans.is_alive(tree, Address(1, 6)) and not scans.is_alive(tree, Address(0, 6))
    saved = spark.createDataFrame([(0, 3), (0, 99)], "generation int, seq long")
    assert seqs(scans.project_saved(tree, saved)) == [3]


def test_ring_keeps_four_generations(spark):
    df = logs(spark, [record(i, i, generation=i) for i in range(6)])
    assert seqs(scans.forward_scan(df)) == [2, 3, 4, 5]
    assert sorted(r["generation"] for r in scans.rotate(df, 2).select("generation").distinct().collect()) == [0, 1, 2]
    assert scans.newest_generation(df.where("false")) is None and seqs(scans.forward_scan(df.where("false"))) == []


def test_span_table(tree):
    got = {r["span_id"]: r for r in spans.span_table(tree).collect()}
    assert {k: (r["parent_span"], r["span_duration_ns"], r["ended"]) for k, r in got.items()} == {
        1: (None, 80, True), 2: (1, 25, True), 3: (1, 0, False), 4: (2, 10, False), 9: (None, 0, False),
    }


def test_span_predicates(tree):
    assert sorted(seqs(where(tree, "$parent_span = 1"))) == [1, 2, 6]
    assert sorted(seqs(where(tree, "!$parent_span"))) == [0, 4, 7, 8]
    assert sorted(seqs(where(tree, "$span_duration > 20ns"))) == [0, 1, 6, 8]
    assert sorted(seqs(where(tree, "!($span_duration > 20ns)"))) == [2, 3, 4, 5, 7]


def test_span_operators(tree):
    matches = where(tree, '$message.contains("fail") || msg = "outside"')
    assert sorted(seqs(spans.expand_spans(tree, matches))) == [3, 5]
    assert seqs(spans.grouped_by_spans(tree, '$level = "error" || $message = "root"')) == [5, 3, 8, 0]
    assert sorted(seqs(spans.span_logs(tree, 2))) == [1, 6]
    first = {r["seq"]: r["first_message"] for r in spans.with_first_record(tree, ["message"]).collect()}
    assert first[6] == "mid" and first[8] == "root" and first[4] is None
    table = spans.span_table(tree)
    assert spans.ancestor_chain(table, 4) == [1, 2]
    assert spans.ancestor_chain(table, 4, 1) == [2]
    assert sorted(tuple(r) for r in spans.ancestors(table, 3).collect()) == [(2, 1, 1), (3, 1, 1), (4, 1, 2), (4, 2, 1)]


def test_components(spark, tree):
    table = spans.span_table(tree)
    assert {r["span_id"]: r["root"] for r in spans.components(table).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}
    assert sorted(r[0] for r in spans.component(table, 4).collect()) == [1, 2, 3, 4]
    assert spans.component(table, 77) is None
    assert sorted(seqs(spans.context(tree, table, 3))) == [0, 1, 2, 3, 5, 6, 8]
    old = spark.createDataFrame([(1,), (2,)], "span_id long")
    new = spark.createDataFrame([(5, 2), (6, 5), (7, 50), (8, 7)], "span_id long, parent_span long")
    assert sorted(r[0] for r in spans.extend_component(old, new).collect()) == [1, 2, 5, 6]


def test_cycles_end(spark):
    table = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "span_id long, parent_span long")
    assert {r["root"] for r in spans.components(table).where("span_id < 4").collect()} == {1}
    assert sorted(r[0] for r in spans.component(table, 4).collect()) == [1, 2, 3, 4]
    assert len(spans.ancestor_chain(table, 4)) == 3


def test_unknown_parents_are_stubs(spark):
    table = spans.span_table(logs(spark, [record(0, 1, span=Span(2, 1, 0))]))
    assert {r["span_id"]: r["n_rows"] for r in table.collect()} == {1: 0, 2: 1}


def test_groups(spark):
    df = logs(spark, [record(i, i, i % 2, target="t", **f) for i, f in enumerate([{"h": "list"}, {"h": "list"}, {"h": 1}, {"h": 1.0}, {"h": None}, {}])])
    got = {(None if r["k1"] is None else (r["k1"]["kind"], r["k1"]["s"])): r["n"] for r in aggregates.group_count(df, ["h"]).collect()}
    assert got == {(1, "list"): 2, (3, None): 1, (4, None): 1, None: 2}
    five = aggregates.group_count(df, [Key("target"), Key("level"), "h", Key("missing"), Key("message")])
    assert five.columns == ["k1", "k2", "k3", "k4", "n"]
    row = aggregates.targets_summary(df).first()
    assert (row["target"], row["debug"], row["info"]) == ("t", 3, 3)


def test_keys_summary(spark):
    df = logs(spark, [record(i, i, a=i, b="x" * 60, c=bool(i % 2)) for i in range(40)])
    got = {r["key"]: r for r in aggregates.keys_summary(df).collect()}
    assert got["a"]["values"] is None and got["a"]["n_values"] == 40 and got["a"]["total"] == 40
    assert got["b"]["values"] is None and got["b"]["n_values"] == 1
    assert got["c"]["values"] == ["false", "true"] and got["c"]["kind_mask"] == 1 << 5
    assert aggregates.storage_stats(df)["rows"] == 40
    assert aggregates.entry_counts(df).first()["n"] == 40


ALL = {
    "s": "text", "long": "y" * 300, "i": -5, "big": 2**64 - 1, "f": 2.5, "u": uuid.UUID(int=7), "t": True, "no": False, "raw": b"\xff\x00", "nothing": None,
    "elapsed": Duration(1.5), "time": Stamp(1_700_000_000_123), "user_id": 9,
}


def test_binary_round_trip():
    span = Span(2**63 + 5, 77, START)
    raw = binary_log.encode_record(123, 2, list(ALL.items()), span)
    ts, level, got, fields, end = binary_log.decode_record(raw)
    assert (ts, level, end, binary_log.record_length(raw)) == (123, 2, len(raw), len(raw))
    assert got.id == span.id and got.parent == 77
    assert dict(reversed(fields)) == ALL and [k for k, _ in fields] == list(ALL)[::-1]
    for kind in (START, 2, END):
        assert binary_log.decode_record(binary_log.encode_record(1, 0, [], Span(5, None, kind)))[2] == Span(5, None, kind)


def test_binary_fuzz():
    rng = random.Random(3)
    makers = [lambda: None, lambda: rng.random() < 0.5, lambda: rng.randint(-(2**63), 2**64 - 1), lambda: rng.random(), lambda: "k" * rng.randint(0, 400), lambda: rng.randbytes(rng.randint(0, 300)), lambda: uuid.UUID(int=rng.getrandbits(128)), lambda: Stamp(rng.randint(0, 2**40))]
    data, want = b"", []
    for i in range(300):
        fields = [(f"k{rng.randint(0, 50)}", rng.choice(makers)()) for _ in range(rng.randint(0, 40))]
        span = rng.choice([None, Span(rng.randint(1, 2**64 - 1), None, 2)])
        data += binary_log.encode_record(i, i % 4, fields, span)
        want.append((i, i % 4, span, fields[::-1]))
    assert list(binary_log.decode(data)) == want
    with pytest.raises(binary_log.FormatError):
        list(binary_log.decode(data[:-1]))
    with pytest.raises(binary_log.FormatError):
        list(binary_log.decode(b"xxxx" + data))


def test_dechunker():
    one, two = binary_log.encode_record(1, 1, [("a", 1)]), binary_log.encode_record(2, 1, [("b", "x")])
    data = binary_log.service_chunk("api") + binary_log.chunk(one + two) + binary_log.chunk(b"") + binary_log.chunk(one)
    want = [("service", "api"), ("record", one), ("record", two), ("record", one)]
    assert list(binary_log.Dechunker().feed(data)) == want
    d = binary_log.Dechunker()
    assert [e for i in range(len(data)) for e in d.feed(data[i : i + 1])] == want and not d.partial
    for bad in (b"\0" * 8, binary_log.chunk(b"\0" * 20), binary_log.chunk(one[:-3])):
        with pytest.raises(binary_log.FormatError):
            list(binary_log.Dechunker().feed(bad))
    with pytest.raises(binary_log.FormatError):
        list(binary_log.Dechunker(max_entry=10).feed(binary_log.chunk(one)))


def test_binary_source_and_store(spark, tmp_path):
    df = workload(spark, 50)
    binary_log.write_files(df.coalesce(2), str(tmp_path / "bin"))
    binary_log.register(spark)
    got = binary_log.read_files(spark, str(tmp_path / "bin"), "api")
    key = ["ts_ns", "level", "target", "message", "service", "span_id", "parent_span_id", "span_kind"]
    assert sorted(map(tuple, got.select(key).collect()), key=str) == sorted(map(tuple, df.select(key).collect()), key=str)
    assert where(got, "status = 500").count() == where(df, "status = 500").count() > 0
    store.append(df, str(tmp_path / "store"))
    loaded = store.load(spark, str(tmp_path / "store"))
    assert loaded.count() == 200 and store.validate(loaded) == {}
    store.write_snapshot(df, str(tmp_path / "snap"), 0)
    assert seqs(store.query_snapshot(spark, str(tmp_path / "snap"), '$message = "Request done"'))[:2] == [199, 195]
    store.load_snapshot(spark, str(tmp_path / "snap"), full=True)
    df.drop("level").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(store.ValidationError):
        store.load_snapshot(spark, str(tmp_path / "bad"))
    df.withColumn("level", F.lit(9).cast("byte")).write.parquet(str(tmp_path / "worse"))
    with pytest.raises(store.ValidationError):
        store.load_snapshot(spark, str(tmp_path / "worse"), full=True)


def test_old_generations_go(spark, tmp_path):
    store.append(logs(spark, [record(i, i, generation=i) for i in range(6)]), str(tmp_path))
    assert store.drop_old(spark, str(tmp_path)) == [0, 1]
    assert sorted(seqs(store.load(spark, str(tmp_path)))) == [2, 3, 4, 5]


def test_display(spark):
    row = spark.sql("SELECT 1766279086123456789L AS ns, 1766279086123L AS ms, 0.0000025D a, 0.0125D b, 90.0D c, 0.0D d").select(
        iso_ns(F.col("ns")), iso_ms(F.col("ms")), *[seconds(F.col(c)) for c in "abcd"]
    ).first()
    assert list(row) == ["2025-12-21T01:04:46.123456789Z", "2025-12-21T01:04:46.123Z", "2.50µs", "12.5ms", "90s", "0ns"]
    df = logs(spark, [record(0, 0, 3, msg="m", target="t", a=1, e=Duration(2.0))])
    assert sinks.lines(df).first()[0] == "ERROR 1970-01-01T00:00:00.000000000Z target=t msg=m a=1 e=2.00s"
    assert "m a=1" in sinks.lines(df, pretty=True).first()[0]
    assert df.select(as_i64(F.col("fields")["a"])).first()[0] == 1


def test_sinks(tmp_path):
    assert sinks.parse_sink("api@dir:/var/log") == sinks.SinkConfig("dir", "/var/log", "api")
    assert sinks.parse_sink("stdout") == sinks.SinkConfig("stdout")
    for bad in ("nope", "file", "stdout:/x"):
        with pytest.raises(ValueError):
            sinks.parse_sink(bad)
    d = sinks.RotatingDirectory(str(tmp_path), limit=10)
    for _ in range(5):
        d.write(b"123456")
    assert [p.stat().st_size for p in sorted((tmp_path / "archive").iterdir())] == [12, 12]


def run(query, name: str):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_streams(spark, tmp_path, tree):
    landing = str(tmp_path / "in")
    tree.coalesce(1).write.parquet(landing)
    run(live.tail(live.landing(spark, landing), '$level = "error" || $message = "root"').select("seq"), "tailed")
    assert sorted(seqs(spark.table("tailed"))) == [0, 3]
    past, ahead = live.backfill_and_tail(tree, live.landing(spark, landing), "$span", Address(0, 4))
    run(ahead.select("seq"), "ahead")
    assert seqs(past) == [3, 2, 1, 0] and sorted(seqs(spark.table("ahead"))) == [5, 6, 7, 8]
    run(live.new_targets(live.landing(spark, landing)), "targets_seen")
    assert spark.table("targets_seen").count() == 1
    states = live.span_states(live.landing(spark, landing))
    q = states.writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {r["span_id"]: (r["parent_span"], r["span_duration_ns"], r["ended"]) for r in spans.span_table(tree).collect()}
    assert {r["span_id"]: (r["parent_span"], r["span_duration_ns"], r["ended"]) for r in spark.table("states").collect()} == batch
    told = []
    q = live.ingest(live.landing(spark, landing), str(tmp_path / "out"), str(tmp_path / "cp"), lambda b, n: told.append(n)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert told == [0] and sorted(seqs(store.load(spark, str(tmp_path / "out")))) == list(range(9))
    one = spark.createDataFrame([(1,)], "span_id long")
    assert sorted(r[0] for r in live.grow_component(one, tree).collect()) == [1, 2, 3, 4]


def test_open_spans_close_after_their_time(spark, tmp_path):
    """A span over an hour's boundary stays one; it leaves when nothing came for the time to live."""
    first = [record(0, HOUR - 60_000_000_000, span=Span(1, None, START)), record(1, HOUR + 60_000_000_000, span=Span(1)), record(2, HOUR, span=Span(2, 1, 0))]
    second = [record(3, HOUR + 120_000_000_000, span=Span(1, None, END)), record(4, 9 * HOUR, msg="later", span=Span(3, None, START))]
    landing = str(tmp_path / "in")
    got = []
    for part in (first, second, [record(5, 10 * HOUR, span=Span(3))]):
        logs(spark, part).coalesce(1).write.mode("append").parquet(landing)
        stream = live.open_spans(live.landing(spark, landing), "30 minutes", "1 minute")
        q = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    last = {r[0]: r for r in got}
    assert last[1] == (1, None, HOUR - 60_000_000_000, HOUR + 120_000_000_000, 3, True, 180_000_000_000, True)
    assert last[2][1] == 1 and last[2][-1] and not last[3][-1] and last[3][4] == 2


def test_late_file_that_sorts_first_is_read_once(spark, tmp_path):
    """New files are known by name: one that sorts before those already read comes through, and no other again."""
    (tmp_path / "in").mkdir()
    seen = []

    def turn(name, message):
        (tmp_path / "in" / name).write_bytes(binary_log.encode_record(1, 1, [("msg", message)]))
        q = live.binary_landing(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda b, n: seen.extend(r["message"] for r in b.collect()))
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)

    turn("part-00000005.log", "five")
    turn("part-00000002.log", "two")
    (tmp_path / "in" / "part-00000005.log").unlink()
    turn("part-00000009.log", "nine")
    assert seen == ["five", "two", "nine"]


def test_long_texts_are_cut_at_a_character():
    text = "é" * 40_000
    (_, _, _, fields), = binary_log.decode(binary_log.encode_record(1, 1, [("t", text), ("b", b"x" * 70_000)]))
    got = dict(fields)
    assert got["t"] == "é" * 32_767 and len(got["b"]) == 65_535


def test_rejected_records_are_counted(spark, tmp_path):
    good = binary_log.encode_record(1, 1, [("a", 1)])
    bad = bytearray(good)
    bad[12] = 9  # no such level
    (tmp_path / "x.log").write_bytes(good + bytes(bad) + good)
    assert [tuple(r)[1:] for r in binary_log.rejected(spark, str(tmp_path)).collect()] == [(3, 1)]
    assert binary_log.read_files(spark, str(tmp_path)).count() == 2


def test_snapshots_know_their_range_and_kinds(spark, tmp_path):
    df = logs(spark, [record(i, 10 + i, u=uuid.UUID(int=i), t=True, e=Duration(1.0), n=None, b=b"x", big=2**64 - 1, f=1.5, s="x", at=Stamp(5)) for i in range(4)])
    store.write_snapshot(df, str(tmp_path / "a"), 0)
    assert store.load_snapshot(spark, str(tmp_path / "a"), full=True).count() == 4
    logs(spark, [record(9, 99)]).write.mode("append").parquet(str(tmp_path / "a"))
    with pytest.raises(store.ValidationError, match="range"):
        store.load_snapshot(spark, str(tmp_path / "a"), full=True)
    wrong = F.transform_values("fields", lambda k, v: F.when(k == "t", v.withField("i", F.lit(7).cast("decimal(20,0)"))).when(k == "s", v.withField("f", F.lit(1.0))).otherwise(v))
    assert store.validate(df.withColumn("fields", wrong)) == {"value": 4}
    assert store.validate(df.withColumn("ts", F.current_timestamp())) == {"time": 4}


def test_binary_stream(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(binary_log.encode_record(1, 3, [("msg", "x")]) + binary_log.encode_record(2, 1, []))
    run(live.tail(live.binary_landing(spark, str(tmp_path)), '$level = "error"').select("message"), "binary_tail")
    assert [r[0] for r in spark.table("binary_tail").collect()] == ["x"]


def test_open_spans_are_kept_in_groups(spark, tmp_path, monkeypatch):
    """Many spans go through each group, which closes those that are over beside those that are not; ids and parents keep all their bits."""
    big, n = 2**63 + 2**53 + 1, 3000
    monkeypatch.setattr(live, "BUCKETS", 2, raising=False)
    minute = 60_000_000_000
    parts = [
        [record(i, HOUR + i, span=Span(big + i, big - 1 - i if i % 2 else None, START)) for i in range(n)],
        [record(n, 4 * HOUR, msg="later", span=Span(1, None, START))],
        [record(n + 1 + i, 4 * HOUR + minute, span=Span(2 + i, None, START)) for i in range(9)] + [record(n + 10, 4 * HOUR + minute, span=Span(1, None, END))],
        [record(n + 11, 4 * HOUR + 45 * minute, span=Span(1))],
    ]
    got, calls = [], []

    def keep(batch, number):
        rows = [tuple(r) for r in batch.collect()]
        got.extend(rows)
        calls.append(len(rows))

    for part in parts:
        logs(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.open_spans(live.landing(spark, str(tmp_path / "in")), "30 minutes", "1 minute")
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
    low = big - 2**64
    closed = sorted(r for r in got if r[-1])
    assert closed == [(low + i, low - 1 - i if i % 2 else None, HOUR + i, HOUR + i, 1, False, 0, True) for i in range(n)] + [(2 + i, None, 4 * HOUR + minute, 4 * HOUR + minute, 1, False, 0, True) for i in range(9)]
    assert [r for r in got if r[0] == 1][-1] == (1, None, 4 * HOUR, 4 * HOUR + 45 * minute, 3, True, 45 * minute, False)
    assert len([r for r in got if not r[-1]]) == n + 12


def test_percentiles_are_exact_in_large_groups(spark):
    """More different values than an approximation of ten thousand keeps apart; negative ones, extremes, nulls, a null group and one row."""
    df = spark.range(60_000).selectExpr("'a' AS g", "(id * 7919) % 60000 * 1000003 - 9000000000 AS v")
    df = df.unionAll(spark.sql("SELECT * FROM VALUES ('b', 9223372036854775807L), ('b', -9223372036854775808L), ('b', NULL), (NULL, 5L), ('c', CAST(NULL AS BIGINT)) t(g, v)"))
    got = {r["g"]: (r["n"], r["values"]) for r in aggregates.discrete_percentiles(df, "g", "v", (0.5, 0.9, 0.99, 0.0)).collect()}
    at = lambda i: i * 1000003 - 9000000000
    assert got == {"a": (60_000, [at(29_999), at(53_999), at(59_399), at(0)]), "b": (3, [-(2**63), 2**63 - 1, 2**63 - 1, -(2**63)]), None: (1, [5] * 4), "c": (1, None)}
    spread = [record(2 * i + k, HOUR + i + k * (i * 1_000_003 + 1), span=Span(i + 1, None, START if k == 0 else END), msg="m") for i in range(25_000) for k in (0, 1)]
    (row,) = aggregates.span_latency(logs(spark, spread), "message").collect()
    assert (row["n"], row["duration_ns"]) == (25_000, [12_499 * 1_000_003 + 1, 22_499 * 1_000_003 + 1, 24_749 * 1_000_003 + 1])


def test_columns_read_and_write_as_single_records_do():
    """Whole batches against one record at a time: every kind, repeated and reserved keys, long records, bad bytes."""
    import pyarrow as pa
    from pyspark.sql.conversion import LocalDataToArrowConversion

    from emberlog.functions.model import LOGS
    from emberlog.sources import record_columns

    rnd = random.Random(3)
    kinds = [None, True, False, -(2**63), 2**64 - 1, 0, 1.5, "", "x" * 127, "y" * 128, "é🙂" * 50, b"", b"\xff\0" * 90, uuid.UUID(int=5), Duration(-0.25), Stamp(1_700_000_000_123), binary_log.Typed(binary_log.I32, -5), binary_log.Typed(binary_log.F32, 0.5)]
    keys = ["a", "msg", "target", "seq", "level", "é", "k" * 127, "status", *[f"z{i}" for i in range(100)]]
    spans_ = [None, Span(2**64 - 1, None, END), Span(5, 2**63 + 1, START), Span(7), Span(9, None, START)]
    made = [binary_log.encode_record(rnd.randrange(2**62), rnd.randrange(4), [(rnd.choice(keys), rnd.choice(kinds)) for _ in range(rnd.choice([0, 1, 5, 12, 80]))], rnd.choice(spans_)) for _ in range(600)]
    made += [binary_log.encode_record(1, 1, [("a", 1)])[:-1] + bytes([x]) for x in (0x1E, 0x7F, 0xFF)] + [bytes([3, 0, 0, binary_log.MAGIC]) + b"abc", binary_log.encode_record(1, 1, [("a", "xy")]).replace(b"xy", b"\xffy")]
    want = []
    for x in made:
        try:
            want.append(binary_log.to_row(10 + len(want), x, "api", 4))
        except binary_log.FormatError:
            continue
    got = record_columns.decode_batch(made, ["api"] * len(made), 10, 4)
    table = LocalDataToArrowConversion.convert(want, LOGS, use_large_var_types=False).cast(record_columns.schema())
    assert 600 < len(want) < len(made) and repr(pa.Table.from_batches([got]).to_pylist()) == repr(table.to_pylist())
    assert record_columns.counts((None, x) for x in made) == (len(made), len(made) - len(want))
    again, sizes = record_columns.encode_batch(got)
    single = [binary_log.from_row(r | {"fields": dict(r["fields"])}) for r in got.to_pylist()]
    assert again.tobytes() == b"".join(single) and sizes.tolist() == list(map(len, single))
    assert record_columns.encode_batch(got.slice(3, 0))[0].tobytes() == b""


def test_writers_begin_new_files(spark, tmp_path):
    """One partition of 24 MiB: files of 16 MiB, read by a task each."""
    big = logs(spark, [record(i, i, msg="m" * 60_000) for i in range(420)]).coalesce(1)
    binary_log.write_files(big, str(tmp_path / "bin"))
    sizes = [p.stat().st_size for p in sorted((tmp_path / "bin").glob("*.log"))]
    assert len(sizes) == 2 and max(sizes) <= binary_log.FILE_BYTES + 60_100
    got = binary_log.read_files(spark, str(tmp_path / "bin"))
    assert got.rdd.getNumPartitions() == 2
    assert sorted(r[0] for r in got.select("ts_ns").collect()) == list(range(420)) and got.select("generation", "seq").distinct().count() == 420


def test_binary_queries_write_by_all_cores(spark, sf_dir, tmp_path):
    """The table is a file of one piece; its rows are dealt out before they are built and written."""
    from emberlog.plans import datasets

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for i, made in enumerate((datasets.typed_logs, datasets.deep_logs)):
            binary_log.write_files(made(spark, sf_dir, spread=True), str(tmp_path / str(i)))
            assert len(list((tmp_path / str(i)).glob("*.log"))) == (4, 8)[i]  # deep logs are a union of two
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
