"""Registered queries over the supplied tables and the SQL that says the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import display
from emberlog.functions.binding import TypedBinding
from emberlog.operators import aggregates, scans, spans
from emberlog.operators.aggregates import Key
from emberlog.operators.filters import LevelFilter, Query, TargetLevelFilter, compact_levels, where
from emberlog.operators.scans import Address
from emberlog.plans import datasets
from emberlog.plans.errors import QueryParseError
from emberlog.plans.parser import parse
from emberlog.plans.predicates import FALSE, TRUE, And, Or, span_set
from emberlog.shared import materialise

FLAGSHIP = "q_pred_flagship"


def _uuid(text: str) -> str:
    h = hashlib.md5(text.encode()).hexdigest()
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


EVENTS = """WITH ev AS (SELECT *, CASE WHEN event_type = 'error' THEN value END AS err_value,
  CAST(json_extract(props, '$.k') AS INTEGER) AS k,
  CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 WHEN 'view' THEN 1 ELSE 0 END AS level,
  CAST(epoch_us(ts) AS BIGINT) * 1000 AS ts_ns, CAST(event_id // 1048575 AS INTEGER) AS generation, event_id AS seq FROM events) """

#: name: (table, key columns, query, SQL condition)
PREDICATES: dict[str, tuple[str, str, str, str]] = {
    "flagship": ("events", "event_id, event_type, value", 'event_type = "error" && value > 50', "event_type = 'error' AND value > 50"),
    "text_equal": ("events", "event_id", 'event_type == "click"', "event_type = 'click'"),
    "text_not_equal": ("events", "event_id", 'event_type != "click"', "event_type <> 'click'"),
    "text_any": ("events", "event_id", 'event_type in ["view", "signup",]', "event_type IN ('view', 'signup')"),
    "any_mixed_kinds": ("events", "event_id", 'user_id in [3, "4", 5.0, 7]', "user_id IN (3, 7, 5)"),
    "list_contains": ("events", "event_id", '["view", "click"].contains(event_type)', "event_type IN ('view', 'click')"),
    "contains": ("part", "p_partkey", 'p_name.contains("a")', "contains(p_name, 'a')"),
    "starts_with": ("part", "p_partkey", 'p_brand.starts_with("Brand#1")', "starts_with(p_brand, 'Brand#1')"),
    "ends_with": ("part", "p_partkey", 'p_type.ends_with("L")', "suffix(p_type, 'L')"),
    "bytes_equal": ("customer", "c_custkey", 'c_mktsegment = b"BUILDING"', "c_mktsegment = 'BUILDING'"),
    "int_equal": ("events", "event_id", "user_id = 0x7", "user_id = 7"),
    "int_on_float": ("part", "p_partkey", "p_retailprice = 1000 || p_size = 7", "p_size = 7"),
    "unsigned": ("events", "event_id", "user_id = 9_223_372_036_854_775_808 || user_id < 5", "user_id < 5"),
    "float_range": ("lineitem", "l_orderkey, l_linenumber, l_partkey", "l_discount >= 0.05 && l_discount < 0.07", "l_discount >= 0.05 AND l_discount < 0.07"),
    "float_on_int": ("part", "p_partkey", "p_size > 10.5 && p_size <= 20.5", "p_size >= 11 AND p_size <= 20"),
    "or_ranges": ("events", "event_id", "value < 5 || value > 400", "value < 5 OR value > 400"),
    "is_finite": ("events", "event_id", "err_value.is_finite()", "err_value IS NOT NULL"),
    "exists": ("events", "event_id", "err_value", "err_value IS NOT NULL"),
    "not_exists": ("events", "event_id", "!err_value.exists()", "err_value IS NULL"),
    "null_value": ("events", "event_id", "err_value = null || user_id = 1", "user_id = 1"),
    "bool_true": ("events", "event_id", "big = true", "value > 100"),
    "bool_false": ("events", "event_id", "big = false", "NOT coalesce(value > 100, false)"),
    "is_type": ("events", "event_id", "err_value is Float && user_id is Integer && !(event_type is Number)", "err_value IS NOT NULL"),
    "is_number_or_text": ("events", "event_id", "err_value is Number || event_type is Uuid", "err_value IS NOT NULL"),
    "duration": ("events", "event_id", "elapsed > 100ms + 50ms && elapsed <= 0.4s", "value / 1000.0 > 0.15 AND value / 1000.0 <= 0.4"),
    "negated_missing": ("events", "event_id", "err_value != 1.5 && !(err_value > 100)", "NOT coalesce(err_value > 100, false) AND NOT coalesce(err_value = 1.5, false)"),
    "negated_group": ("events", "event_id", '!(event_type = "click" && value > 20) && not err_value < 30', "NOT (event_type = 'click' AND value > 20) AND NOT coalesce(err_value < 30, false)"),
    "precedence": ("events", "event_id", 'event_type = "view" && value > 100 || event_type = "click" && value < 10', "event_type = 'view' AND value > 100 OR event_type = 'click' AND value < 10"),
    "unknown_key": ("events", "event_id", "nosuch = 1 || !nosuch && user_id = 2", "user_id = 2"),
    "folding": ("events", "event_id", "user_id = (0o17 & 0b1110) + (7 - 1) / 4 * 2 % 5 || user_id = 1 << 4 ^ 3", "user_id IN (16, 19)"),
    "text_fold": ("events", "event_id", 'event_type = "cl" + "ick" && user_id = -(-3)', "event_type = 'click' AND user_id = 3"),
    "time_day": ("events", "event_id", 'ts in time_range("2024-01-05")', "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'"),
    "time_hour": ("events", "event_id", 'ts in time_range("2024-01-05T03Z") || ts in time_range("2024-01-07T10+02:00")', "date_trunc('hour', ts) IN (TIMESTAMP '2024-01-05 03:00:00', TIMESTAMP '2024-01-07 08:00:00')"),
    "time_month_orders": ("orders", "o_orderkey", 'o_orderdate in time_range("1995-03")', "date_trunc('month', o_orderdate) = TIMESTAMP '1995-03-01'"),
    "entry_time": ("events", "event_id", '$timestamp in time_range("2024-01-1" + "0")', "date_trunc('day', ts) = TIMESTAMP '2024-01-10'"),
    "level_equal": ("events", "event_id", '$level = "error" || $level == "warning"', "level IN (2, 3)"),
    "level_in": ("events", "event_id", '$level in ["INFO", "debug"]', "level IN (0, 1)"),
    "level_not": ("events", "event_id", '$level != "debug"', "level <> 0"),
    "target": ("events", "event_id", '$target.starts_with("s") || target = "view"', "starts_with(event_type, 's') OR event_type = 'view'"),
    "message": ("events", "event_id", '$message.contains("7") && !msg.ends_with("1}")', "contains(props, '7') AND NOT suffix(props, '1}')"),
    "text_documents": ("documents", "doc_id", 'text.contains("License") && !(lang in ["en"])', "contains(text, 'License') AND lang <> 'en'"),
    "text_pages": ("pages", "page_id", 'url.starts_with("https") && html.contains("<p>")', "starts_with(url, 'https') AND contains(html, '<p>')"),
    "text_conversations": ("conversations", "conv_id, turn", 'role = "user" && text.ends_with("he.")', "role = 'user' AND suffix(text, 'he.')"),
}

#: name: (query on tagged fields, SQL condition)
DYNAMIC: dict[str, tuple[str, str]] = {
    "int": ("user_id = 7", "user_id = 7"),
    "int_misses_float": ("mixed = 4", "k = 4"),
    "number_all_kinds": ("mixed >= 4 && mixed < 6.5", "(k % 2 = 0 AND k >= 4 AND k <= 6) OR (k % 2 = 1 AND k / 2.0 >= 4 AND k / 2.0 < 6.5)"),
    "float_equal": ("mixed = 2.5", "k = 5"),
    "missing_negated": ("!(err_value > 100)", "NOT coalesce(err_value > 100, false)"),
    "null_is_present": ("note && note is Null && note = null", "k < 10"),
    "null_negated": ("!note", "NOT coalesce(k < 10, false)"),
    "kind": ("mixed is Float", "k % 2 = 1"),
    "text": ('kind in ["click", 3] && kind.ends_with("k")', "event_type = 'click'"),
    "bytes_match_text": ('kind = b"view"', "event_type = 'view'"),
    "duration": ("elapsed >= 200ms", "value / 1000.0 >= 0.2"),
    "time": ('at in time_range("2024-01-03")', "ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-04'"),
    "bool": ("big = true && !(big = false)", "value > 100"),
    "finite": ("mixed.is_finite()", "k % 2 = 1"),
    "metas": ('$level = "error" || kind.starts_with("pur") && $target.contains("c")', "event_type IN ('error', 'purchase')"),
}

Run = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Run] = {}
_SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def add(run: Run) -> Run:
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return run

    return add


def _predicate(table: str, keys: str, text: str) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = keys.split(", ")
        if table != "events":
            return where(datasets.table(spark, sf_dir, table), text).select(*columns)
        df = datasets.events(spark, sf_dir)
        df = df.withColumns({"big": F.col("value") > 100, "elapsed": F.col("value") / 1000.0})
        return where(df, text, TypedBinding(df, kinds={"elapsed": "duration"})).select(*columns)

    return run


def _dynamic(text: str) -> Run:
    return lambda spark, sf_dir: where(datasets.event_logs(spark, sf_dir), text).select("seq")


for _name, (_table, _keys, _text, _condition) in PREDICATES.items():
    _from = f"{EVENTS}SELECT {_keys} FROM ev" if _table == "events" else f"SELECT {_keys} FROM {_table}"
    registered(f"q_pred_{_name}", f"{_from} WHERE {_condition}")(_predicate(_table, _keys, _text))
for _name, (_text, _condition) in DYNAMIC.items():
    registered(f"q_dyn_{_name}", f"{EVENTS}SELECT seq FROM ev WHERE {_condition}")(_dynamic(_text))

# programmatic filters


@registered("q_filter_builder", EVENTS + "SELECT event_id FROM ev WHERE ts_ns BETWEEN 1704412800000000000 AND 1704499199999999999 AND level IN (0, 3) AND value > 10")
def filter_builder(spark, sf_dir):
    q = Query.builder().min_timestamp_ns(1704412800000000000).max_timestamp_ns(1704499199999999999)
    q = q.with_levels(LevelFilter(0b1001)).with_expr("value > 10").build()
    return where(datasets.events(spark, sf_dir), q).select("event_id")


@registered("q_filter_target_level", EVENTS + "SELECT event_id FROM ev WHERE event_type = 'view' OR (event_type NOT IN ('view', 'click') AND level >= 2)")
def filter_target_level(spark, sf_dir):
    df = datasets.events(spark, sf_dir)
    return df.where(TargetLevelFilter((("view", 0b0010), ("click", 0)), 0b1100).column()).select("event_id")


@registered("q_filter_compact", EVENTS + "SELECT event_id FROM ev WHERE event_type = 'click' OR (event_type IN ('error', 'purchase') AND level = 3)")
def filter_compact(spark, sf_dir):
    f = compact_levels([2, 0b1000, 0, 0b0001], ["click", "error", "purchase", "signup", "view"])
    return datasets.events(spark, sf_dir).where(f.column()).select("event_id")


@registered("q_filter_targets", EVENTS + "SELECT event_id FROM ev WHERE event_type IN ('signup', 'error')")
def filter_targets(spark, sf_dir):
    return where(datasets.events(spark, sf_dir), Query.builder().with_targets(["signup", "error"]).build()).select("event_id")


# scans

_LAST = "(SELECT max(event_id) FROM events)"


@registered("q_scan_reverse", EVENTS + "SELECT seq, event_type FROM ev WHERE value > 30 ORDER BY seq DESC LIMIT 100")
def scan_reverse(spark, sf_dir):
    """The feature is the page: the newest hundred matches."""
    return scans.reverse_scan(datasets.events(spark, sf_dir), "value > 30", limit=100).select("seq", "event_type")


@registered("q_scan_forward", EVENTS + "SELECT seq FROM ev WHERE generation > (SELECT max(generation) FROM ev) - 4 AND event_type = 'error'")
def scan_forward(spark, sf_dir):
    return scans.forward_scan(datasets.events(spark, sf_dir), 'event_type = "error"').select("seq")


@registered("q_scan_forward_oldest", EVENTS + "SELECT seq FROM ev WHERE event_type = 'error'")
def scan_forward_oldest(spark, sf_dir):
    return scans.forward_scan_from_oldest(datasets.events(spark, sf_dir), 'event_type = "error"').select("seq")


@registered("q_scan_bidirectional", EVENTS + "SELECT seq, CASE WHEN seq <= 500 THEN 'back' ELSE 'ahead' END AS way FROM ev WHERE value > 50")
def scan_bidirectional(spark, sf_dir):
    back, ahead = scans.bidirectional_from(datasets.events(spark, sf_dir), Address(0, 500), "value > 50")
    return back.select("seq", F.lit("back").alias("way")).unionAll(ahead.select("seq", F.lit("ahead").alias("way")))


@registered("q_scan_seek", EVENTS + "SELECT seq FROM ev WHERE value > 50 AND seq <= 700 ORDER BY seq DESC LIMIT 50")
def scan_seek(spark, sf_dir):
    """The feature is the page: fifty matches back from an address."""
    return scans.reverse_scan(datasets.events(spark, sf_dir), "value > 50", limit=50, seek=Address(0, 700)).select("seq")


@registered("q_scan_saved", EVENTS + "SELECT seq, value FROM ev WHERE event_type = 'error' AND generation > (SELECT max(generation) FROM ev) - 4")
def scan_saved(spark, sf_dir):
    df = datasets.events(spark, sf_dir)
    saved = where(df, 'event_type = "error"')
    return scans.project_saved(scans.retained(df), saved).select("seq", "value")


@registered("q_scan_generations", EVENTS + "SELECT generation, count(*) AS n_rows, min(seq) AS first_seq, max(seq) AS last_seq, min(ts_ns) AS min_ts_ns, max(ts_ns) AS max_ts_ns FROM ev GROUP BY generation")
def scan_generations(spark, sf_dir):
    return scans.generations(datasets.events(spark, sf_dir))


@registered("q_scan_lookup", EVENTS + "SELECT seq, event_type FROM ev WHERE seq = 123")
def scan_lookup(spark, sf_dir):
    return scans.lookup_row(datasets.events(spark, sf_dir), Address(0, 123)).select("seq", "event_type")


# aggregates


@registered("q_group_two_keys", EVENTS + "SELECT event_type AS k1, level AS k2, count(*) AS n FROM ev WHERE value > 20 GROUP BY 1, 2")
def group_two_keys(spark, sf_dir):
    out = aggregates.group_count(datasets.events(spark, sf_dir), [Key("target"), Key("level")], "value > 20")
    return out.withColumn("k2", F.col("k2").cast("int"))


@registered("q_group_missing", EVENTS + "SELECT CASE WHEN err_value IS NULL THEN 'none' ELSE 'some' END AS present, CAST(NULL AS VARCHAR) AS k2, count(*) AS n FROM ev GROUP BY 1, 2")
def group_missing(spark, sf_dir):
    df = datasets.events(spark, sf_dir)
    df = df.withColumn("present", F.when(F.col("err_value").isNotNull(), "some"))
    out = aggregates.group_count(df, ["present", Key("missing")])
    return out.select(F.coalesce("k1", F.lit("none")).alias("present"), "k2", "n")


@registered("q_group_typed_keys", EVENTS + "SELECT k % 2 = 0 AS whole, CASE WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) ELSE k / 2.0 END AS number, count(*) AS n FROM ev GROUP BY 1, 2")
def group_typed_keys(spark, sf_dir):
    """Equal numbers of different kinds stay apart."""
    out = aggregates.group_count(datasets.event_logs(spark, sf_dir), ["mixed"])
    return out.select((F.col("k1.kind") == 3).alias("whole"), display.as_f64(F.col("k1")).alias("number"), "n")


@registered("q_group_message", EVENTS + "SELECT props AS k1, event_type AS k2, count(*) AS n FROM ev GROUP BY 1, 2")
def group_message(spark, sf_dir):
    return aggregates.group_count(datasets.events(spark, sf_dir), ["$message", "$target"])


@registered("q_targets", EVENTS + "SELECT event_type AS target, count(*) FILTER (level = 0) AS debug, count(*) FILTER (level = 1) AS info, count(*) FILTER (level = 2) AS warn, count(*) FILTER (level = 3) AS error FROM ev GROUP BY 1")
def targets(spark, sf_dir):
    return aggregates.targets_summary(datasets.events(spark, sf_dir))


@registered("q_keys", EVENTS + """, p AS (SELECT 'user_id' AS key, 8 AS bit, CAST(user_id AS VARCHAR) AS v FROM ev
  UNION ALL SELECT 'kind', 2, event_type FROM ev UNION ALL SELECT 'k', 8, CAST(k AS VARCHAR) FROM ev WHERE k IS NOT NULL
  UNION ALL SELECT 'note', 1, 'None' FROM ev WHERE k < 10
  UNION ALL SELECT 'value', 16, CAST(value AS VARCHAR) FROM ev UNION ALL SELECT 'err_value', 16, CAST(err_value AS VARCHAR) FROM ev WHERE err_value IS NOT NULL
  UNION ALL SELECT 'mixed', CASE WHEN k % 2 = 0 THEN 8 ELSE 16 END, CAST(k AS VARCHAR) FROM ev WHERE k IS NOT NULL
  UNION ALL SELECT 'elapsed', 128, CAST(value / 1000.0 AS VARCHAR) FROM ev UNION ALL SELECT 'at', 256, CAST(epoch_us(ts) // 1000 AS VARCHAR) FROM ev
  UNION ALL SELECT 'big', 32, CASE WHEN value > 100 THEN 'true' ELSE 'false' END FROM ev)
  SELECT key, count(*) AS total, CAST(bit_or(bit) AS INTEGER) AS kind_mask, count(DISTINCT v) AS n_values,
    CASE WHEN count(DISTINCT v) < 32 THEN string_agg(DISTINCT v, ',' ORDER BY v) END AS listed FROM p GROUP BY key""")
def keys(spark, sf_dir):
    out = aggregates.keys_summary(datasets.event_logs(spark, sf_dir))
    return out.select("key", "total", "kind_mask", "n_values", F.array_join("values", ",").alias("listed"))


@registered("q_storage", "SELECT count(*) AS n_rows, true AS has_bytes FROM events")
def storage(spark, sf_dir):
    """Bytes differ by writer, so only whether there are any is compared."""
    found = aggregates.storage_stats(datasets.table(spark, sf_dir, "events"))
    return spark.createDataFrame([(int(found["rows"]), found["bytes"] > 0)], "n_rows long, has_bytes boolean")


@registered("q_entry_counts", EVENTS + "SELECT generation, count(*) AS n FROM ev GROUP BY 1")
def entry_counts(spark, sf_dir):
    return aggregates.entry_counts(datasets.events(spark, sf_dir))


# projections


@registered("q_display", EVENTS + "SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS at, user_id AS user, value AS number, value > 100 AS big, epoch_us(ts) // 1000 * 1000000 AS at_ns, CASE WHEN value >= 31.62 AND value < 1000 THEN CAST(CAST(round(value / 1000.0 * 1000.0, 0) AS BIGINT) AS VARCHAR) || 'ms' END AS took FROM ev")
def display_values(spark, sf_dir):
    df = datasets.event_logs(spark, sf_dir)
    v = F.col("fields")
    return df.select("seq", display.iso_ns(F.col("ts_ns")).alias("at"), display.as_i64(v["user_id"]).alias("user"), display.as_f64(v["value"]).alias("number"), display.as_bool(v["big"]).alias("big"), display.as_timestamp_ns(v["at"]).alias("at_ns"),
                     F.when((F.col("fields")["value"]["f"] >= 31.62) & (F.col("fields")["value"]["f"] < 1000), display.shown(v["elapsed"])).alias("took"))


@registered("q_fields", EVENTS + """, p AS (SELECT seq, 'n' AS key, 3 AS kind, CAST(event_id AS VARCHAR) AS v FROM ev UNION ALL SELECT seq, 'u', 3, CAST(user_id::HUGEINT + 9223372036854775808 AS VARCHAR) FROM ev
  UNION ALL SELECT seq, 'ok', 5, CAST(value > 100 AS VARCHAR) FROM ev UNION ALL SELECT seq, 'at', 8, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' FROM ev
  UNION ALL SELECT seq, 'raw', 2, hex(event_type) FROM ev UNION ALL SELECT seq, 'kind', 1, event_type FROM ev UNION ALL SELECT seq, 'none', 0, 'None' FROM ev WHERE k < 10
  UNION ALL SELECT seq, 'id', 6, regexp_replace(md5(CAST(event_id AS VARCHAR)), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') FROM ev)
  SELECT seq, key, kind, v FROM p""")
def fields(spark, sf_dir):
    """Every field as text; x and wait are left to q_display, since engines print floats in their own ways."""
    df = datasets.typed_logs(spark, sf_dir).select("seq", F.explode("fields").alias("key", "v")).where(~F.col("key").isin("x", "wait"))
    return df.select("seq", "key", F.col("v.kind").cast("int").alias("kind"), display.shown(F.col("v")).alias("v"))


_TYPED = "'" + _uuid("5") + "'"


@registered("q_dyn_uuid", EVENTS + f"SELECT seq FROM ev WHERE event_id = 5 OR regexp_replace(md5(CAST(event_id AS VARCHAR)), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5') = {_TYPED}")
def dyn_uuid(spark, sf_dir):
    return where(datasets.typed_logs(spark, sf_dir), f'id = "{_uuid("5")}" && id is Uuid').select("seq")


@registered("q_dyn_unsigned", EVENTS + "SELECT seq FROM ev WHERE user_id IN (2, 7)")
def dyn_unsigned(spark, sf_dir):
    """Numbers beyond the signed range."""
    return where(datasets.typed_logs(spark, sf_dir), "u = 9_223_372_036_854_775_815 || u = 0x8000000000000002").select("seq")


@registered("q_dyn_service", EVENTS + "SELECT seq FROM ev WHERE user_id % 3 = 0 OR user_id % 3 = 2 AND value > 50")
def dyn_service(spark, sf_dir):
    return where(datasets.typed_logs(spark, sf_dir), '$service = "api" || !($service = "web") && x > 50').select("seq")


@registered("q_pred_constant", EVENTS + "SELECT event_id FROM ev WHERE value > 50")
def pred_constant(spark, sf_dir):
    """True and false as predicates, from the empty query and a range that nothing satisfies."""
    df = datasets.events(spark, sf_dir)
    return where(where(df, ""), Or((FALSE, And((TRUE, parse("value > 50")))))).select("event_id")


@registered("q_ext_regex", EVENTS + "SELECT event_id FROM ev WHERE regexp_matches(event_type, '^(cl|VI)', 'i')")
def ext_regex(spark, sf_dir):
    return where(datasets.events(spark, sf_dir), Query.expr('event_type.matches_regex("^(cl|VI)", "i")', strict=False)).select("event_id")


@registered("q_ext_bits", EVENTS + "SELECT event_id FROM ev WHERE (user_id & 5) = 5 AND ts_ns > 1704800000000000000")
def ext_bits(spark, sf_dir):
    return where(datasets.events(spark, sf_dir), Query.expr("user_id & 5 = 5 && $timestamp > 1_704_800_000_000_000_000", strict=False)).select("event_id")


_WRONG = [("a is Nope", "UnknownType", 5, 9), ("a && 5", "NonPredicateExpression", 5, 6), ("a = 1 << 200", "InvalidShift", 6, 8)]


@registered("q_errors", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{k}', {a}, {b})" for t, k, a, b in _WRONG) + ") v(query, kind, start_at, end_at)")
def errors(spark, sf_dir):
    """What is wrong with a query, and where."""
    found = []
    for text, *_ in _WRONG:
        try:
            parse(text)
        except QueryParseError as e:
            found.append((text, e.kind, e.start, e.end))
    return spark.createDataFrame(found, "query string, kind string, start_at int, end_at int")


# spans

SPANS = """WITH RECURSIVE st AS (SELECT CAST(epoch_us(o_orderdate) AS BIGINT) * 1000 AS ts_ns, o_orderkey * 2 + 2 AS span_id, o_custkey * 2 + 1 AS parent, o_orderpriority AS message, o_totalprice AS amount FROM orders),
  ln AS (SELECT CAST(epoch_us(greatest(l_shipdate, o_orderdate)) AS BIGINT) * 1000 AS ts_ns, l_orderkey * 2 + 2 AS span_id, l_extendedprice AS amount, l_returnflag AS message FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  lg AS (SELECT ts_ns, span_id, 'orders' AS target, amount, message FROM st UNION ALL SELECT ts_ns, span_id, 'lineitem', amount, message FROM ln),
  sp AS (SELECT span_id, max(ts_ns) - min(ts_ns) AS duration, min(ts_ns) AS start_ns FROM lg GROUP BY span_id) """


@registered("q_span_table", SPANS + "SELECT sp.span_id, st.parent AS parent_span, start_ns AS start_ts_ns, duration AS span_duration_ns FROM sp JOIN st ON sp.span_id = st.span_id")
def span_table(spark, sf_dir):
    out = spans.span_table(datasets.span_logs(spark, sf_dir)).where("n_rows > 0")
    return out.select("span_id", "parent_span", "start_ts_ns", "span_duration_ns")


@registered("q_span_duration", SPANS + "SELECT span_id, target, count(*) AS n FROM lg JOIN sp USING (span_id) WHERE duration > 86400000000000 * 60 AND amount > 10000 GROUP BY 1, 2")
def span_duration(spark, sf_dir):
    found = where(datasets.span_logs(spark, sf_dir), "$span_duration > 60d && amount > 10_000")
    return found.groupBy("span_id", "target").agg(F.count("*").alias("n"))


@registered("q_span_parent", SPANS + "SELECT span_id, target, amount FROM lg WHERE span_id IN (SELECT span_id FROM st WHERE parent = 21)")
def span_parent(spark, sf_dir):
    return where(datasets.span_logs(spark, sf_dir), "$parent_span = 21 && $parent_span").select("span_id", "target", "amount")


@registered("q_span_is", SPANS + "SELECT span_id, target, amount FROM lg WHERE span_id = 42")
def span_is(spark, sf_dir):
    return where(datasets.span_logs(spark, sf_dir), "$span = 42 && $span").select("span_id", "target", "amount")


@registered("q_span_set", SPANS + "SELECT span_id, target, amount FROM lg WHERE span_id IN (4, 8, 100)")
def span_in_set(spark, sf_dir):
    return where(datasets.span_logs(spark, sf_dir), span_set([100, 4, 8])).select("span_id", "target", "amount")


@registered("q_span_expand", SPANS + "SELECT span_id, target, amount FROM lg WHERE span_id IN (SELECT span_id FROM lg WHERE target = 'lineitem' AND amount > 90000)")
def span_expand(spark, sf_dir):
    logs = datasets.span_logs(spark, sf_dir)
    return spans.expand_spans(logs, where(logs, 'target = "lineitem" && amount > 90_000')).select("span_id", "target", "amount")


_DEEP = EVENTS + ", hp AS (SELECT event_id + 1 AS span_id, CASE WHEN event_id + 1 >= 64 THEN (event_id + 1) // 2 END AS parent, ts_ns, ts_ns + CAST(floor(coalesce(value, 0) * 1000) AS BIGINT) * 1000 AS end_ns, level, event_id, CASE WHEN event_id + 1 < 64 THEN event_id + 1 ELSE (event_id + 1) >> (length(bin(event_id + 1)) - 6) END AS root FROM ev), hr AS (SELECT *, 2 * event_id AS seq, ts_ns AS moment FROM hp UNION ALL SELECT *, 2 * event_id + 1, end_ns FROM hp) "


@registered("q_span_grouped", _DEEP + """, m AS (SELECT span_id, max(seq) AS newest FROM hr WHERE level = 3 GROUP BY span_id)
  SELECT row_number() OVER (ORDER BY newest DESC, hr.span_id, seq DESC) AS place, hr.span_id, seq, newest FROM hr JOIN m ON hr.span_id = m.span_id""")
def span_grouped(spark, sf_dir):
    """With each row's place in the result's order, from partition offsets and the place within the partition."""
    out = spans.grouped_by_spans(datasets.deep_logs(spark, sf_dir), '$level = "error"').select("span_id", "seq", F.col("span_place.seq").alias("newest"))
    return with_place(out).select("place", "span_id", "seq", "newest")


@registered("q_span_first_record", SPANS + "SELECT lg.span_id, lg.target, lg.amount, st.message AS first_message FROM lg JOIN st ON lg.span_id = st.span_id WHERE lg.amount > 80000")
def span_first_record(spark, sf_dir):
    out = spans.with_first_record(datasets.span_logs(spark, sf_dir), ["message"])
    return where(out, "amount > 80_000").select("span_id", "target", "amount", "first_message")


@registered("q_span_ancestors", SPANS + "SELECT span_id, 1 AS depth, parent AS ancestor FROM st")
def span_ancestors(spark, sf_dir):
    return spans.ancestors(spans.span_table(datasets.span_logs(spark, sf_dir)), 4)


@registered("q_span_components", SPANS + "SELECT span_id, parent AS root FROM st UNION SELECT DISTINCT parent, parent FROM st")
def span_components(spark, sf_dir):
    return spans.components(spans.span_table(datasets.span_logs(spark, sf_dir)))


@registered("q_span_component", SPANS + ", c AS (SELECT parent FROM st WHERE span_id = 42) SELECT span_id FROM st WHERE parent = (SELECT parent FROM c) UNION SELECT parent FROM c")
def span_component(spark, sf_dir):
    return spans.component(spans.span_table(datasets.span_logs(spark, sf_dir)), 42)


@registered("q_span_context", SPANS + "SELECT span_id, target, amount FROM lg WHERE span_id IN (SELECT span_id FROM st WHERE parent = (SELECT parent FROM st WHERE span_id = 42))")
def span_context(spark, sf_dir):
    logs = datasets.span_logs(spark, sf_dir)
    return spans.context(logs, spans.span_table(logs), 42).select("span_id", "target", "amount")


@registered("q_span_latency", SPANS + """SELECT message, count(*) AS n, quantile_disc(duration, 0.5) AS p50, quantile_disc(duration, 0.9) AS p90, quantile_disc(duration, 0.99) AS p99
  FROM st JOIN sp USING (span_id) GROUP BY message""")
def span_latency(spark, sf_dir):
    """Exact percentiles, found digit by digit."""
    out = aggregates.span_latency(datasets.span_logs(spark, sf_dir), "message")
    return out.select("message", "n", *[F.col("duration_ns")[i].alias(c) for i, c in enumerate(("p50", "p90", "p99"))])


# deep forest


@registered("q_deep_ancestors", _DEEP + "SELECT span_id, CAST(d AS INTEGER) AS depth, span_id >> CAST(d AS BIGINT) AS ancestor FROM hp, range(1, 9) t(d) WHERE span_id >> CAST(d - 1 AS BIGINT) >= 64")
def deep_ancestors(spark, sf_dir):
    """Up to eight levels above every span."""
    return spans.ancestors(spans.span_table(datasets.deep_logs(spark, sf_dir)))


@registered("q_deep_components", _DEEP + "SELECT span_id, root FROM hp")
def deep_components(spark, sf_dir):
    return spans.components(spans.span_table(datasets.deep_logs(spark, sf_dir)))


@registered("q_deep_context", _DEEP + "SELECT span_id, seq, moment AS ts_ns FROM hr WHERE root = 43")
def deep_context(spark, sf_dir):
    logs = datasets.deep_logs(spark, sf_dir)
    return spans.context(logs, spans.span_table(logs), 700).select("span_id", "seq", "ts_ns")


@registered("q_deep_growth", _DEEP + "SELECT span_id FROM hp WHERE root = 43")
def deep_growth(spark, sf_dir):
    """The component among the spans before number 500, then grown by all later ones at once."""
    table = spans.span_table(datasets.deep_logs(spark, sf_dir)).select("span_id", "parent_span")
    old = spans.component(table.where("span_id < 500"), 43)
    return spans.extend_component(old, table.where("span_id >= 500"))


@registered("q_deep_duration", _DEEP + "SELECT seq FROM hr WHERE end_ns - ts_ns > 100000000")
def deep_duration(spark, sf_dir):
    return where(datasets.deep_logs(spark, sf_dir), "$span_duration > 100ms").select("seq")


@registered("q_deep_span_logs", _DEEP + "SELECT seq, moment AS ts_ns FROM hr WHERE span_id = 700")
def deep_span_logs(spark, sf_dir):
    return spans.span_logs(datasets.deep_logs(spark, sf_dir), 700).select("seq", "ts_ns")


# more scans


@registered("q_scan_both_ways", EVENTS + "SELECT seq, 'back' AS way FROM ev WHERE value > 50")
def scan_both_ways(spark, sf_dir):
    """Split at the last row: all that is there goes backwards, nothing is ahead yet."""
    back, ahead = scans.bidirectional(datasets.events(spark, sf_dir), "value > 50")
    return back.select("seq", F.lit("back").alias("way")).unionAll(ahead.select("seq", F.lit("ahead").alias("way")))


@registered("q_scan_callback", EVENTS + "SELECT seq FROM ev WHERE value > 50 ORDER BY seq DESC LIMIT 50")
def scan_callback(spark, sf_dir):
    """The feature is that the callback ends the scan, here after fifty rows."""
    seen: list[tuple[int]] = []
    scans.each(datasets.events(spark, sf_dir), "value > 50", lambda r: seen.append((r["seq"],)) or len(seen) < 50)
    return spark.createDataFrame(seen, "seq long")


@registered("q_scan_iterate", "SELECT n_nationkey AS seq, n_name AS name, row_number() OVER (ORDER BY n_nationkey DESC) - 1 AS place FROM nation")
def scan_iterate(spark, sf_dir):
    """Rows one by one, newest first, over a table that is small by nature."""
    nation = datasets.table(spark, sf_dir, "nation").select(F.lit(0).alias("generation"), F.col("n_nationkey").cast("long").alias("seq"), "n_name")
    rows = [(r["seq"], r["n_name"], i) for i, r in enumerate(scans.iterate(nation, newest_first=True))]
    return spark.createDataFrame(rows, "seq long, name string, place long")


def with_place(df: DataFrame) -> DataFrame:
    """Adds ``place`` from 1 in the order of a sorted table: partitions are counted, never gathered."""
    numbered = materialise(df.withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    offset, offsets = 0, []
    for row in numbered.groupBy(part.alias("p")).count().orderBy("p").collect():  # one row per partition
        offsets.append((row["p"], offset))
        offset += row["count"]
    if not offsets:
        return numbered.withColumn("place", F.lit(0).cast("long")).drop("__m")
    start = F.element_at(F.create_map(*[F.lit(int(x)) for pair in offsets for x in pair]), part)
    return numbered.withColumn("place", start + F.col("__m").bitwiseAND((1 << 33) - 1) + 1).drop("__m")


def queries() -> dict[str, Run]:
    from emberlog.plans import roundtrips  # noqa: F401  registers on import

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
