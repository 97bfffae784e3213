"""Each query and its negation over tagged fields: exact complements, and what a row interpreter says."""

from __future__ import annotations

import random
import uuid

import pytest
from interpreter import holds

from emberlog.functions.model import Duration, Stamp, logs, record
from emberlog.operators.filters import where
from emberlog.plans.parser import parse
from emberlog.plans.predicates import And, Leaf, Or, invert

U = uuid.UUID("123e4567-e89b-12d3-a456-426614174000")
VALUES = [
    None, True, False, 0, 1, 3, -5, 2**59, -(2**60), 2**63 - 1, 2**64 - 1, 0.0, 3.0, 1.5, -2.25, float("inf"), float("-inf"), float("nan"), 1.7e308,
    "", "alpha", "beta", "3", "Ünï", str(U), b"alpha", b"\xff", U, Duration(0.0), Duration(2.5), Duration(-1.0), Stamp(1_748_048_686_000), Stamp(0),
]
QUERIES = [
    "x", "x.exists()", 'x = "alpha"', 'x in ["alpha", 3, 1.5, null]', 'x.contains("a")', 'x.starts_with("al")', 'x.ends_with("a")', 'x = b"alpha"', "x = 3", "x = 18446744073709551615",
    "x = 3.0", "x < 3", "x <= 3", "x > 3", "x >= 3", "x > -1.5", "x < 1.5 && x > 0", "x > 2s", "x <= 2500ms", "x = 0s", "x = true", "x = false", "x = null", "x is Null", "x is String",
    "x is Bytes", "x is Integer", "x is Float", "x is Number", "x is UUID", "x is Bool", "x is Duration", "x is Timestamp", "x.is_finite()", f'x = "{str(U).upper()}"',
    'x in time_range("2025-05-24")', 'x in time_range("1970")', "x < 5 || x > 10", "x != 1 && x != 2", 'x is Float || x = "beta"', "x >= 9223372036854775807", "x > 1e308", "nosuch", "nosuch = 1",
    '$level = "error"', '$level in ["info","warn"]', '$message.contains("hit")', 'msg = "hit 3"', 'target.starts_with("app")', '$target in ["", "app::a"]', "$span", "$span = 7", "$service",
    '$service = "s1"', '$service.ends_with("2")', "$timestamp = 5", '$timestamp in time_range("1970-01-01T00:00:00Z")', '$level = "error" || x || msg.contains("1")',
]


@pytest.fixture(scope="module")
def data(spark):
    rows, plain = [], []
    for i, v in enumerate([*VALUES, "missing"]):
        fields = {} if v == "missing" else {"x": v}
        service = (None, "s1", "s2")[i % 3]
        target = ("", "app::a", "app::b")[i % 3]
        rows.append(record(i, i, i % 4, service=service, msg=f"hit {i}", target=target, **fields))
        own = {"$level": i % 4, "$message": f"hit {i}", "$target": target, "$timestamp": i} | fields
        plain.append(own | ({"$service": service} if service else {}))
    return logs(spark, rows).cache(), plain


def expected(p, plain: list[dict]) -> list[int]:
    def one(p, row):
        if isinstance(p, (And, Or)):
            return (all if isinstance(p, And) else any)(one(x, row) for x in p.items)
        if isinstance(p, Leaf) and p.subject == "$timestamp":
            return (p.arg[0] <= row["$timestamp"] <= p.arg[1]) != p.negated
        return holds(p, row)

    return [i for i, row in enumerate(plain) if one(p, row)]


@pytest.mark.parametrize("text", QUERIES)
def test_query_and_complement(data, text):
    df, plain = data
    p = parse(text)
    both = [sorted(r["seq"] for r in where(df, q).select("seq").collect()) for q in (p, invert(p))]
    assert both[0] == expected(p, plain)
    assert sorted(both[0] + both[1]) == list(range(len(plain)))


def test_random_predicates(data):
    """Many predicates in one pass: each is a column beside the rows."""
    from emberlog.functions.binding import DynamicBinding, compile_predicate

    df, plain = data
    rng = random.Random(11)
    leaves = [parse(q) for q in QUERIES if not q.startswith("$timestamp")]

    def tree(depth: int):
        if depth == 0 or rng.random() < 0.3:
            p = rng.choice(leaves)
            return invert(p) if rng.random() < 0.5 else p
        return (And if rng.random() < 0.5 else Or)((tree(depth - 1), tree(depth - 1)))

    trees = [tree(3) for _ in range(60)]
    binding = DynamicBinding(df)
    got = df.select("seq", *[compile_predicate(p, binding).alias(f"p{i}") for i, p in enumerate(trees)]).orderBy("seq").collect()
    for i, p in enumerate(trees):
        assert [r["seq"] for r in got if r[f"p{i}"]] == expected(p, plain)


def test_typed_columns(spark):
    from emberlog.functions.binding import TypedBinding, compile_predicate

    df = spark.sql(
        "SELECT * FROM VALUES (0, 1, 1.5D, 'a', true, timestamp_ntz'2025-05-24 01:04:46', date'2025-05-24', X'61'), (1, NULL, NULL, NULL, NULL, NULL, NULL, NULL),"
        " (2, 7, double('NaN'), 'b', false, timestamp_ntz'2024-01-01 00:00:00', date'2024-01-01', X'62'), (3, -4, double('Infinity'), 'ab', true, NULL, NULL, NULL)"
        " AS t(seq, n, f, s, b, t, d, raw)"
    )
    cases = {
        "n > 0.5": [0, 2], "n < 2.5 && n > -4": [0], "n = 1.0": [0], "n = 1.5": [], "f > 0": [0], "!(f > 0)": [1, 2, 3], "f = 1.5": [0], "f = 1": [], 'f.is_finite()': [0], 's in ["a","b"]': [0, 2],
        "s != 1": [0, 1, 2, 3], "b = true": [0, 3], "b = false": [1, 2], 't in time_range("2025-05")': [0], '!(t in time_range("2025"))': [1, 2, 3], 'd in time_range("2025-05-24")': [0],
        'd in time_range("2025-05-24T01")': [], 'raw = b"a"': [0], 's = b"a"': [0], "n is Integer": [0, 2, 3], "f is Float && !(f is Integer)": [0, 2, 3], "s is Null": [], "nosuch || s": [0, 2, 3],
    }
    binding = TypedBinding(df)
    for text, want in cases.items():
        got = [r[0] for r in df.where(compile_predicate(parse(text), binding)).select("seq").orderBy("seq").collect()]
        assert got == want, text


def test_positive_tests_reach_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = where(df, 'user_id > 3.5 && event_type = "click" && ts in time_range("2024-01-05")')._jdf.queryExecution().executedPlan().toString()
    for part in ("GreaterThanOrEqual(user_id,4)", "EqualTo(event_type,click)", "GreaterThanOrEqual(ts,"):
        assert part in plan
