"""Values and times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.model import KIND


def whole(x: Column, unit: int) -> Column:
    """Whole units in a long, rounded down; a division by ``/`` would go through a double."""
    return F.call_function("div", x - F.pmod(x, F.lit(unit)), F.lit(unit))


def iso_ns(ns: Column) -> Column:
    """A nanosecond timestamp as ISO text in UTC with nine fractional digits."""
    whole_ = F.date_format(F.timestamp_seconds(whole(ns, 10**9)), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole_, F.lit("."), F.lpad(F.pmod(ns, F.lit(10**9)).cast("string"), 9, "0"), F.lit("Z"))


def iso_ms(ms: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def seconds(v: Column) -> Column:
    """A duration with two significant digits or more, in the unit that fits: s, ms, µs or ns."""
    size = F.abs(v)

    def shown(factor: float, unit: str) -> Column:
        x = v * factor
        digits = F.when(F.abs(x) < 3.162, F.format_string("%.2f", x)).when(F.abs(x) < 31.62, F.format_string("%.1f", x)).otherwise(F.format_string("%.0f", x))
        return F.concat(digits, F.lit(unit))

    return (
        F.when(size == 0, F.lit("0ns"))
        .when(size < 1e-6, F.concat(F.format_string("%.0f", v * 1e9), F.lit("ns")))
        .when(size < 1e-3, shown(1e6, "µs"))
        .when(size < 1.0, shown(1e3, "ms"))
        .otherwise(shown(1.0, "s"))
    )


def shown(v: Column) -> Column:
    """A tagged value as text."""
    kind = v["kind"]
    return (
        F.when(kind == KIND["null"], F.lit("None"))
        .when(kind == KIND["bytes"], F.hex(v["b"]))
        .when(kind == KIND["int"], v["i"].cast("string"))
        .when(kind == KIND["float"], v["f"].cast("string"))
        .when(kind == KIND["bool"], (v["i"] == 1).cast("string"))
        .when(kind == KIND["duration"], seconds(v["f"]))
        .when(kind == KIND["timestamp"], iso_ms(v["i"].cast("long")))
        .otherwise(v["s"])
    )


def as_f64(v: Column) -> Column:
    """A number as double; NULL for other kinds."""
    return F.when(v["kind"] == KIND["float"], v["f"]).when(v["kind"] == KIND["int"], v["i"].cast("double"))


def as_i64(v: Column) -> Column:
    return F.when(v["kind"] == KIND["int"], v["i"].try_cast("long"))


def as_bool(v: Column) -> Column:
    return F.when(v["kind"] == KIND["bool"], v["i"] == 1)


def as_timestamp_ns(v: Column) -> Column:
    return F.when(v["kind"] == KIND["timestamp"], v["i"].cast("long") * 10**6)
