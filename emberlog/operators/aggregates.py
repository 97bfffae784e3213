"""Counts by up to four keys, and summaries of targets, keys and storage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.binding import kind_of
from emberlog.functions.model import KIND
from emberlog.operators.filters import where
from emberlog.shared import materialise

MAX_KEYS = 4
#: A key's values are listed only when there are fewer than this, each at most SMALL_BYTES long.
FEW_VALUES = 32
SMALL_BYTES = 48


@dataclass(frozen=True)
class Key:
    """A source of group keys: field, missing, target, message or level."""

    source: str
    name: str = ""

    @staticmethod
    def field(name: str) -> Key:
        return Key("field", name)

    def column(self, df: DataFrame) -> Column:
        if self.source == "field":
            if "fields" in df.columns and dict(df.dtypes)["fields"].startswith("map<"):
                v = F.col("fields")[self.name]
                # an explicit null groups with a missing key
                return F.when(v["kind"] != KIND["null"], v)
            return F.col(f"`{self.name}`") if self.name in df.columns else F.lit(None).cast("string")
        if self.source == "missing":
            return F.lit(None).cast("string")
        return F.col(self.source)


def as_key(k: Key | str) -> Key:
    if isinstance(k, Key):
        return k
    return Key(k[1:]) if k in ("$target", "$message", "$level") else Key.field(k)


def with_keys(df: DataFrame, keys: Sequence[Key | str], query=None) -> DataFrame:
    """Matches with their keys k1..k4; keys beyond the fourth are left out."""
    found = where(df, query)
    return found.select(*found.columns, *[as_key(k).column(found).alias(f"k{i}") for i, k in enumerate(keys[:MAX_KEYS], 1)])


def group_count(df: DataFrame, keys: Sequence[Key | str], query=None) -> DataFrame:
    """Matches counted by their keys; a missing key is a group of its own, and kinds keep values apart."""
    names = [f"k{i}" for i in range(1, min(len(keys), MAX_KEYS) + 1)]
    return with_keys(df, keys, query).groupBy(*names).agg(F.count("*").alias("n"))


def targets_summary(df: DataFrame) -> DataFrame:
    """Per target: counts of the four levels."""
    return df.groupBy("target").agg(*[F.count_if(F.col("level") == i).alias(name) for i, name in enumerate(("debug", "info", "warn", "error"))])


def display(v: Column) -> Column:
    """A tagged value as text, for listing values."""
    return F.coalesce(
        v["s"], F.hex(v["b"]), F.when(v["kind"] == KIND["bool"], (v["i"] == 1).cast("string")), v["i"].cast("string"), v["f"].cast("string"), F.lit("None")
    )


def keys_summary(df: DataFrame) -> DataFrame:
    """Per key: total, kind_mask and, when few and small, the sorted distinct values.

    Values are counted in one shuffle.  Of each key at most ``FEW_VALUES`` go on to be listed, and tasks
    drop the others before they travel, so no list and no task grows with a key's distinct values.
    """
    if "fields" in df.columns:
        # outer, since a plain explode makes the optimizer build the fields once more to see whether there are any
        pairs = df.select(F.explode_outer("fields").alias("key", "v")).where(F.col("key").isNotNull()).select("key", F.col("v.kind").alias("kind"), display(F.col("v")).alias("value"))
    else:
        names = [f.name for f in df.schema if kind_of(f.dataType)]
        kinds = {f.name: KIND[kind_of(f.dataType)] for f in df.schema if f.name in names}
        each = [F.struct(F.lit(n).alias("key"), F.lit(kinds[n]).cast("byte").alias("kind"), F.col(f"`{n}`").cast("string").alias("value")) for n in names]
        pairs = df.select(F.explode(F.array(*each)).alias("p")).select("p.*").where(F.col("value").isNotNull())
    counted = pairs.groupBy("key", "kind", "value").agg(F.count("*").alias("n"))
    per = counted.groupBy("key").agg(
        F.sum("n").alias("total"),
        F.bit_or(F.expr("shiftleft(1, cast(kind AS int))")).alias("kind_mask"),
        F.count("*").alias("n_values"),
    )
    # n is read here too, so that both branches are the same exchange
    place = F.row_number().over(Window.partitionBy("key").orderBy("value", "kind", "n"))
    first = counted.where(F.col("n") > 0).withColumn("place", place).where(F.col("place") <= FEW_VALUES)
    small = F.octet_length("value") <= SMALL_BYTES
    listed = first.groupBy("key").agg(F.array_sort(F.collect_set(F.when(small, F.col("value")))).alias("listed"))
    values = F.when((F.col("n_values") < FEW_VALUES) & (F.size("listed") > 0), F.col("listed"))
    return per.join(listed, "key", "left").select("key", "total", "kind_mask", "n_values", values.alias("values"))


def storage_stats(df: DataFrame) -> dict[str, float]:
    """Rows, bytes and bytes a row as the optimizer has them for the table read."""
    rows = df.count()
    size = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return {"rows": rows, "bytes": size, "bytes_per_row": size / rows if rows else 0.0}


def entry_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("generation").agg(F.count("*").alias("n"))


def span_latency(df: DataFrame, by: str, percentiles: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Exact percentiles of span durations by a column of the span's first record."""
    from emberlog.operators.spans import span_table, with_first_record

    firsts = with_first_record(df, [by]).where(F.col("span_id").isNotNull()).groupBy("span_id").agg(F.first(f"first_{by}").alias(by))
    spans = span_table(df).where("n_rows > 0").select("span_id", "span_duration_ns")
    joined = firsts.join(spans, "span_id")
    return discrete_percentiles(joined, by, "span_duration_ns", percentiles).withColumnRenamed("values", "duration_ns")


#: Bits of a value that are settled in one round.
DIGIT_BITS = 16


def discrete_percentiles(df: DataFrame, by: str, value: str, percentiles: Sequence[float]) -> DataFrame:
    """(by, n, values): per group the smallest values that a share of the group's rows does not exceed.

    Equal values are counted once for all.  Then the value at each rank is found digit by digit, from the
    highest: a round counts the rows by their next digit, so no task holds or sorts a group.  Nulls count
    in ``n`` only.
    """
    counted = materialise(df.groupBy(F.col(by).alias("__by"), F.col(value).cast("long").alias("__v")).agg(F.count("*").alias("__n")))
    totals = materialise(counted.groupBy("__by").agg(F.sum("__n").alias("n"), F.sum(F.when(F.col("__v").isNotNull(), F.col("__n"))).alias("__rows")))
    # shares are decimals: a product of doubles can pass a whole number
    shares = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(Decimal(str(p))).cast("decimal(18,17)").alias("share")) for i, p in enumerate(percentiles)])
    wanted = totals.where(F.col("__rows").isNotNull()).select("__by", "__rows", F.explode(shares).alias("s"))
    rank = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("__rows").cast("decimal(19,0)") * F.col("s.share")).cast("long"))
    wanted = wanted.select(F.col("__by").alias("__of"), F.col("s.at").alias("__at"), rank.alias("__rank"), F.lit(0).cast("long").alias("__high"))
    # with the sign turned, the order of values is that of their bits
    left = counted.where(F.col("__v").isNotNull()).select("__by", F.col("__v").bitwiseXOR(F.lit(-(2**63))).alias("__v"), "__n")
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        above = F.lit(0).cast("long") if shift + DIGIT_BITS == 64 else F.shiftrightunsigned("__v", shift + DIGIT_BITS)
        digits = left.groupBy("__by", above.alias("__up"), F.shiftrightunsigned("__v", shift).bitwiseAND(F.lit(2**DIGIT_BITS - 1)).alias("__digit")).agg(F.sum("__n").alias("__n"))
        met = digits.join(wanted, F.col("__by").eqNullSafe(F.col("__of")) & (F.col("__up") == F.col("__high")))
        within = Window.partitionBy("__of", "__at").orderBy("__digit")
        summed = met.withColumn("__sum", F.sum("__n").over(within))
        found = summed.where((F.col("__sum") >= F.col("__rank")) & (F.col("__sum") - F.col("__n") < F.col("__rank")))
        wanted = materialise(
            found.select("__of", "__at", (F.col("__rank") - F.col("__sum") + F.col("__n")).alias("__rank"), F.shiftleft("__high", DIGIT_BITS).bitwiseOR(F.col("__digit")).alias("__high"))
        )
    value_ = F.struct("__at", F.col("__high").bitwiseXOR(F.lit(-(2**63))).alias("v"))
    settled = wanted.groupBy("__of").agg(F.transform(F.array_sort(F.collect_list(value_)), lambda x: x["v"]).alias("values"))
    return totals.join(settled, F.col("__by").eqNullSafe(F.col("__of")), "left").select(F.col("__by").alias(by), "n", "values")
