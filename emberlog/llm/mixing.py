"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words: its weight's share of ``share`` times all words, stopped at
``cap`` times its own words, the excess reshared by weight until no target is above its cap.  Every
document is taken ``floor(target / source words)`` times for certain.  What is left of the target is
filled by Pareto order sampling with unequal probabilities.

Inclusion.  A document's probability is proportional to the number of binary digits of its size
(``digits``), so long documents are likelier, by far less than they are longer; one digit counts for
empty ones.  The factor makes the expected words the words left.  Where that would be 1 or more, the
document is certain and the factor is taken anew for the rest, as sampling with fixed size demands.

Order.  Documents are ranked by random odds over inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``,
certain ones first, and taken in that order while they fit into the words left.  A second pass of the
same kind fills the gap before the first document that was too large, among later documents no
larger than the gap, and takes the next one as well when that brings the sum nearer.

``u`` comes from the MD5 of the id as text (null: empty) and the seed, so reruns agree.  Rows equal
in id and size are exchangeable; ties in rank are broken by id and size, and rows equal in those by
a number that is not part of the result.  Sizes are words, runs of anything but ASCII white space; a
null text has none, and texts of any length are counted whole.  A null source is a source of its own,
ordered last.  Sources without words get target 0.  An empty table gives an empty result.  Columns of
any name may be carried along.

The running sums over a source are taken in two levels, over intervals of the rank's logarithm and
then within the one interval where the target falls, so no task ever sorts a whole source.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_values, lookup, materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Intervals per unit of the rank's logarithm; one holds at most about one row in 4 x BINS.
BINS = 1 << 13
#: Below the interval of any rank: where certain documents stand.
CERTAIN = -(1 << 40)
SEED = "mix-1"


def _sizes(text: str, extra: list[str]):
    def run(batches):
        for b in batches:
            sizes = [len(x.split()) for x in byte_values(b.column(b.schema.get_field_index(text)))]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in extra], pa.array(sizes, pa.int64())], names=[*extra, "size"])

    return run


def uniform(id_: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 from 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """From (key, source, source_size, docs): adds target.  Rank of a source is its place by code point, null last.

    The place is found from a range-partitioned sort and a count per partition; the resharing runs
    on sums alone.  Neither gathers the sources.
    """
    placed = materialise(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn("__m", F.monotonically_increasing_id())
    ).withColumn("__p", F.shiftright("__m", 33))
    offset, offsets = 0, {}
    for row in placed.groupBy("__p").count().orderBy("__p").collect():  # one row per partition
        offsets[row["__p"]], offset = offset, offset + row["count"]
    start = F.element_at(F.create_map(*[F.lit(int(x)) for kv in offsets.items() for x in kv]), F.col("__p")) if offsets else F.lit(0)
    place = start + F.col("__m").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rated = placed.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap).drop("__m", "__p")
    rated = materialise(rated.withColumn("turn", F.col("most") / F.col("weight")))
    wanted = share * (rated.agg(F.sum("source_size")).first()[0] or 0)
    level = wanted / (rated.agg(F.sum("weight")).first()[0] or 1.0)
    while True:  # a source is capped while its cap is below level x weight; the level only rises
        row = rated.agg(
            F.sum(F.when(F.col("turn") <= level, F.col("most")).otherwise(0.0)),
            F.sum(F.when(F.col("turn") > level, F.col("weight"))),
        ).first()
        if not row[1]:
            level = float("inf")
            break
        after = (wanted - row[0]) / row[1]
        if after <= level * (1 + 1e-12):
            break
        level = after
    return rated.withColumn("target", F.least("most", F.lit(level) * F.col("weight"))).drop("weight", "most", "turn")


def digits(size: Column) -> Column:
    """Binary digits of a size, one at least: the measure of inclusion."""
    return F.length(F.bin(size))


def inclusion() -> Column:
    """A document's probability from the columns factor and digits, which has no factor where all are certain."""
    return F.coalesce(F.least(F.greatest(F.col("factor") * F.col("digits"), F.lit(1e-9)), F.lit(1.0)), F.lit(1.0))


def factors(each: DataFrame, goals: DataFrame) -> DataFrame:
    """Per key the factor of the inclusion probabilities: goals with ``factor``.

    Words are added up per number of digits, at most 63 of them.  The longest texts are certain from
    the top down until the factor of the rest leaves none at 1 or more.
    """
    sums = each.groupBy("key", "digits").agg(F.sum("size").alias("words")).join(goals.select("key", "goal"), "key")
    down = Window.partitionBy("key").orderBy(F.col("digits").desc())
    sums = sums.withColumn("above", F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("rest", F.sum(F.col("digits") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing)))
    sums = sums.withColumn("factor", (F.col("goal") - F.col("above")) / F.when(F.col("rest") > 0, F.col("rest")))
    fits = sums.where(F.col("factor") * F.col("digits") < 1).groupBy("key").agg(F.max_by("factor", "digits").alias("factor"))
    return goals.join(fits, "key", "left")


def _cut(rows: DataFrame, goals: DataFrame, nearest: bool) -> DataFrame:
    """Per key, take rows in rank order while their sizes fit ``goal``.

    Rows: key, id, size, q, bin, tie.  Goals: key, goal, docs.  Returns per key the first row that does
    not fit (``edge``, null when all fit), the words left before it, and whether it is taken as well.
    """
    bins = rows.groupBy("key", "bin").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = bins.withColumn("before", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
    # the interval in which the goal falls: the first that does not fit as a whole
    falls = (
        before.join(goals, "key")
        .where(F.col("before") + F.col("words") > F.col("goal"))
        .groupBy("key")
        .agg(F.min("bin").alias("bin"), F.min_by("before", "bin").alias("before"), F.first("goal").alias("goal"))
    )
    # goals without such an interval take every row
    at = rows.join(falls, ["key", "bin"])
    order = [F.col("q"), F.col("id"), F.col("size"), F.col("tie")]
    run = Window.partitionBy("key").orderBy(*order)
    summed = at.withColumn("through", F.col("before") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    over = F.col("through") > F.col("goal")
    gain = F.col("through") - F.col("goal") < F.col("goal") - (F.col("through") - F.col("size"))
    first = (
        summed.where(over)
        .groupBy("key")
        .agg(
            F.min(F.struct("q", "id", "size", "tie")).alias("edge"),
            F.min_by(F.struct((F.col("goal") - F.col("through") + F.col("size")).alias("left"), gain.alias("gain")), F.struct("q", "id", "size", "tie")).alias("rest"),
        )
    )
    return goals.join(first, "key", "left").select(
        "key", "edge", F.col("rest.left").alias("left"), (F.col("rest.gain") & F.lit(nearest)).alias("gain"), "docs"
    )


def mix(
    docs: DataFrame,
    text: str = "text",
    id_: str = "doc_id",
    source: str = "source",
    *,
    weights=WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: str = SEED,
    extra: list[str] | None = None,
) -> DataFrame:
    """Per document: id, size, source_size, target, p, copies, taken (size x copies) and columns ``extra``.

    ``p`` is the probability of one more copy than the certain ones.
    """
    extra = extra or []
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    narrow = docs.select(id_, source, text, *extra).mapInArrow(
        _sizes(text, [id_, source, *extra]), ", ".join([*(f"`{c}` {kinds[c]}" for c in [id_, source, *extra]), "size long"])
    )
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    renamed = narrow.select(F.col(id_).alias("id"), F.col(source).alias("source"), "size", *[F.col(c).alias(f"x_{c}") for c in extra])
    renamed = renamed.withColumn("key", key).withColumn("tie", F.monotonically_increasing_id())
    each = materialise(renamed.withColumn("u", uniform(F.col("id"), seed)).withColumn("digits", digits(F.col("size"))))
    total = each.count()
    per = each.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goals = targets(per, weights, share, cap)
    ratio = F.col("target") / F.greatest("source_size", F.lit(1))
    goals = goals.withColumn("sure", F.floor(ratio)).withColumn("goal", F.col("target") - F.col("sure") * F.col("source_size"))
    goals = materialise(factors(each, goals.select("key", "source_size", "target", "docs", "sure", "goal")))
    rated = lookup(each, goals, "key", "docs", F.col("tie"), total).withColumn("p", inclusion())
    rated = rated.withColumn("q", F.when(F.col("p") >= 1, F.lit(0.0)).otherwise((F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
    # the logarithm is monotone, so its intervals are intervals of the rank
    place = F.when(F.col("q") > 0, F.floor(F.log(F.when(F.col("q") > 0, F.col("q"))) * BINS)).otherwise(F.lit(CERTAIN))
    rated = materialise(rated.withColumn("bin", place).drop("sure", "docs", "factor", "digits"))
    body = rated.select("key", "id", "size", "q", "bin", "tie")
    one = materialise(_cut(body, goals.select("key", "goal", "docs"), False))
    rank = F.struct("q", "id", "size", "tie")
    seen = lookup(body, one, "key", "docs", F.col("tie"), total)
    later = seen.where(F.col("edge").isNotNull() & (rank > F.col("edge")) & (F.col("size") <= F.col("left")) & (F.col("size") > 0))
    two = materialise(
        _cut(later.select(*body.columns), one.where(F.col("left") > 0).select("key", F.col("left").alias("goal"), "docs"), True).select(
            "key", F.col("edge").alias("edge2"), "gain", F.lit(True).alias("again")
        )
    )
    final = goals.select("key", "docs", "sure").join(one.select("key", "edge", "left"), "key", "left").join(two, "key", "left")
    out = lookup(rated, final, "key", "docs", F.col("tie"), total)
    first = F.col("edge").isNull() | (rank < F.col("edge"))
    fits = F.col("again") & (rank > F.col("edge")) & (F.col("size") <= F.col("left")) & (F.col("size") > 0)
    second = fits & (F.col("edge2").isNull() | (rank < F.col("edge2")) | (F.col("gain") & (rank == F.col("edge2"))))
    drawn = F.when(F.col("goal") <= 0, F.lit(False)).otherwise(F.coalesce(first | second, F.lit(False)))
    copies = F.col("sure") + drawn.cast("long")
    return out.select(
        F.col("id").alias(id_), "size", "source_size", "target", F.when(F.col("goal") > 0, F.col("p")).otherwise(F.lit(0.0)).alias("p"), copies.alias("copies"), (F.col("size") * copies).alias("taken"), *[F.col(f"x_{c}").alias(c) for c in extra]
    )


def resample(docs: DataFrame, text: str = "text", id_: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mixed corpus: each row repeated as often as the mix takes it, columns unchanged.

    Rows that agree in all columns are exchangeable; rows that differ in any are decided one by one.
    """
    slots = [f"c{i}" for i in range(len(docs.columns))]
    keyed = docs.toDF(*slots)
    at = {c: s for c, s in zip(docs.columns, slots)}
    values = [F.to_json(F.struct(s)) if "map<" in kind else F.col(s) for s, kind in keyed.dtypes]
    # nulls leave a hash as it was, so they are told apart beside it
    nulls = F.concat(*[F.when(F.col(s).isNull(), "1").otherwise("0") for s in slots])
    keyed = keyed.withColumn("row", F.concat_ws(":", nulls, F.xxhash64(*values), F.xxhash64(F.lit(SEED), *values)))
    decided = mix(keyed, at[text], at[id_], at[source], extra=["row"], **options)
    # of equal rows one stands for all and is repeated as often as they are taken
    each = materialise(decided.groupBy("row").agg(F.count("*").alias("rows"), F.sum("copies").alias("copies")))
    found = lookup(keyed, each, "row", "rows", F.rand(1)).where("copies > 0")
    single = found.where("rows = 1").select(*slots, "copies")
    repeated = found.where("rows > 1").groupBy("row").agg(F.first(F.struct(*slots)).alias("one"), F.first("copies").alias("copies"))
    rows = single.unionByName(repeated.select("one.*", "copies"))
    return rows.withColumn("i", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*slots).toDF(*docs.columns)
