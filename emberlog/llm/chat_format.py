"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role form one
block of the output, its texts parted by a mark so that every turn can be read back; all is then
concatenated.  Template of a block:

    <|turn ROLE|>\\nTEXT<|next|>TEXT<|end|>\\n

Inside texts and roles a backslash becomes two, ``<|`` becomes ``<\\|`` and ``|>`` becomes ``|\\>``, so
no text can hold a mark, and dropping the first backslash of each pair reverses it.

Null texts and roles count as empty; turns sort by (turn, role, text), null turns first, so ties and
repeated rows have one order; rows of a null conversation form one conversation.  The loss mask is a
list of (start, length) in code points, one for every assistant text, empty ones included.  A
conversation is one row of the result, as its method demands; the collected structs carry the three
columns needed and no others, and the work is about linear in a conversation's turns.  Texts of any
length are kept whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, CLOSE, NEXT, END = "<|turn ", "|>\n", "<|next|>", "<|end|>\n"
LOSS_ROLE = "assistant"
#: Turns whose spans are gathered into one array at a time.
BLOCK = 256


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("|>"), F.lit("|\\>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|>])", "$1")


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Per conversation: id, formatted, loss_spans."""
    one = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    sorted_ = turns.groupBy(F.col(conv).alias("conv")).agg(F.array_sort(F.collect_list(one)).alias("turns"))

    def part(t: Column, i: Column) -> Column:
        before = F.get(F.col("turns"), i - 1)["role"]
        after = F.get(F.col("turns"), i + 1)["role"]
        opens = F.when(before.eqNullSafe(t["role"]), F.lit(NEXT)).otherwise(F.concat(F.lit(BEGIN), escape(t["role"]), F.lit(CLOSE)))
        closes = F.when(after.eqNullSafe(t["role"]), F.lit("")).otherwise(F.lit(END))
        return F.struct(opens.alias("opens"), escape(t["text"]).alias("text"), closes.alias("closes"), (t["role"] == LOSS_ROLE).alias("loss"))

    parts = sorted_.select("conv", F.transform("turns", part).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["opens"], p["text"], p["closes"])), "")
    # spans are gathered in blocks, since an array grows by being copied: a block of its own start, then flattened
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / BLOCK).cast("int")), lambda i: F.slice("parts", i * BLOCK + 1, F.lit(BLOCK)))

    def width(p: Column) -> Column:
        return F.length(p["opens"]) + F.length(p["text"]) + F.length(p["closes"])

    widths = F.transform("blocks", lambda b: F.aggregate(b, F.lit(0), lambda acc, p: acc + width(p)))
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))
    starts = F.aggregate("widths", begin, lambda acc, w: F.struct((acc["at"] + w).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))["starts"]
    none = F.expr("cast(array() as array<struct<start:int,length:int>>)")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["opens"])
        span = F.struct((start + 1).alias("start"), F.length(p["text"]).alias("length"))
        spans = F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + width(p)).alias("at"), spans.alias("spans"))

    spans = F.flatten(F.zip_with("blocks", "starts", lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("spans")), step)["spans"]))
    made = parts.select("conv", "parts", whole.alias("formatted"), blocks.alias("blocks")).withColumn("widths", widths).withColumn("starts", starts)
    return made.select(F.col("conv").alias(conv), "formatted", spans.alias("loss_spans"))


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation: id, turns (role, text) and loss_text, all from the formatted text and its mask."""
    blocks = F.split("formatted", r"<\|end\|>\n", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, CLOSE, 1)
        body = F.substring(block, F.length(head) + len(CLOSE) + 1, F.length(block))
        role = unescape(F.substring(head, F.lit(len(BEGIN) + 1), F.length(head)))
        return F.transform(F.split(body, r"<\|next\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"])))
    return formatted.select(conv, "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), F.array_join(masked, "").alias("loss_text"))


def digest(turns: DataFrame, **columns: str) -> DataFrame:
    """What the query returns, all read back from the formatted output."""
    conv = columns.get("conv", "conv_id")
    back = read_back(format_conversations(turns, **columns), conv)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
