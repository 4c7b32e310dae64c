"""Chat formatting (operator 8) with Spark expressions only.

Turns are collected per conversation as structs and sorted; adjacent turns of one role become one block. A block is
``[ROLE:role]`` text (``[NEXT]`` text)* ``[/ROLE]``, so each turn can be read back. Inside texts and roles ``\\`` is written ``\\\\`` and
``[`` is written ``\\(``: no marker can occur in a text, whatever it says, and the two replacements are undone in reverse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MID, NEXT, CLOSE = "[ROLE:", "]", "[NEXT]", "[/ROLE]"
LOSS_ROLE = "assistant"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("["), F.lit("\\("))


def escaped_role(c: Column) -> Column:
    """A role ends at the first ``]``; one inside it is written ``\\)``."""
    return F.replace(escaped(c), F.lit("]"), F.lit("\\)"))


def unescaped(c: Column) -> Column:
    """The inverse of escaped and of escaped_role. The text is cut at ``\\\\`` first, so a backslash before a parenthesis in the text stays one."""
    parts = F.transform(F.split(c, F.lit(r"\\\\")), lambda p: F.replace(F.replace(p, F.lit("\\("), F.lit("[")), F.lit("\\)"), F.lit("]")))
    return F.array_join(parts, "\\")


STEP = 256


def running_sums(df: DataFrame, lengths: str, out: str, step: int = STEP) -> DataFrame:
    """df with array<int> out: the sum of what stands before each element of lengths. Sums run within slices of step elements, which start
    at the running sums of the slices, so that a long array is not copied anew for each of its elements. Each stage is a column of its
    own, so that none is worked out again for every slice."""
    none = F.array().cast("array<int>")
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    # The state is the sum so far and the sums before each element.
    fold = lambda xs, start: F.aggregate(xs, F.struct(start.alias("s"), none.alias("out")), lambda a, x: F.struct((a["s"] + x).alias("s"), F.array_append(a["out"], a["s"]).alias("out")), lambda a: a["out"])
    starts = F.when(F.size(lengths) > 0, F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(step))).otherwise(none)
    sliced = df.withColumn("slices_", F.transform(starts, lambda at: F.slice(lengths, at + 1, step)))
    begun = sliced.withColumn("sums_", F.transform("slices_", total))
    begun = begun.withColumn("begins_", fold(F.col("sums_"), F.lit(0)))
    return begun.withColumn(out, F.flatten(F.zip_with("slices_", "begins_", fold))).drop("slices_", "sums_", "begins_")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, blocks, loss: one row per conversation of turns(conv_id, turn, role, text).

    loss: array<struct<start, length>>, the span of each LOSS_ROLE turn's escaped text in formatted, in characters from 0; an
    empty text has a span of length 0. Marks and roles are in no span.

    Null text or role: empty. Turns of equal number follow in the order of role and text, repeated rows stay, null numbers
    come first; a null conv_id is a conversation of its own. Other columns are not read; no turns, no rows."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sorted_turns = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    # A turn that follows one of its own role adds to the block, any other one closes that block and opens the next.
    def piece(t: Column, i: Column) -> Column:
        before = F.get("turns", i - 1)["role"]
        goes_on = F.coalesce(before == t["role"], F.lit(False))
        opening = F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(OPEN), escaped_role(t["role"]), F.lit(MID))
        return F.struct(F.when(goes_on, F.lit(NEXT)).otherwise(opening).alias("mark"), escaped(t["text"]).alias("text"), goes_on.alias("goes_on"), (t["role"] == LOSS_ROLE).alias("loss"))

    pieces = sorted_turns.select("conv_id", F.transform("turns", piece).alias("pieces"))
    length = lambda p: F.length(p["mark"]) + F.length(p["text"])
    placed = running_sums(pieces.withColumn("lengths", F.transform("pieces", length)), "lengths", "before")
    span = lambda p, i: F.when(p["loss"], F.struct((F.get("before", i) + F.length(p["mark"])).alias("start"), F.length(p["text"]).alias("length")))
    return placed.select(
        "conv_id",
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["text"])), ""), F.lit(CLOSE)).alias("formatted"),
        F.size(F.filter("pieces", lambda p: ~p["goes_on"])).alias("blocks"),
        F.array_compact(F.transform("pieces", span)).alias("loss"),
    )


def loss_texts(formatted: Column, loss: Column) -> Column:
    """array<string>: the texts that the spans cut from the formatted conversation, as they were before escaping."""
    return F.transform(loss, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["length"])))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"\[ROLE:"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescaped(F.element_at(F.split(block, r"\]", 2), 1))
        body = F.substr(block, F.locate(MID, block) + F.lit(1))
        texts = F.split(F.substr(body, F.lit(1), F.length(body) - F.lit(len(CLOSE))), r"\[NEXT\]")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(turns: DataFrame) -> DataFrame:
    """The formatted conversations, read back, and what their loss spans cut out: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_blocks.

    A row per conversation; edges (null roles and texts, ties of turns, repeated rows) are those of `format_conversations`. Without
    assistant turns the loss is empty, with the digest of no bytes. No rows give no rows; extra columns are not read."""
    back = format_conversations(turns).select("conv_id", "blocks", "formatted", "loss", read_back(F.col("formatted")).alias("turns"))
    loss = F.array_join(loss_texts(F.col("formatted"), F.col("loss")), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), F.col("blocks").cast("long").alias("n_blocks"))
