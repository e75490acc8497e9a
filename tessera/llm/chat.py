"""Multi-party chat rendering, rotated to every participant's perspective.

For each participant of a conversation the whole dialogue is rendered with
that speaker as ``assistant`` and all others as named ``user`` turns; system
turns stay ``system`` and are nobody's perspective. A dialogue comes as its
rendered messages, one row each, because a conversation may hold a third of
all rows: the strings of one dialogue joined in the order of ``position`` are
its text, and ``start`` and the mask are places in that text. They come from
running sums inside blocks of turns, on top of the sums of all blocks before,
so no task holds more than a block of a conversation. Only one row a block
and speaker is gathered, by an aggregate with map-side combine.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turn numbers of one block.
BLOCK = 1024
_BLANK = " \t\n\x0b\x0c\r"


def _plain(c: Column) -> Column:
    """Marks of the format inside a text are broken, so that no text can open or close a turn."""
    return F.replace(F.replace(c, F.lit(OPEN), F.lit("<|im_start |>")), F.lit(CLOSE), F.lit("<|im_end |>"))


def _header_name(c: Column) -> Column:
    """A name that cannot end its header line: line ends and backslashes are escaped."""
    for raw, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return _plain(c)


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per conversation, perspective and turn.

    Columns: conversation and turn as they come, ``perspective`` (the
    participant), ``position`` (from 0), ``chat_role``, ``name`` (of a user,
    else null), ``rendered``, ``start`` (where it begins in the dialogue, in
    code points), and the mask, ``mask_start`` and ``mask_length`` in code
    points of the dialogue (the assistant's text with its closing mark; -1 and
    0 where nothing is trained on). The order is by turn (null first), then
    speaker and text; rows equal in all three are alike, and all are rendered.
    A null text renders as empty; a null or blank speaker is the participant
    ``unknown``; white space around a name goes; a null conversation is one
    conversation. A conversation of system turns alone has no perspective and
    no rows, an empty table an empty result. A very long text is one message.
    Other columns, whatever their names, are left out. A turn that is no
    number puts a conversation into one block.
    """
    who = F.coalesce(F.nullif(F.btrim(_named(speaker).cast("string"), F.lit(_BLANK)), F.lit("")), F.lit("unknown"))
    said = F.coalesce(_named(text).cast("string"), F.lit(""))
    number = isinstance(turns.schema[turn].dataType, T.NumericType)
    at = F.coalesce(F.floor(_named(turn).cast("double") / block), F.lit(-1)).cast("long") if number else F.lit(0).cast("long")
    base = turns.select(_named(conv).alias("_conv"), _named(turn).alias("_turn"), who.alias("_who"), said.alias("_said"), at.alias("_block"))

    def head(role: str, name: Column | None = None) -> Column:
        return F.concat(F.lit(f"{OPEN}{role}"), *([F.lit(" name="), _header_name(name)] if name is not None else []), F.lit("\n"))

    body = F.concat(_plain(F.col("_said")), F.lit(CLOSE))
    aside = F.when(F.col("_who") == SYSTEM, head("system")).otherwise(head("user", F.col("_who")))
    tallies = base.groupBy("_conv", "_block", "_who").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(aside) + F.length(body) + 1).alias("size"))
    people = tallies.where(F.col("_who") != SYSTEM).select(F.col("_conv").alias("_of"), F.col("_who").alias("perspective")).distinct()
    blocks = tallies.groupBy("_conv", "_block").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    own = tallies.select(F.col("_conv").alias("_own_conv"), F.col("_block").alias("_own_block"), F.col("_who").alias("_own"), F.col("n").alias("_own_n"))
    spans = blocks.join(people, F.col("_conv").eqNullSafe(F.col("_of")))
    spans = spans.join(own, F.col("_conv").eqNullSafe(F.col("_own_conv")) & (F.col("_block") == F.col("_own_block")) & (F.col("perspective") == F.col("_own")), "left")
    shorter = F.length(head("assistant")) - F.length(head("user", F.col("perspective")))  # a turn of one's own has another header
    before = Window.partitionBy("_of", "perspective").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "_of", "perspective", F.col("_block").alias("_in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum(F.col("size") + shorter * F.coalesce("_own_n", F.lit(0))).over(before), F.lit(0)).alias("_size")
    )
    mine = F.col("_who") == F.col("perspective")
    opening = F.when(mine, head("assistant")).otherwise(aside)
    rows = base.join(spans, F.col("_conv").eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_in")))
    rows = rows.select("_conv", "perspective", "_turn", "_who", "_said", "_block", "_n", "_size", mine.alias("_mine"), F.length(opening).alias("_head"), F.concat(opening, body, F.lit("\n")).alias("rendered"))
    order = Window.partitionBy("_conv", "perspective", "_block").orderBy("_turn", "_who", "_said")
    start = F.col("_size") + F.sum(F.length("rendered")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("rendered")
    placed = rows.withColumns({"position": F.col("_n") + F.row_number().over(order) - 1, "start": start})
    role = F.when(F.col("_who") == SYSTEM, SYSTEM).when(F.col("_mine"), "assistant").otherwise("user")
    return placed.select(
        F.col("_conv").alias(conv),
        "perspective",
        F.col("position").cast("long").alias("position"),
        F.col("_turn").alias(turn),
        role.alias("chat_role"),
        F.when(role == "user", F.col("_who")).alias("name"),
        "rendered",
        F.col("start").cast("long").alias("start"),
        F.when(F.col("_mine"), F.col("start") + F.col("_head")).otherwise(-1).cast("long").alias("mask_start"),
        F.when(F.col("_mine"), F.length("rendered") - F.col("_head") - 1).otherwise(0).cast("int").alias("mask_length"),
    )
