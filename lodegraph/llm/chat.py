"""Chat formatting with built-in functions only.

A template declares the turn markers, which roles carry loss, and a finite-state machine over roles. Each conversation
becomes one formatted text with segments (start, end, role, loss); control strings inside texts are escaped so that the
output can be read back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One more backslash goes between "<" and "|" however many are there, so escaped texts never hold "<|".
ESCAPE, ESCAPED = r"<(\\*)\|", r"<\\$1|"
UNESCAPE, UNESCAPED = r"<\\(\\*)\|", r"<$1|"


@dataclass(frozen=True)
class ChatTemplate:
    """`open` and `close` start with "<|" or hold none; the role's line ends with a newline."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: The machine: (state, a turn's role, state after it). Turns without a move are out of order.
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "instructed"),
        ("start", "user", "asked"),
        ("instructed", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
        ("answered", "tool", "returned"),
        ("returned", "assistant", "answered"),
    )
    start: str = "start"
    ends: tuple[str, ...] = ("answered",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, ESCAPED)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, UNESCAPED)


def escape_role(role: Column) -> Column:
    """A role stands on a line of its own: percent codes for "%", newline and "<"."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conv_id of `turns` (conv_id, turn, role, text): conv_id, formatted, segments, valid, first_bad.

    `segments` holds, for each turn, where its escaped text stands in `formatted` (code points, end exclusive), its role
    and its loss flag. `valid` tells whether the template's machine takes all turns and ends in a final state;
    `first_bad` is the position (from 0) of the first turn that it doesn't take, null if none is; the machine stands
    still from there on. No conversation is dropped.

    Null texts and roles are empty. Rows of a conversation are taken by turn (nulls first), then role, then text;
    repeated rows are repeated turns. A null conv_id is a conversation of its own. Other columns play no part. An empty
    table gives no rows. One shuffle by conv_id, which both the running positions and the rows put together use: work
    grows with a conversation's turns, not their square.
    """
    t = template or ChatTemplate()
    own = turns.select("conv_id", F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    piece = own.withColumn("head", F.concat(F.lit(t.open), escape_role(F.col("role")), F.lit("\n"))).withColumn("body", escape(F.col("text")))
    size = F.length("head") + F.length("body") + F.lit(len(t.close))
    line = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = piece.withColumn("pos", F.row_number().over(line)).withColumn("stop", F.sum(size).over(upto).cast("int") - F.lit(len(t.close)))
    turn = F.struct("pos", "role", "head", "body", "stop")
    parts = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("parts"))
    moves = F.create_map(*[F.lit(x) for state, role, then in t.moves for x in (f"{state}\n{role}", then)])
    run = F.aggregate(
        "parts",
        F.struct(F.lit(t.start).alias("state"), F.lit(None).cast("int").alias("bad")),
        lambda acc, x: F.struct(
            F.coalesce(_move(moves, acc, x), acc["state"]).alias("state"),
            F.when(acc["bad"].isNull() & _move(moves, acc, x).isNull(), x["pos"] - 1).otherwise(acc["bad"]).alias("bad"),
        ),
    )
    segment = lambda x: F.struct((x["stop"] - F.length(x["body"])).alias("start"), x["stop"].alias("end"), x["role"].alias("role"), x["role"].isin(*t.loss_roles).alias("loss"))
    return parts.withColumn("run", run).select(
        "conv_id",
        F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(t.close))), "").alias("formatted"),
        F.transform("parts", segment).alias("segments"),
        (F.col("run.bad").isNull() & F.col("run.state").isin(*t.ends)).alias("valid"),
        F.col("run.bad").alias("first_bad"),
    )


def _move(moves: Column, acc: Column, turn: Column) -> Column:
    """The state after the turn; null where there is no move, or the machine stands still."""
    return F.when(acc["bad"].isNull(), F.element_at(moves, F.concat(acc["state"], F.lit("\n"), turn["role"])))


def parse_chats(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Read `turns` array<struct<role, text>> back from `formatted`, and `loss_text` from the segments under the loss mask.
    A null `formatted` has null turns and an empty loss text; null segments have a null loss text."""
    t = template or ChatTemplate()
    pieces = F.slice(F.split(F.col("formatted"), re.escape(t.open)), 2, 1 << 30)
    whole = F.transform(pieces, lambda x: F.substring(x, F.lit(1), F.length(x) - F.lit(len(t.close))))
    read = F.transform(whole, lambda x: F.struct(unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + F.lit(2), F.length(x))).alias("text")))
    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(F.substring(F.col("formatted"), s["start"] + F.lit(1), s["end"] - s["start"])))
    return formatted.withColumn("turns", read).withColumn("loss_text", F.array_join(masked, ""))
