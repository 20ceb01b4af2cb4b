"""Chat formatting with a loss mask (DataFrame operations only).

The template writes one block per run of adjacent turns with the same role:

    <|turn|>ROLE<|text|>TEXT<|next|>TEXT<|end|>\\n

``<|next|>`` divides the turns that a block merges, so the turns can be read
back. In roles and texts every backslash is doubled and a backslash breaks each
control string, both the template's own and the common foreign ones; a backslash
and what follows it always read back as that character.

A window numbers a conversation's turns and gives each its neighbours' roles and
the characters before it. Turns are collected, sorted and merged per segment of
``segment_turns`` turns, then segments are concatenated; all of it rests on one
shuffle by conversation. A window sorts on disk if it must, so a very long
conversation costs one sorted run, and no more memory than a segment until its
one output string is put together.

Edge cases: null texts and roles are empty; ties of ``turn`` are ordered by role
and text; null turns come first; repeated rows are turns of their own; an empty
table gives an empty result; a null conv_id is a conversation like others; very long
texts are escaped and formatted whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings.
TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"
#: Control strings of other templates that are escaped as well.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    """Break every control string, reversibly."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in ("<|", *FOREIGN):
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(conversations: DataFrame, segment_turns: int = 256) -> DataFrame:
    """conv_id, formatted, loss_spans: one row per conversation.

    loss_spans holds (start, length) in characters of ``formatted`` for each
    assistant text, in order.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("role").isNotNull() & ~F.lag("role").over(order).eqNullSafe(F.col("role"))
    closes = ~F.lead("role").over(order).eqNullSafe(F.col("role"))
    turns = (
        conversations.select(
            "conv_id",
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .withColumns({"n": F.row_number().over(order), "opens": opens, "closes": closes})
        .withColumns({"body": escape(F.col("text")), "head": escape(F.col("role"))})
        .withColumn(
            "lead",
            F.when(F.col("opens"), F.concat(F.lit(TURN), F.col("head"), F.lit(TEXT))).otherwise(F.lit(NEXT)),
        )
        .withColumn(
            "at",
            F.length("lead")
            + F.coalesce(
                F.sum(F.length("lead") + F.length("body") + F.when(F.col("closes"), len(END)).otherwise(0)).over(before),
                F.lit(0),
            ),
        )
    )
    turn = F.struct("n", "role", "lead", "body", "closes", "at")
    segments = (
        turns.groupBy("conv_id", F.floor((F.col("n") - 1) / segment_turns).alias("segment"))
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        .select("conv_id", "segment", _merged("turns").alias("runs"), _spans("turns").alias("spans"))
        .select(
            "conv_id",
            F.struct(
                "segment", F.array_join(F.transform("runs", lambda r: r["piece"]), "").alias("piece"), "spans"
            ).alias("part"),
        )
    )
    return (
        segments.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("part")).alias("parts"))
        .select(
            "conv_id",
            F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"),
            F.flatten(F.transform("parts", lambda p: p["spans"])).alias("loss_spans"),
        )
    )


def _merged(turns: str) -> Column:
    """Adjacent turns of one role merged into runs, each with its text."""
    piece = lambda t: F.concat(t["lead"], t["body"], F.when(t["closes"], F.lit(END)).otherwise(F.lit("")))
    empty = F.array().cast("array<struct<role:string,piece:string>>")

    def fold(runs: Column, t: Column) -> Column:
        last = F.element_at(runs, -1)
        grown = F.struct(t["role"].alias("role"), F.concat(last["piece"], piece(t)).alias("piece"))
        added = F.struct(t["role"].alias("role"), piece(t).alias("piece"))
        same = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["role"] == t["role"])
        return F.when(same, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(grown))).otherwise(
            F.concat(runs, F.array(added))
        )

    return F.aggregate(turns, empty, fold)


def _spans(turns: str) -> Column:
    assistant = F.filter(turns, lambda t: t["role"] == "assistant")
    return F.transform(
        assistant,
        lambda t: F.struct(t["at"].cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length")),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss_text: parsed from the template and the mask."""
    quoted = re.escape(END)
    blocks = F.filter(F.split("formatted", quoted), lambda b: b != "")

    def block(b: Column) -> Column:
        role = unescape(F.substring_index(F.substr(b, F.lit(len(TURN) + 1)), TEXT, 1))
        texts = F.split(F.substr(b, F.locate(TEXT, b) + len(TEXT)), re.escape(NEXT))
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    masked = F.transform(
        "loss_spans",
        lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))),
    )
    return formatted.select(
        "conv_id",
        "formatted",
        F.flatten(F.transform(blocks, block)).alias("turns"),
        F.array_join(masked, "").alias("loss_text"),
    )
