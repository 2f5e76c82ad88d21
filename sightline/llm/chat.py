"""Chat formatting by prefix-target expansion, in built-in functions only.

Every assistant turn becomes an example of its own: all preceding turns as context and that reply as the only trainable
text. Turns after the last reply (or a conversation without one) give one last example with nothing trainable, so that
the output holds every turn.

A turn is written <|role|>LF text <|end|>LF. In roles and texts "&", "<", "|" and "[" are replaced by entities, so that
no text can hold a control string of this template or of the usual others; unescape() undoes it.

Turns are ordered by turn, then role, then text (nulls first), so ties have one order; repeated rows stay repeated
turns. Null roles and texts are written as empty, a null conversation id is a conversation. An empty table gives an
empty one. Only the four named columns are read, so that others can't clash. A conversation's turns, like a document,
must fit in a task's memory; its examples are made one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In this order for escaping, in reverse for reading back.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("|", "&vert;"), ("[", "&lsqb;"))
OPEN, NAMED, CLOSE = "<|", "|>\n", "<|end|>\n"


def escape(c: Column) -> Column:
    for plain, entity in ENTITIES:
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def unescape(c: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def format_chat(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """Return examples: conv_id, example (from 0), is_last, text, loss_start and loss_end (code points of text under the
    loss mask, end exclusive; both null in a last example with nothing trainable)."""
    turns = df.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = whole.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == target).alias("is_target"),
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(NAMED))).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("bodies"),
    )
    n = F.size("bodies")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("is_target", i)) | (i == n))
    each = written.select("*", F.posexplode(ends).alias("example", "last_turn"))
    last = F.col("last_turn")
    before = F.concat_ws(
        "",
        F.zip_with(F.slice("heads", F.lit(1), last - 1), F.slice("bodies", F.lit(1), last - 1), lambda h, b: F.concat(h, b, F.lit(CLOSE))),
    )
    parts = each.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        (last == n).alias("is_last"),
        F.concat(before, F.element_at("heads", last)).alias("before"),
        F.element_at("bodies", last).alias("body"),
        F.element_at("is_target", last).alias("trained"),
    )
    start = F.length("before").cast("long")
    return parts.select(
        "conv_id",
        "example",
        "is_last",
        F.concat("before", "body", F.lit(CLOSE)).alias("text"),
        F.when(F.col("trained"), start).alias("loss_start"),
        F.when(F.col("trained"), start + F.length("body")).alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted example as array<struct<role,text>>."""
    # every turn but the text after the last CLOSE, which is empty
    raw = F.split(text, r"<\|end\|>\n", -1)
    raw = F.slice(raw, F.lit(1), F.size(raw) - 1)

    def turn(t):
        cut = F.instr(t, NAMED)
        return F.struct(unescape(F.substr(t, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)).alias("role"), unescape(F.substr(t, cut + len(NAMED))).alias("text"))

    return F.transform(raw, turn)


def read_loss(text: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, unescaped; null where nothing is trainable."""
    return unescape(F.substr(text, (start + 1).cast("int"), (end - start).cast("int")))
