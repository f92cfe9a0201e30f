"""Chat formatting of turn tables, with Spark expressions only.

A block is ``<|im_start|>role``, a line feed, the texts of adjacent turns of that role with ``<|im_sep|>`` between,
and ``<|im_end|>`` with a line feed. Inside roles and texts a backslash is doubled and ``<|`` is written ``<\\|``
(a line feed in a role ``<\\n>``), so no text can hold a mark and every text reads back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escaped(c: Column) -> Column:
    return _replace(_replace(c, "\\", "\\\\"), "<|", "<\\|")


def unescaped(c: Column) -> Column:
    return _replace(_replace(c, "<\\|", "<|"), "\\\\", "\\")


def _role_in(c: Column) -> Column:
    return _replace(escaped(c), "\n", "<\\n>")


def _role_out(c: Column) -> Column:
    return unescaped(_replace(c, "<\\n>", "\n"))


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss) of the rows of ``turns`` (conv_id, turn, role, text).

    ``loss`` holds the [start, end) code points of ``formatted`` that are texts of the role ``learn``, one span per
    turn, in order. Turns are sorted by ``turn`` (null first), then role and text; repeated rows stay. Null roles
    and texts are empty; a null ``conv_id`` is a conversation of its own; other columns are ignored; an empty
    table gives an empty result. A conversation becomes one row, so it has to fit into one.
    """
    clean = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    opens = F.coalesce(F.lag("role").over(order) != F.col("role"), F.lit(True))
    closes = F.coalesce(F.lead("role").over(order) != F.col("role"), F.lit(True))
    head = F.when(opens, F.concat(F.lit(START), _role_in(F.col("role")), F.lit("\n"))).otherwise(F.lit(SEP))
    placed = clean.select("*", F.row_number().over(order).alias("i"), head.alias("head"), escaped(F.col("text")).alias("body"),
                          F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("tail"))
    length = F.length("head") + F.length("body") + F.length("tail")
    before = F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = (before + F.length("head")).alias("start")
    sized = placed.select("conv_id", "i", "role", "head", "body", "tail", start)
    chats = sized.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("i", "role", "head", "body", "tail", "start"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], t["tail"])), "")
    loss = F.transform(F.filter("turns", lambda t: t["role"] == learn), lambda t: F.struct(
        t["start"].alias("start"), (t["start"] + F.length(t["body"])).alias("end")))
    return chats.select("conv_id", text.alias("formatted"), loss.alias("loss"))


def read_turns(formatted: str = "formatted") -> Column:
    """array<struct<role, text>> of all turns, from the formatted text alone."""
    parts = F.split(F.col(formatted), r"<\|im_start\|>")
    blocks = F.slice(parts, F.lit(2), F.size(parts))

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(
            _role_out(role).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: str = "formatted", loss: str = "loss") -> Column:
    """array<string>: the unescaped texts under the loss mask."""
    return F.transform(F.col(loss), lambda s: unescaped(F.substr(
        F.col(formatted), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
