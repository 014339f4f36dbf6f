"""Chat formatting by prefix-target expansion, in DataFrame operations only.

``format_turns`` writes every turn as a marked segment; a conversation's text is
its segments in order. ``expand`` makes one example of every assistant turn:
all segments before it are its context, and only its reply is trainable. An
example's text is a prefix of its conversation's text, so examples carry
character spans and the segments are kept once: the table grows with the turns,
not with the square of a conversation's length. ``render`` writes an example's
text out in full where that is wanted.

The template: ``<turn ROLE>\\n`` text ``</turn>\\n``. Inside texts and roles the
control strings ``<turn`` and ``</turn`` have their ``<`` written ``&lt;``, and
``&`` is written ``&amp;``, so that no text can end or open a turn; a role also
has its line ends and ``>`` escaped. ``unescape`` reverses this exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a conversation whose offsets are summed in one task.
BLOCK = 1024

OPEN, CLOSE, HEAD_END = "<turn ", "</turn>\n", ">\n"


def _replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape(text: Column) -> Column:
    """No control string and no bare ``&`` is left; null stays null."""
    return _replaced(text, ("&", "&amp;"), ("<turn", "&lt;turn"), ("</turn", "&lt;/turn"))


def escape_role(role: Column) -> Column:
    return _replaced(role, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "&nl;"))


def unescape(text: Column) -> Column:
    """The text or role that was escaped: every other escape holds no ``&``, so it goes last."""
    return _replaced(text, ("&lt;", "<"), ("&gt;", ">"), ("&nl;", "\n"), ("&amp;", "&"))


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """conv_id, turn, place, role, segment, start, text_start, text_end, end: the marked turns.

    ``place`` counts a conversation's rows from 1, in the order of turn (nulls
    first) and segment; repeated rows keep places of their own. The offsets are
    code points in the conversation's text, ``[start, end)`` for the segment.
    Null role or text counts as empty; null conversations are one conversation.
    Other columns are neither read nor returned.

    A conversation of any length is summed in blocks of its turn numbers: sums
    of blocks first, then of the rows within a block. The text is shuffled once.
    """
    head = F.concat(F.lit(OPEN), escape_role(F.coalesce(F.col(role_col), F.lit(""))), F.lit(HEAD_END))
    # a struct compares equal with null fields, so null conversations and turns need no other join
    block = F.struct(F.col("conv_id"), F.floor(F.col("turn") / F.lit(BLOCK)).alias("block"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.length(head).alias("head_chars"),
                        F.concat(head, escape(F.coalesce(F.col(text_col), F.lit(""))), F.lit(CLOSE)).alias("segment"))
    rows = rows.withColumn("block", block).withColumn("chars", F.length("segment").cast("long"))
    sums = rows.groupBy("block").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("rows"))
    ahead = Window.partitionBy("block.conv_id").orderBy("block.block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("block", F.coalesce(F.sum("chars").over(ahead), F.lit(0)).alias("base"),
                       F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("block").orderBy("turn", "segment")
    rows = (rows.withColumn("own", F.row_number().over(inside))
            .withColumn("upto", F.sum("chars").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
            .join(sums, "block"))
    end = F.col("base") + F.col("upto")
    start = end - F.col("chars")
    return rows.select(
        "conv_id", "turn", (F.col("before") + F.col("own")).alias("place"), "role", "segment", start.alias("start"),
        (start + F.col("head_chars")).alias("text_start"), (end - len(CLOSE)).alias("text_end"), end.alias("end"))


def expand(segments: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One row an example: a turn of ``target_role`` with all before it as context.

    conv_id, example (the target's place), context_turns, context_end, text_end,
    loss_start, loss_end: the example is the conversation's text ``[0, text_end)``,
    its context ends at ``context_end``, and its loss mask is ``[loss_start,
    loss_end)``, the reply alone. Every reply is trainable in exactly one example.
    """
    return segments.where(F.col("role") == target_role).select(
        "conv_id", F.col("place").alias("example"), (F.col("place") - 1).alias("context_turns"),
        F.col("start").alias("context_end"), F.col("end").alias("text_end"),
        F.col("text_start").alias("loss_start"), F.col("text_end").alias("loss_end"))


def render(segments: DataFrame, examples: DataFrame) -> DataFrame:
    """``examples`` with text, the example written out in full.

    The output has each context once for every reply that follows it, so it
    grows with the square of a conversation's length: meant for selected
    examples or for conversations of bounded length."""
    parts = segments.select(F.col("conv_id").alias("c"), "place", "segment")
    joined = examples.join(parts, examples["conv_id"].eqNullSafe(F.col("c")) & (F.col("place") <= F.col("example")))
    return (joined.groupBy(*examples.columns).agg(F.sort_array(F.collect_list(F.struct("place", "segment"))).alias("p"))
            .withColumn("text", F.concat_ws("", F.col("p.segment"))).drop("p"))


def read_turns(segments: DataFrame, examples: DataFrame) -> DataFrame:
    """The turns read back from ``expand``'s examples: conv_id, place, role, text, loss_text, chars.

    Role and text are parsed from the segment alone; ``loss_text`` is what lies
    under the loss mask of the example whose reply is at that place (null: none),
    unescaped. An example is joined with the one segment that ends it, so the
    table is as long as the conversations are, whatever the examples' contexts."""
    spans = examples.select(F.col("conv_id").alias("example_conv"), "example", "context_end", "loss_start", "loss_end")
    rows = segments.select("conv_id", "place", "segment").join(
        spans, F.col("conv_id").eqNullSafe(F.col("example_conv")) & (F.col("place") == F.col("example")), "left")
    mark = F.locate(HEAD_END, F.col("segment"))
    role = F.substring(F.col("segment"), F.lit(len(OPEN) + 1), mark - F.lit(len(OPEN) + 1))
    text = F.substring(F.col("segment"), mark + F.lit(len(HEAD_END)),
                       F.length("segment") - mark - F.lit(len(HEAD_END) + len(CLOSE) - 1))
    loss = F.substring(F.col("segment"), (F.col("loss_start") - F.col("context_end") + 1).cast("int"),
                       (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return rows.select("conv_id", "place", unescape(role).alias("role"), unescape(text).alias("text"),
                       unescape(loss).alias("loss_text"), F.length("segment").alias("chars"))
