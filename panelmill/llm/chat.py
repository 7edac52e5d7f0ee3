"""Conversations as training examples: every assistant turn an example of its own, its context all turns before it.

Turns become pieces of text: a mark, the role, a line feed, the text, an end mark. `format_chats` lists the pieces of a conversation
and, per example, how many of them it takes and which of its characters are trainable: only the reply. `example_texts` writes every
example out, one row each, its whole context before the reply; `read_back` reads the trained text under the masks of these texts and
the turns between the marks of the formatted conversation. Written out, the examples of a conversation grow with the square of its
turns; each is a row of its own, made and read one at a time, so memory holds one conversation and one example, never all of them.

Marks never occur inside texts: a control string there gets one escape sign after its first character, and one that has such
signs already gets one more, so taking one sign away restores the text exactly. Everything is built-in functions. A conversation
meets in one row, as it must to become one text; conversations are spread by their ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN, END = "<|turn|>", "<|end|>\n"
_TURN_MARK = r"<\|turn\|>"
ROLE_END = "\n"
TARGET = "assistant"
# Control strings of this and of other templates: <|name|>, <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>. One escape sign after
# the first character is what `escaped` adds and `unescaped` takes away.
_CONTROL = r"([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>)"
_ESCAPED = r"([<\[])\\(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _role_out(role: Column) -> Column:
    """A role on one line: backslash and line feed as two characters."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(line: Column) -> Column:
    # Taken apart at doubled backslashes, every "\n" left is a line feed.
    parts = F.transform(F.split(unescaped(line), r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def piece(role: Column, text: Column) -> Column:
    """One turn of the template."""
    return F.concat(F.lit(TURN), _role_out(role), F.lit(ROLE_END), escaped(text), F.lit(END))


def role_of(written: Column) -> Column:
    return _role_in(F.substring_index(F.substring(written, len(TURN) + 1, 1 << 30), ROLE_END, 1))


def text_of_piece(written: Column) -> Column:
    start = F.locate(ROLE_END, written, len(TURN) + 1)
    return unescaped(F.substring(written, start + 1, F.length(written) - start - len(END)))


def format_chats(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 target: str = TARGET) -> DataFrame:
    """One row per conversation: `conv_id, pieces, examples`.

    `pieces` are the turns of the template in order; joined, they are the formatted conversation. `examples` has one entry per turn
    of the role `target`: `example` (from 1), `pieces` (how many of them the example takes, the reply last), `context_chars` (all
    before the reply's piece), `loss_start` and `loss_end` (code points in the example's text, end exclusive): what is trained.

    A null text or role is an empty one, any role is allowed. Turns that repeat all count, ordered by turn (null first), role,
    text; rows without a conversation id form one conversation. A conversation without a reply has no examples. Empty and very
    long texts are turns like others. An empty table gives an empty result; other columns are not looked at.
    """
    shown = turns.select(F.col(f"`{conversation}`").alias("conv_id"), F.col(f"`{turn}`").alias("_turn"),
                         F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("_role"),
                         F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    rows = shown.select("conv_id", "_turn", "_role", "_text", piece(F.col("_role"), F.col("_text")).alias("_piece"))
    order = Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    chars = F.length("_piece").cast("long")
    placed = rows.select("conv_id", "_piece", F.col("_role"), F.row_number().over(order).alias("_at"), (F.sum(chars).over(upto) - chars).alias("_before"))
    start = F.col("_before") + F.locate(ROLE_END, F.col("_piece"), len(TURN) + 1)
    end = F.col("_before") + F.length("_piece") - len(END)
    example = F.struct(F.col("_at").alias("pieces"), F.col("_before").alias("context_chars"), start.alias("loss_start"), end.alias("loss_end"))
    found = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_piece"))).alias("_pieces"),
        F.array_sort(F.collect_list(F.when(F.col("_role") == target, example))).alias("_examples"))
    numbered = F.transform("_examples", lambda e, i: F.struct((i + 1).alias("example"), e["pieces"].alias("pieces"), e["context_chars"].alias("context_chars"),
                                                              e["loss_start"].alias("loss_start"), e["loss_end"].alias("loss_end")))
    return found.select("conv_id", F.transform("_pieces", lambda p: p["_piece"]).alias("pieces"), numbered.alias("examples"))


def explode_examples(chats: DataFrame) -> DataFrame:
    """One row per example: `conv_id, example, pieces, context_chars, loss_start, loss_end` and `reply`, its last piece."""
    each = chats.select("conv_id", F.col("pieces").alias("_pieces"), F.explode("examples").alias("e"))
    return each.select("conv_id", "e.*", F.element_at("_pieces", F.col("e.pieces")).alias("reply"))


def _written(chats: DataFrame, explode: Callable[[str], Column], *kept: str) -> DataFrame:
    """Every example's context and reply as one text, with the span that is trained."""
    each = chats.select("conv_id", *kept, F.col("pieces").alias("_pieces"), explode("examples").alias("e"))
    text = F.array_join(F.slice("_pieces", 1, F.col("e.pieces")), "")
    return each.select("conv_id", *kept, "e.example", text.alias("text"), "e.loss_start", "e.loss_end")


def example_texts(chats: DataFrame) -> DataFrame:
    """One row per example: `conv_id, example, text, loss_start, loss_end`, the text written out with its whole context."""
    return _written(chats, F.explode)


def read_back(chats: DataFrame) -> DataFrame:
    """`conv_id, n_turns, turns, loss, formatted_chars, n_examples, example_chars`: the conversations, from the formatted output alone.

    `turns` is role, line feed, text, line feed of every turn, taken apart at the marks of the formatted conversation; `loss` is all text
    under the loss masks of the written-out examples, unescaped; `example_chars` is the length of these examples.
    """
    formatted = chats.select("conv_id", "pieces", "examples", F.array_join("pieces", "").alias("_whole"))
    # Nothing stands before the first mark.
    parts = formatted.select("conv_id", "pieces", "examples", F.slice(F.split("_whole", _TURN_MARK), 2, 1 << 30).alias("_parts"),
                             F.length("_whole").cast("long").alias("formatted_chars"))
    marked = F.transform("_parts", lambda p: F.concat(F.lit(TURN), p))
    turns = F.transform(marked, lambda p: F.concat(role_of(p), F.lit("\n"), text_of_piece(p), F.lit("\n")))
    wholes = parts.select("conv_id", "pieces", "examples", F.size("_parts").cast("long").alias("n_turns"),
                          F.array_join(turns, "").alias("turns"), "formatted_chars")
    # A conversation without examples keeps one row; its turns travel with the first row alone.
    kept = ("n_turns", "turns", "formatted_chars")
    texts = _written(wholes, F.explode_outer, *kept)
    loss = unescaped(F.substring("text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    first = F.coalesce(F.col("example") == 1, F.lit(True))
    read = texts.select("conv_id", "example", *[F.when(first, F.col(c)).alias(c) for c in kept],
                        F.when(F.col("example").isNotNull(), F.struct("example", loss.alias("loss"))).alias("_loss"), F.length("text").cast("long").alias("_chars"))
    losses = F.transform(F.array_sort(F.collect_list("_loss")), lambda x: x["loss"])
    return read.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in kept], F.array_join(losses, "").alias("loss"), F.count("example").alias("n_examples"),
                                       F.coalesce(F.sum("_chars"), F.lit(0)).alias("example_chars")).select(
        "conv_id", "n_turns", "turns", "loss", "formatted_chars", "n_examples", "example_chars")
