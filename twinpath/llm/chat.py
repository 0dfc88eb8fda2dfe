"""Chat formatting with relational operators and Spark expressions.

The turns of a conversation are collected as structs and sorted by turn, then
role, then text. Adjacent turns of one role share a block:

    <|im_start|>role<|im_sep|>text<|im_turn|>next text of the same role<|im_end|>

Control strings inside roles and texts, those of other common templates too, get
one backslash behind their first character, further to any that stand there
already; taking one away undoes it. The output carries the formatted text and
its segments, each with its place under the loss mask: the texts of assistant
turns, escaped, without any control string.

Blocks are aggregated from the sorted array: its places where the role changes
cut it into slices, and each slice is one block with the array of its texts. The
work grows with the turns; a fold would copy its accumulator for each of them.
A conversation is one value of the result, so its turns do meet in one task.

Defined cases: null texts and roles are empty ones; null turns sort first; rows
of equal turn sort by role and text, and repeated rows stay; null conversation
ids form one conversation; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of

START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|im_turn|>", "<|im_end|>"
#: What follows the first character of a control string.
REST = r"\||/?s>|</?SYS>>|/?INST\]|/?TOOL|/?AVAILABLE"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(?=\\*(?:{REST}))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(?=\\*(?:{REST}))", "$1")


def merged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation, blocks: array of struct(role, texts)): the turns in order, adjacent ones of a role in one block."""
    row = F.struct(F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    rows = F.col("rows")
    grouped = turns.select(F.col(conv_col), row.alias("row")).groupBy(conv_col).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    starts = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: (i == 0) | (F.get(rows, i - 1)["role"] != F.get(rows, i)["role"]))

    def blocks(starts: Column) -> Column:
        stop = lambda k: F.coalesce(F.get(starts, k + 1), F.size(rows))
        return F.transform(starts, lambda i, k: F.struct(F.get(rows, i)["role"].alias("role"), F.slice(rows, i + 1, stop(k) - i)["text"].alias("texts")))

    return grouped.select(conv_col, let(starts, blocks).alias("blocks"))


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation, formatted, segments: array of struct(text, loss)) of each conversation."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def segments(block: Column) -> Column:
        parted = F.transform(block["texts"], lambda t, j: F.array(piece(F.when(j > 0, F.lit(TURN)).otherwise(F.lit("")), F.lit(False)), piece(escape(t), block["role"] == TRAINED_ROLE)))
        return F.concat(F.array(piece(F.concat(F.lit(START), escape(block["role"]), F.lit(SEP)), F.lit(False))), F.flatten(parted), F.array(piece(F.lit(END), F.lit(False))))

    found = F.flatten(F.transform("blocks", segments))
    made = merged(turns, conv_col, turn_col, role_col, text_col).withColumn("segments", F.filter(found, lambda s: s["loss"] | (s["text"] != "")))
    return made.select(conv_col, F.array_join(F.col("segments")["text"], "").alias("formatted"), "segments")


def turns_of(text: Column) -> Column:
    """array of struct(role, text): the turns read back from a formatted conversation."""
    literal = lambda mark: mark.replace("|", r"\|")
    blocks = F.filter(F.split(text, literal(END)), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(F.substring(block, len(START) + 1, 2**31 - 1), literal(SEP))
        return F.transform(F.split(F.get(parts, F.lit(1)), literal(TURN)), lambda t: F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
