"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and of the whole example only
that reply is trainable. A conversation that doesn't end with an assistant turn yields a last example with nothing to
train, so that its closing turns aren't lost.

The template is ``<|im_start|>ROLE<|im_sep|>TEXT<|im_end|>`` and a line feed for each turn. A ``<``, any number of
backslashes and ``|`` in a role or text get one more backslash, so no control string can stand inside them, and the way
back takes one away.

Null roles and texts count as empty. Turns that tie are ordered by role, then text; repeated rows stay repeated turns;
rows with a null conversation id form one conversation. A row of the result holds one conversation up to one turn, so
its size is that of a conversation, never that of the table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Examples: ``conv_col``, example (from 0), formatted, loss_start and loss_chars (code points; both 0 if nothing is trainable)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    conversations = turns.groupBy(F.col(conv_col).alias("conv")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP))
    parts = conversations.select(
        "conv",
        F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))).alias("parts"),
        F.transform("turns", lambda t: F.struct(F.char_length(head(t)).alias("head"), F.char_length(escape(t["text"])).alias("size"), (t["role"] == "assistant").alias("trained"))).alias("sizes"),
    )
    ends = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda k: F.element_at("sizes", k)["trained"] | (k == F.size("parts")))
    each = parts.select("conv", "parts", "sizes", F.posexplode(ends).alias("example", "k"))
    last = F.element_at("sizes", F.col("k"))
    context = F.array_join(F.slice("parts", F.lit(1), F.col("k") - 1), "")
    made = each.select("conv", "example", last.alias("last"), context.alias("context"), F.element_at("parts", F.col("k")).alias("reply"))
    return made.select(
        F.col("conv").alias(conv_col),
        F.col("example").cast("long").alias("example"),
        F.concat("context", "reply").alias("formatted"),
        F.when(F.col("last.trained"), F.char_length("context") + F.col("last.head")).otherwise(0).cast("long").alias("loss_start"),
        F.when(F.col("last.trained"), F.col("last.size")).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example, array of struct<role, text>, read back from it alone."""
    marked = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    part = lambda p, i: unescape(F.split(F.substring(p, F.lit(1), F.char_length(p) - len(END)), r"<\|im_sep\|>").getItem(i))
    return F.transform(marked, lambda p: F.struct(part(p, 0).alias("role"), part(p, 1).alias("text")))


def digests(examples: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """What the examples of each conversation hold, read back from the formatted strings and their masks."""
    loss = unescape(F.expr("substring(formatted, int(loss_start) + 1, int(loss_chars))"))
    per = examples.select(conv_col, "example", "formatted", loss.alias("loss")).groupBy(conv_col).agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("losses"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
    )
    turns = per.withColumn("turns", read_turns(F.col("whole")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.char_length("losses").cast("long").alias("loss_chars"),
        F.sha2(F.col("losses"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
