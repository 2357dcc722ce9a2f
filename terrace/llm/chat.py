"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, with all turns before
it as context and only that reply trainable.

A turn is ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Inside texts and roles ``<``, n backslashes and ``|`` get one more
backslash, so no text can hold a control string and the step back is exact; in roles ``\\`` and line feeds are escaped
besides. Turns after the last assistant turn make one more example, without a target, so that nothing is lost.

An example's size is that of its prefix: a conversation of n turns gives O(n^2) text, as the method has it.
``max_context`` bounds the turns of context for those who want it (default: all).

Nulls: a null text or role is empty; turns order by (turn, role, text), null turns first; repeated rows are turns of
their own; rows with a null conversation id form one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def _role(c: Column) -> Column:
    return escaped(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(c: Column) -> Column:
    parts = F.transform(F.split(unescaped(c), r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target_role: str = "assistant", max_context: int | None = None) -> DataFrame:
    """conv_id, example (from 0, by turn), target_index (of its target among the conversation's turns; null without
    one), n_turns (of the conversation), text, loss_start and loss_length (code points of ``text`` under the loss mask)."""
    t = turns.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    convs = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    shown = F.transform("ts", lambda x: F.concat(F.lit(START), _role(x["role"]), F.lit("\n"), escaped(x["text"]), F.lit(END + "\n")))
    convs = convs.select("conv_id", "ts", shown.alias("shown"), F.size("ts").alias("n"))
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (F.element_at("ts", i)["role"] == target_role) | (i == F.col("n")))
    each = convs.select("conv_id", "ts", "shown", "n", F.posexplode(ends).alias("example", "end"))
    first = F.lit(1) if max_context is None else F.greatest(F.lit(1), F.col("end") - max_context)
    last = F.element_at("ts", F.col("end"))
    aimed = last["role"] == target_role
    size = F.char_length(escaped(last["text"]))
    body = F.array_join(F.slice("shown", first, F.col("end") - first + 1), "")
    out = each.select("conv_id", F.col("example").cast("long").alias("example"), F.when(aimed, (F.col("end") - 1).cast("long")).alias("target_index"), F.col("n").cast("long").alias("n_turns"), body.alias("text"), aimed.alias("aimed"), size.alias("size"))
    tail = len(END) + 1
    return out.select(
        "conv_id", "example", "target_index", "n_turns", "text",
        F.when(F.col("aimed"), F.char_length("text") - F.col("size") - tail).otherwise(0).cast("long").alias("loss_start"),
        F.when(F.col("aimed"), F.col("size")).otherwise(0).cast("long").alias("loss_length"),
    )


def parsed(text: Column) -> Column:
    """The turns of an example's text: an array of (role, text)."""
    pieces = F.split(text, r"<\|im_end\|>\n", -1)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substring(p, len(START) + 1, 2147483647))
    return F.transform(turns, lambda p: F.struct(_role_back(F.substring_index(p, "\n", 1)).alias("role"), unescaped(F.substr(p, F.instr(p, "\n") + 1)).alias("text")))


def digests(ex: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    lost = unescaped(F.substr("text", F.col("loss_start") + 1, F.col("loss_length")))
    whole = F.array_join(F.transform(parsed(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = ex.select("conv_id", "example", "n_turns", F.char_length("text").cast("long").alias("chars"), F.when(F.col("target_index").isNotNull(), lost).alias("lost"), F.when(F.coalesce(F.col("target_index"), F.col("n_turns") - 1) == F.col("n_turns") - 1, F.struct(F.size(parsed(F.col("text"))).cast("long").alias("n"), F.sha2(whole, 256).alias("sha"))).alias("all"))
    each = read.groupBy("conv_id").agg(F.max("all").alias("all"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples"), F.array_sort(F.collect_list(F.struct("example", "lost"))).alias("losses"))
    loss = F.array_join(F.transform("losses", lambda x: x["lost"]), "")
    return each.select("conv_id", F.col("all.n").alias("n_turns"), F.col("all.sha").alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_examples")
