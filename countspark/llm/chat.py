"""Chat examples by prefix-target expansion: every assistant turn becomes an example with all turns before it as context.

Only the reply of the last turn of an example is trainable. Turns are marked by control strings; the same strings inside a text or a role
are broken up by a backslash, and backslashes are doubled, so the text can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The marks of a turn.
HEAD, SPLIT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: What a text must not hold unbroken: marks of this and of other common templates.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|<?/?SYS>>)"


def escape(text: Column) -> Column:
    """Text in which no control string is left."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(CONTROL), F.lit("$1\\\\"))


def unescape(text: Column) -> Column:
    """The text that was escaped."""
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def chat_examples(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """``(conversation, example, n_turns, formatted, loss_start, loss_end)``: one row per ``target`` turn, in order from 0.

    ``formatted`` holds all turns up to that one; the characters (code points) from ``loss_start`` to before ``loss_end`` are the reply
    and the only trainable ones. Turns behind the last reply, or a conversation without any, make one more example without trainable
    characters, so that the examples of a conversation hold all of it.

    Turns are ordered by ``turn`` (null first), ties by role and text. Null texts and roles are empty, a null conversation is one of its
    own, repeated rows are turns of their own, an empty table gives an empty result, other columns are ignored. A conversation is put
    together in one row, as its examples hold all of it; an example is built when its row is made, never all of a conversation at once.
    """
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conversation).alias("conv"), F.struct(F.col(turn).alias("turn"), clean(role).alias("role"), clean(text).alias("text")).alias("t"))
    said = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    marked = F.transform("turns", lambda t: F.concat(F.lit(HEAD), escape(t["role"]), F.lit(SPLIT), escape(t["text"]), F.lit(END)))
    is_target = lambda i: F.element_at("turns", i)["role"] == target
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), is_target)
    last = F.size("turns")
    ends = F.when(is_target(last), ends).otherwise(F.array_append(ends, last))
    said = said.select("conv", marked.alias("pieces"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.char_length(escape(t["text"])).alias("n"))).alias("shape"), ends.alias("ends"))
    each = said.select("conv", "pieces", "shape", F.posexplode("ends").alias("example", "stop"))
    formatted = F.array_join(F.slice("pieces", F.lit(1), F.col("stop")), "")
    built = each.select("conv", "example", F.col("stop").alias("n_turns"), formatted.alias("formatted"), F.element_at("shape", F.col("stop")).alias("end"))
    total = F.char_length("formatted")
    trained = F.col("end.role") == target
    stop = total - len(END)
    return built.select(F.col("conv").alias(conversation), F.col("example").cast("bigint").alias("example"), F.col("n_turns").cast("bigint").alias("n_turns"), "formatted",
                        F.when(trained, stop - F.col("end.n")).otherwise(total).cast("bigint").alias("loss_start"), F.when(trained, stop).otherwise(total).cast("bigint").alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    parts = F.filter(F.split(formatted, F.lit("\\Q" + END + "\\E")), lambda p: p != "")
    parts = F.transform(parts, lambda p: F.substr(p, F.lit(len(HEAD) + 1)))
    return F.transform(parts, lambda p: F.struct(unescape(F.substring_index(p, SPLIT, 1)).alias("role"), unescape(F.substr(p, F.locate(SPLIT, p) + len(SPLIT))).alias("text")))


def chat_digest(examples: DataFrame, *, conversation: str = "conv_id") -> DataFrame:
    """What the examples of each conversation hold, read back from the formatted texts."""
    loss = unescape(F.substr("formatted", F.col("loss_start") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    turns = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    parts = examples.select(F.col(conversation).alias("conv"), "example", "n_turns", "formatted", loss.alias("loss"), F.char_length("formatted").alias("n"))
    per = parts.groupBy("conv").agg(F.max_by("formatted", "n_turns").alias("formatted"), F.sum("n").alias("formatted_chars"), F.count(F.lit(1)).alias("n_examples"),
                                    F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"))
    per = per.withColumn("turns", turns)
    return per.select(F.col("conv").alias(conversation), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
                      F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                      F.col("formatted_chars").cast("bigint").alias("formatted_chars"), F.col("n_examples").cast("bigint").alias("n_examples"))
