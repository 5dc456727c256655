"""Preference formatting of conversation pairs.

The longest common prefix of turns (same role and text) of the chosen and the rejected conversation is rendered once, as
the prompt; what follows in either is rendered as its completion, with the spans of characters that count for
training: the text and the end sign of the assistant's turns.

Everything is DataFrame operations: turns are gathered by conversation in order, conversations meet by the pairs' ids,
and higher-order functions compare and render them. A conversation is one row of the result, so its turns
are brought together; conversations, not copies of their texts, are the keys, so a common first turn gathers nothing.

Edge cases: turns without a conversation id take no part. A null role or text counts as empty; turns without a number
come first; turns of one number are ordered by role and text and all stay. A pair that lacks a conversation (or names one
without turns) has an empty prompt and a null completion on that side. Equal conversations give two empty completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetrix.llm.common import pick

# The marks of a rendered turn.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """conv and turns (role and text in order) of each conversation."""
    rows = pick(turns, conv=conv_id, turn=turn, role=role, text=text).where("conv is not null")
    turn_row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv").agg(F.sort_array(F.collect_list(turn_row)).alias("turns")).select(
        "conv", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def rendered(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))))


def spans(turns: Column) -> Column:
    """start and size, in characters of the rendered turns, of what the assistant says."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        head = F.lit(len(OPEN) + len(CLOSE)) + F.length(t["role"])
        body = F.length(t["text"]) + F.lit(len(END))
        mine = F.array(F.struct((state["at"] + head).alias("start"), body.alias("size")))
        return F.struct((state["at"] + head + body).alias("at"), F.when(
            t["role"] == TRAINED, F.concat(state["spans"], mine)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda state: state["spans"])


def common_turns(one: Column, other: Column) -> Column:
    """Turns at the start that are the same in both."""
    least = F.least(F.size(one), F.size(other))
    differ = F.array_position(F.zip_with(F.slice(one, 1, least), F.slice(other, 1, least), lambda a, b: a != b), True)
    return F.when(differ == 0, least).otherwise((differ - 1).cast("int"))


def preferences(turns: DataFrame, pairs: DataFrame, pair_id: str = "pair_id", chosen: str = "chosen",
                rejected: str = "rejected", **names: str) -> DataFrame:
    """pair_id, n_common, prompt and for either side the completion and its trained spans."""
    talks = conversations(turns, **names)
    asked = pick(pairs, pair=pair_id, a=chosen, b=rejected)
    joined = (asked.join(talks.select(F.col("conv").alias("a"), F.col("turns").alias("ta")), "a", "left")
              .join(talks.select(F.col("conv").alias("b"), F.col("turns").alias("tb")), "b", "left"))
    both = F.col("ta").isNotNull() & F.col("tb").isNotNull()
    cut = joined.withColumn("n", F.when(both, common_turns(F.col("ta"), F.col("tb"))).otherwise(F.lit(0)))

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))

    return cut.withColumns({"ra": rest("ta"), "rb": rest("tb")}).select(
        F.col("pair").alias("pair_id"), F.col("n").alias("n_common"),
        F.when(F.col("n") > 0, rendered(F.slice("ta", F.lit(1), F.col("n")))).otherwise(F.lit("")).alias("prompt"),
        F.when(F.col("ta").isNotNull(), rendered(F.col("ra"))).alias("chosen"), spans(F.col("ra")).alias("chosen_spans"),
        F.when(F.col("tb").isNotNull(), rendered(F.col("rb"))).alias("rejected"), spans(F.col("rb")).alias("rejected_spans"))
