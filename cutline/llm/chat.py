"""Preference formatting: one prompt and two masked completions for each pair.

A pair is two conversations, the chosen and the rejected. The turns that both begin
with are rendered once as the prompt; what follows on either side is its
completion. Of a completion only the assistant's turns (text and end mark) are to
be trained on; their places are given as spans in code points.

Edge cases: null roles and texts count as empty; turns of one place are taken in the
order of role and text, repeats included; a side without turns has an empty
completion and leaves no common turns; where both sides are equal all turns are
prompt; turns without a pair belong to none; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, END = "<|{}|>\n", "<|end|>", "\n"
_TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("<|end|>"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def _spans(turns: Column) -> Column:
    """Places of the assistant's turns in the rendered turns, as a:b joined by commas."""

    def step(state, turn):
        begin = state["at"] + F.length(_head(turn))
        stop = begin + F.length(_body(turn))
        mine = F.array_append(state["spans"], F.concat_ws(":", begin, stop))
        return F.struct((stop + 1).alias("at"), F.when(turn["role"] == "assistant", mine).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, start, step, lambda s: s["spans"]), ",")


def preference(turns: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Turns (pair, side "chosen" or "rejected", turn, role, text) to a row for each pair.

    Gives prompt_turns, prompt, and for each side its number of turns, completion and spans.
    """
    of = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = [F.sort_array(F.collect_list(F.when(F.col("side") == side, of))).cast(_TURNS).alias(side) for side in ("chosen", "rejected")]
    paired = turns.where(F.col(pair).isNotNull()).groupBy(pair).agg(*sides)
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differs = F.array_position(same, False).cast("int")
    paired = paired.withColumn("common_", F.when(differs > 0, differs - 1).otherwise(F.size("chosen")))
    rest = {side: F.slice(F.col(side), F.col("common_") + 1, F.size(side)) for side in ("chosen", "rejected")}
    return paired.select(
        pair, F.size("chosen").cast("long").alias("chosen_turns"), F.size("rejected").cast("long").alias("rejected_turns"), F.col("common_").cast("long").alias("prompt_turns"),
        _rendered(F.slice("chosen", F.lit(1), F.col("common_"))).alias("prompt"),
        _rendered(rest["chosen"]).alias("chosen"), _spans(rest["chosen"]).alias("chosen_spans"),
        _rendered(rest["rejected"]).alias("rejected"), _spans(rest["rejected"]).alias("rejected_spans"),
    )
