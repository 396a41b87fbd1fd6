"""Preference pairs: one prompt and two masked completions from a chosen and a rejected conversation.

The longest common prefix of turns (role and text) is rendered once as the prompt; what follows in either
conversation is rendered as its completion, with a mask of runs of characters: only what an assistant says
(and the mark that ends it) is trained on. Built-in functions only.

Defined results: a null role is rendered as ``user`` and a null text as empty, and both are compared as
such; rows without a conversation id belong to no conversation; turns are ordered by number (null first),
role and text, and rows equal in all of these are one turn; a missing conversation is an empty one, so all
of the other is its completion; equal conversations are all prompt, with empty completions; an empty table
gives no pairs. A conversation becomes one row, so one task holds its turns. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_START, TURN_MIDDLE, TURN_END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order, as structs of ``role`` and ``text``."""
    one = F.struct(
        F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    rows = turns.where(F.col(f"`{conv_id}`").isNotNull()).groupBy(F.col(f"`{conv_id}`").cast("long").alias("conv_id"))
    sorted_turns = F.sort_array(F.collect_set(one))
    return rows.agg(F.transform(sorted_turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of turns that two conversations begin with alike."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def render(turns: Column) -> Column:
    """Turns as one text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN_START), t["role"], F.lit(TURN_MIDDLE), t["text"], F.lit(TURN_END))), "")


def mask(turns: Column, trained: str = TRAINED_ROLE) -> Column:
    """Runs of characters of the rendered turns: ``n_chars`` and whether they are trained on."""
    head = lambda t: F.length(t["role"]) + len(TURN_START) + len(TURN_MIDDLE)
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(head(t).alias("n_chars"), F.lit(False).alias("train")),
        F.struct((F.length(t["text"]) + len(TURN_END)).alias("n_chars"), (t["role"] == trained).alias("train")),
    )))


def preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with arrays of turns in ``chosen`` and ``rejected`` replaced by their rendered completions,
    and ``n_prompt_turns``, ``prompt``, ``chosen_mask`` and ``rejected_mask`` added."""
    none = F.array().cast("array<struct<role: string, text: string>>")
    a, b = F.coalesce(F.col(f"`{chosen}`"), none), F.coalesce(F.col(f"`{rejected}`"), none)
    new = ("n_prompt_turns", "prompt", "chosen_mask", "rejected_mask")
    others = [c for c in pairs.columns if c.lower() not in (*new, chosen.lower(), rejected.lower())]
    out = pairs.select(*[F.col(f"`{c}`") for c in others], a.alias("_a"), b.alias("_b"), common_prefix(a, b).alias("_n"))
    rest = lambda side: F.slice(F.col(side), F.col("_n") + 1, F.size(side))
    return out.select(
        *[F.col(f"`{c}`") for c in others], F.col("_n").cast("long").alias("n_prompt_turns"), render(F.slice(F.col("_a"), F.lit(1), F.col("_n"))).alias("prompt"),
        render(rest("_a")).alias(chosen), render(rest("_b")).alias(rejected), mask(rest("_a")).alias("chosen_mask"), mask(rest("_b")).alias("rejected_mask"),
    )


def neighbours(turns: DataFrame) -> DataFrame:
    """``pair_id, chosen_id, rejected_id, chosen, rejected``: conversations ``2k`` and ``2k + 1`` as a pair."""
    each = conversations(turns)
    even = F.pmod("conv_id", F.lit(2)) == 0
    side = lambda c, wanted: F.max(F.when(wanted, F.col(c)))  # noqa: E731  at most one of each side
    pair = F.shiftright("conv_id", 1)
    return each.groupBy(pair.alias("pair_id")).agg(
        side("conv_id", even).alias("chosen_id"), side("conv_id", ~even).alias("rejected_id"), side("turns", even).alias("chosen"), side("turns", ~even).alias("rejected"),
    )
