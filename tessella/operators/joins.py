"""Joins: enrichment, outer merges, interval lookup, pairing with a small literal table."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.sizing import small_table
from tessella.operators.scan import carried, largest_before, last_known


def inner_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "inner")


def left_enrich(df: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of a dimension; rows without a match get nulls.

    Catalyst broadcasts the dimension when its statistics show it to be small.
    """
    return df.join(dimension, list(keys), "left")


def full_outer(frames: Sequence[DataFrame], keys: Sequence[str], fill: object = None) -> DataFrame:
    """Merge several per-key frames, keeping every key; ``fill`` replaces nulls outside of the keys."""
    merged = reduce(lambda a, b: a.join(b, list(keys), "full"), frames)
    return merged if fill is None else merged.na.fill(fill, [c for c in merged.columns if c not in keys])


def pair_with_all(df: DataFrame, small: DataFrame, max_rows: int = 1_000) -> DataFrame:
    """Every row of ``df`` with every row of a small table.

    Up to ``max_rows`` rows become an array literal that each task explodes in place: no join, no
    shuffle. More rows are dealt into blocks of about that many; every row of ``df`` meets every block
    in a join on the block's number and explodes it there.
    """
    whole = F.struct(*[F.col(f"`{f.name}`") for f in small.schema.fields])
    rows = small.limit(max_rows + 1).collect()
    if len(rows) <= max_rows:
        cells = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in small.schema.fields]) for r in rows]
        paired = df.withColumn("_pairs", F.array(*cells).cast(T.ArrayType(small.schema)))
    else:
        blocks = math.ceil(small.count() / max_rows)
        dealt = small.groupBy(F.pmod(F.xxhash64(whole), F.lit(blocks)).alias("_block")).agg(F.collect_list(whole).alias("_pairs"))
        paired = df.withColumn("_block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)"))).join(dealt, "_block")
    return paired.withColumn("_pair", F.explode("_pairs")).select(*[F.col(f"`{c}`") for c in df.columns], "_pair.*")


def interval_lookup(
    df: DataFrame,
    day: str | Column,
    intervals: DataFrame,
    start: str,
    end: str,
    on: Sequence[str],
    values: Sequence[str],
) -> DataFrame:
    """Left join with the interval that contains the day; of several the earliest start wins.

    Each interval is unrolled to those of its days that lie within the days of ``df``, and one winner
    is kept per key and day, so the large side takes part in a plain equi-join and never fans out.
    An interval that ends before it starts holds no day.
    """
    day = F.col(day) if isinstance(day, str) else day
    span = df.agg(F.min(day.cast("date")).alias("low"), F.max(day.cast("date")).alias("high")).first()
    first = F.greatest(F.col(start).cast("date"), F.lit(span["low"]).cast("date"))
    last = F.least(F.col(end).cast("date"), F.lit(span["high"]).cast("date"))
    days = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 day")))
    winner = F.min_by(F.struct(*values), F.struct(F.col(start), F.col(end)))
    daily = (
        intervals.select(*on, start, end, *values, F.explode(days).alias("_day"))
        .groupBy(*on, "_day")
        .agg(winner.alias("_hit"))
        .select(*on, "_day", "_hit.*")
    )
    return df.withColumn("_day", day.cast("date")).join(daily, [*on, "_day"], "left").drop("_day")


def interval_at(df: DataFrame, ts: str, intervals: DataFrame, start: str, end: str, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left join with the interval that contains a moment, both ends included; of several the earliest start
    wins, then the earliest end.

    Intervals of a key are read in the order of their start. An instant up to the latest end before is taken
    already, so each interval wins on what lies beyond that: the winners are disjoint, whatever overlaps.
    Moments and winners are then read together in order of time, and the last winner is carried along. Both
    steps go through ranges (``scan``), so neither the length of an interval nor a key's share of the rows
    matters, and no row is copied. Null moments and keys have no interval; intervals with a null or reversed
    end hold none.
    """
    sides = intervals.where(F.col(start).isNotNull() & (F.col(end) >= F.col(start)))
    for c in on:
        sides = sides.where(F.col(c).isNotNull())
    ranked = carried(sides.select(*on, F.col(start).alias("_start"), F.col(end).alias("_end"), F.struct(*values).alias("_value")), on, ["_start", "_end"], largest_before("_end", "_taken"))
    late = F.col("_taken") >= F.col("_start")
    winners = ranked.where(F.col("_taken").isNull() | (F.col("_end") > F.col("_taken"))).select(
        *on, F.when(late, F.col("_taken")).otherwise(F.col("_start")).alias("_at_time"),
        F.when(late, 2).otherwise(0).alias("_turn"), F.struct(F.col("_end").alias("until"), F.col("_value").alias("value")).alias("_hit"),
    )
    # winners from their start on come before moments, those from behind an instant after them
    asked = df.select(*on, F.col(ts).alias("_at_time"), F.lit(1).alias("_turn"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    both = winners.unionByName(asked, allowMissingColumns=True)
    found = carried(both, on, ["_at_time", "_turn"], last_known(["_hit"])).where(F.col("_turn") == 1)
    known = F.col("_at_time") <= F.col("_hit.until")
    for c in on:
        known = known & F.col(c).isNotNull()
    return found.select("_row.*", *[F.when(known, F.col("_hit.value")[v]).alias(v) for v in values])


def rank_weight(position: str | Column, size: int = 20) -> Column:
    """1 for the first place down to 1/size for the last."""
    position = F.col(position) if isinstance(position, str) else position
    return (F.lit(size + 1) - position) / F.lit(size)


def dictionary_rejoin(df: DataFrame, source: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Add the label column for each code column, ``{code: label}`` as found in ``source``."""
    for code, label in pairs.items():
        words, fits = small_table(source.select(code, label).distinct())
        df = df.join(F.broadcast(words) if fits else words, code, "left")
    return df
