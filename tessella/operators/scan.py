"""Ordered values along a key, in two steps, for keys that hold any share of the rows.

A window over a key brings all its rows to one task. Here the rows are dealt by ranges of key and order,
so a long key lies in several parts, one behind the other. Inside a part values are carried along by a
window over key and part, whose rows are bounded by the size of a part. What goes over from part to part
is one row for each key and part: first and last values, counts. It is carried along the key's parts, as
many rows as the key has parts, and joined back on key and part.

Rows that agree in key and order follow each other in the order Spark reads them, null keys are a key, and
nulls in the order come first. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessella.session import cut

PLACE_BITS = 33  # of monotonically_increasing_id, those that count within a partition
BLOCK = 4096


class Carry(NamedTuple):
    """Windows over the rows of a part, aggregates of a part, windows over those aggregates along a key's
    parts, and the columns made of all; a part's own place is ``_at``."""

    inside: dict[str, Column]
    totals: dict[str, Column]
    along: dict[str, Column]
    result: dict[str, Column]


Maker = Callable[[WindowSpec, WindowSpec], Carry]


def before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def position(to: str = "position") -> Maker:
    """The place of a row within its key, from 0."""

    def make(inside: WindowSpec, parts: WindowSpec) -> Carry:
        shift = F.coalesce(F.sum("_rows").over(before(parts)), F.lit(0)) - F.col("_least")
        return Carry({}, {"_least": F.min("_at"), "_rows": F.count("*")}, {"_shift": shift}, {to: F.col("_at") + F.col("_shift")})

    return make


def next_row(columns: Sequence[str], to: str = "next") -> Maker:
    """A struct of ``columns`` of the row behind within the key, null for the last one."""
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])

    def make(inside: WindowSpec, parts: WindowSpec) -> Carry:
        return Carry(
            {"_behind": F.lead(whole).over(inside)}, {"_foremost": F.min_by(whole, "_at")}, {"_beyond": F.lead("_foremost").over(parts)},
            {to: F.coalesce("_behind", "_beyond")},
        )

    return make


def last_known(columns: Sequence[str]) -> Maker:
    """Nulls in ``columns`` take the last value before them within the key."""

    def make(inside: WindowSpec, parts: WindowSpec) -> Carry:
        here, ends, along, result = {}, {}, {}, {}
        for i, c in enumerate(columns):
            value = F.col(f"`{c}`")
            here[f"_known_{i}"] = F.last(value, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
            ends[f"_final_{i}"] = F.max_by(value, F.when(value.isNotNull(), F.col("_at")))
            along[f"_came_{i}"] = F.last(f"_final_{i}", ignorenulls=True).over(before(parts))
            result[c] = F.coalesce(f"_known_{i}", f"_came_{i}")
        return Carry(here, ends, along, result)

    return make


def largest_before(column: str, to: str) -> Maker:
    """The largest value of ``column`` in the rows before within the key, null for the first one."""

    def make(inside: WindowSpec, parts: WindowSpec) -> Carry:
        return Carry(
            {"_top_here": F.max(f"`{column}`").over(before(inside))}, {"_top": F.max(f"`{column}`")}, {"_top_ahead": F.max("_top").over(before(parts))},
            {to: F.greatest("_top_here", "_top_ahead")},
        )

    return make


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], *makers: Maker, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """``df`` with what each of ``makers`` carries along ``keys`` in ``order``.

    ``keep`` makes the dealt table stable: a checkpoint, or a function that writes and reads it again.
    """
    by = [F.col(f"`{c}`").asc_nulls_first() for c in (*keys, *order)]
    # the place where a row is read tells equal rows apart, so that they can be dealt to several parts
    rows = df.withColumn("_read", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*by, F.col("_read").asc()).sortWithinPartitions(*by, F.col("_read").asc()).drop("_read")
    place = F.monotonically_increasing_id()
    rows = keep(rows.select("*", F.shiftright(place, PLACE_BITS).alias("_part"), place.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("_at")))

    names = [f"_key_{i}" for i in range(len(keys))]
    inside = Window.partitionBy(*[F.col(f"`{c}`") for c in keys], "_part").orderBy("_at")
    carries = [make(inside, Window.partitionBy(*names).orderBy("_of")) for make in makers]
    merged = lambda field: {n: c for x in carries for n, c in getattr(x, field).items()}
    ends = rows.groupBy(*[F.col(f"`{c}`").alias(n) for c, n in zip(keys, names)], F.col("_part").alias("_of")).agg(*[c.alias(n) for n, c in merged("totals").items()])
    ends = ends.select(*names, "_of", *[c.alias(n) for n, c in merged("along").items()])
    if merged("inside"):
        rows = rows.withColumns(merged("inside"))
    same = rows["_part"] == ends["_of"]
    for c, n in zip(keys, names):
        same = same & rows[f"`{c}`"].eqNullSafe(ends[n])
    new = merged("result")
    return rows.join(ends, same).select(*[F.col(f"`{c}`") for c in df.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], to: str = "position", keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Add ``to``: the place of a row within its key, from 0."""
    return carried(df, keys, order, position(to), keep=keep)


def lags(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], n: int, fill: object = None, prefix: str = "lag_") -> DataFrame:
    """Add ``lag_1 … lag_n``: the value that many rows before within the key, ``fill`` where there is none or null.

    Rows are numbered and cut into blocks of ``BLOCK`` places; the last ``n`` of a block are also shown to the
    next one, so a window sees at most a block.
    """
    rows = numbered(df, keys, order, "_place")
    block = F.floor(F.col("_place") / BLOCK)
    shown = F.when(F.col("_place") % BLOCK >= BLOCK - n, F.array(block, block + 1)).otherwise(F.array(block))
    rows = rows.select("*", block.alias("_home"), F.explode(shown).alias("_block"))
    window = Window.partitionBy(*[F.col(f"`{c}`") for c in keys], "_block").orderBy("_place")
    new = {f"{prefix}{i}": F.coalesce(F.lag(F.col(f"`{value}`"), i).over(window), F.lit(fill)) for i in range(1, n + 1)}
    return rows.withColumns(new).where("_home = _block").select(*[F.col(f"`{c}`") for c in df.columns if c not in new], *new)


def with_totals(df: DataFrame, keys: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Add aggregates of each key to its rows: merged before they are shuffled, joined back one row a key."""
    names = [f"_key_{i}" for i in range(len(keys))]
    table = df.groupBy(*[F.col(f"`{c}`").alias(n) for c, n in zip(keys, names)]).agg(*[c.alias(n) for n, c in totals.items()])
    same = F.lit(True)
    for c, n in zip(keys, names):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(n))
    return df.join(table, same).drop(*names)
