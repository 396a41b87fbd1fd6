"""Fixed time windows, regular grids, gap filling, lead targets, splits.

Rows are merged to one per series and bucket first. What is carried along a series (the next bucket, the
last known value, a row's place) goes through ``scan``, so a series may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import bucket_start, drop_missing
from tessella.operators.scan import carried, lags as lagged, last_known, next_row, numbered, with_totals

WIDTH = "3 hours"


def build_timestamp(day: str | Column, clock: str | Column) -> Column:
    """Timestamp (without zone) from a date and a ``HH:mm`` text."""
    day = F.col(day) if isinstance(day, str) else day
    clock = F.col(clock) if isinstance(clock, str) else clock
    text = F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), clock)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")


def tumble(df: DataFrame, ts: str, keys: Sequence[str], sums: Sequence[str], count: str = "N_APPARATI", width: str = WIDTH) -> DataFrame:
    """Sums and row count per fixed window and key, in one aggregation."""
    return (
        drop_missing(df, [ts, *keys])
        .groupBy(bucket_start(ts, width).alias(ts), *keys)
        .agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias(count))
    )


def regular_grid(df: DataFrame, ts: str, keys: Sequence[str], width: str = WIDTH) -> DataFrame:
    """Every bucket from the first to the last one of each series."""
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    return ends.select(*keys, F.explode(F.sequence("_first", "_last", F.expr(f"interval {width}"))).alias(ts))


def resample(df: DataFrame, ts: str, keys: Sequence[str], value: str, how: str = "sum", width: str = WIDTH) -> DataFrame:
    """One value per bucket of the grid; empty buckets are 0 for ``sum`` and null for ``mean``."""
    agg = {"sum": F.sum, "mean": F.avg}[how](value).alias(value)
    merged = drop_missing(df, [ts, *keys]).groupBy(*keys, bucket_start(ts, width).alias(ts)).agg(agg)
    filled = on_grid(merged, ts, keys, width)
    return filled.withColumn(value, F.coalesce(value, F.lit(0.0))) if how == "sum" else filled


def on_grid(df: DataFrame, ts: str, keys: Sequence[str], width: str = WIDTH) -> DataFrame:
    """The series with a row for every bucket; missing ones have nulls.

    Each row is followed by the empty buckets up to the next one, so the series is read once and no
    join is needed. Expects one row per series and bucket.
    """
    rows = carried(df, keys, [ts], next_row([ts], "_next"))
    values = [c for c in df.columns if c not in (*keys, ts)]
    slots = _slots(rows, ts, F.col("_next")[ts], width)
    return slots.select(*keys, F.col("_slot").alias(ts), *[F.when(F.col("_gap") == 0, F.col(c)).alias(c) for c in values])


def _slots(rows: DataFrame, ts: str, following: Column, width: str) -> DataFrame:
    """Each row once for its own bucket (``_gap`` 0) and once for each empty one behind it: ``_slot``."""
    step = F.expr(f"interval {width}")
    last = F.coalesce(F.greatest(following - step, F.col(ts)), F.col(ts))
    return rows.select("*", F.posexplode(F.sequence(F.col(ts), last, step)).alias("_gap", "_slot"))


def forward_fill(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str) -> DataFrame:
    """Nulls take the last value before them in their series."""
    return carried(df, keys, [order], last_known(columns))


def lead_target(df: DataFrame, value: str, keys: Sequence[str], order: str, name: str = "PRED") -> DataFrame:
    """The next value of the series as target; 0 for the last row."""
    rows = carried(df, keys, [order], next_row([value], "_next"))
    return rows.withColumn(name, F.coalesce(F.col("_next")[value], F.lit(0.0))).drop("_next")


def min_max_scale(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Scale to 0 … 1 within each series; a constant column becomes 0."""
    ends = {f"_{end}_{i}": f(c) for i, c in enumerate(columns) for end, f in (("low", F.min), ("high", F.max))}
    rows, scaled = with_totals(df, keys, ends), {}
    for i, c in enumerate(columns):
        low, high = F.col(f"_low_{i}"), F.col(f"_high_{i}")
        scaled[c] = F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.when(F.col(c).isNotNull(), F.lit(0.0)))
    return rows.withColumns(scaled).select(*df.columns)


def one_row_per_bucket(df: DataFrame, ts: str, key: str, sums: Sequence[str], maxima: Sequence[str]) -> DataFrame:
    """Merge rows that share series and bucket, such as two day types: sums add up, the rest takes the maximum."""
    return df.groupBy(key, ts).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])


def series_for_key(
    df: DataFrame,
    ts: str = "DATA",
    key: str = "PROVINCIA",
    sums: Sequence[str] = ("MAX_DS", "SOPRA_SOGLIA_GIALLA", "SOPRA_SOGLIA_ROSSA", "SOPRA_CAPACITA", "N_APPARATI"),
    state: Sequence[str] = ("TIPO_GIORNO_DS",),
    event: Sequence[str] = ("KPI",),
    target: str | None = "PRED",
    scale: bool = True,
    width: str = WIDTH,
) -> DataFrame:
    """Training series of all keys at once.

    Regular grid, measures and event columns 0 in gaps, state columns carried forward, the next
    value of the first measure as target, everything scaled to 0 … 1 per series.
    """
    merged = one_row_per_bucket(df, ts, key, sums, [*state, *event])
    merged = merged.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (*sums, *event)})
    rows = carried(merged, [key], [ts], next_row([ts, sums[0]], "_next"), last_known(state))
    slots = _slots(rows, ts, F.col("_next")[ts], width)
    here = [F.when(F.col("_gap") == 0, F.col(c)).otherwise(0.0).alias(c) for c in (*sums, *event)]
    follows = F.col("_slot") + F.expr(f"interval {width}") == F.col("_next")[ts]
    pred = [F.when(follows, F.col("_next")[sums[0]]).otherwise(0.0).alias(target)] if target else []
    full = slots.select(key, F.col("_slot").alias(ts), *here, *state, *pred).select(key, ts, *sums, *state, *event, *([target] if target else []))
    columns = [*sums, *state, *event, *([target] if target else [])]
    return min_max_scale(full, columns, [key]) if scale else full


def chronological_split(df: DataFrame, ts: str, key: str, train_share: float = 0.85, fit_share: float = 0.9, per_day: int = 8) -> DataFrame:
    """Mark rows ``train``, ``val`` or ``test`` by position in time.

    The cut is ``int(days * per_day * train_share)`` rows; of these the first
    ``int(cut * fit_share)`` train and the rest validate.
    """
    day = F.col(ts).cast("date")
    placed = numbered(with_totals(df, [key], {"_days": F.datediff(F.max(day), F.min(day))}), [key], [ts], "_at")
    placed = placed.withColumn("_cut", F.floor(F.col("_days") * F.lit(per_day) * F.lit(train_share)))
    part = F.when(F.col("_at") < F.floor(F.col("_cut") * F.lit(fit_share)), "train").when(F.col("_at") < F.col("_cut"), "val").otherwise("test")
    return placed.withColumn("split", part).drop("_at", "_cut", "_days")


def shift_time(df: DataFrame, ts: str, by: str = "3 hours") -> DataFrame:
    """Move timestamps forward, e.g. from the input bucket to the predicted one."""
    return df.withColumn(ts, F.col(ts) + F.expr(f"interval {by}"))


def weekly_overlay(df: DataFrame, ts: str, keys: Sequence[str], value: str) -> DataFrame:
    """Long form ``keys, week, offset_hours, value``: the same hour of each week side by side."""
    week = F.date_trunc("week", F.col(ts)).cast("timestamp_ntz")
    offset = F.timestamp_diff("HOUR", week, F.col(ts))
    return (
        df.groupBy(*keys, week.cast("date").alias("week"), offset.alias("offset_hours")).agg(F.sum(value).alias(value))
    )


def weeks_wide(df: DataFrame, keys: Sequence[str], weeks: Sequence, value: str) -> DataFrame:
    """One column per given week, one row per key and hour of the week."""
    return df.groupBy(*keys, "offset_hours").pivot("week", list(weeks)).agg(F.first(value))


def lag_features(df: DataFrame, value: str, keys: Sequence[str], order: str, lags: int = 8) -> DataFrame:
    """``lag_1 … lag_n`` of a value within its series, 0 before its start."""
    return lagged(df, value, keys, [order], lags, 0.0)


def event_kpi_shift(df: DataFrame, ts: str, keys: Sequence[str], value: str, width: str = WIDTH) -> DataFrame:
    """Move events to the bucket before the one they fall in (an hour later), one row per value.

    Two values in a bucket stay two rows.
    """
    later = F.window(F.col(ts) + F.expr("interval 1 hour"), width).start
    return df.select(*keys, (later - F.expr(f"interval {width}")).alias(ts), value).distinct()


def time_slices(df: DataFrame, ts: str, start: str, days: int = 7) -> DataFrame:
    """Add ``slice``, the first day of the run of ``days`` days (weeks by default) a row falls in, counted from ``start``."""
    first = F.lit(start).cast("date")
    number = F.floor(F.datediff(F.col(ts).cast("date"), first) / days).cast("int")
    return df.where(F.col(ts).cast("date") >= first).withColumn("slice", F.date_add(first, number * days))
