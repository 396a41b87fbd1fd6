"""Group aggregations, top-n and counting reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.columns import drop_missing
from tessella.functions.quantiles import exact_quantiles
from tessella.functions.sizing import small_table


def count_by(df: DataFrame, keys: Sequence[str], name: str = "count", drop_null: bool = True) -> DataFrame:
    """Rows per key, most first, ties by key."""
    source = drop_missing(df, keys) if drop_null else df
    return source.groupBy(*keys).agg(F.count("*").alias(name)).orderBy(F.desc(name), *keys)


def multi_rollup(df: DataFrame, keys: Sequence[str], flags: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Per key the maximum of each flag, ``total_`` and ``mean_`` of each number, in one aggregation."""
    return (
        drop_missing(df, keys)
        .groupBy(*keys)
        .agg(
            *[F.max(f"`{c}`").alias(c) for c in flags],
            *[F.sum(c).alias(f"total_{c}") for c in numbers],
            *[F.avg(c).alias(f"mean_{c}") for c in numbers],
        )
    )


def present_in_all_periods(df: DataFrame, id_column: str, keys: Sequence[str]) -> DataFrame:
    """Rows of ids whose number of rows per key equals the largest such number.

    The counts are small next to the rows; the maximum comes in as a scalar.
    """
    counts = drop_missing(df, keys).groupBy(*keys).agg(F.count("*").alias("_n"))
    full = counts.where(F.col("_n") == counts.agg(F.max("_n")).scalar()).select(id_column)
    return df.join(full, id_column, "left_semi")


def slot_report(df: DataFrame, slot: str, value: str, limits: Mapping[str, str], count: str, n: int = 20, last: bool = True) -> DataFrame:
    """Per time slot: rows, rows above each limit, sum and maximum; the first or last ``n`` slots."""
    report = df.groupBy(slot).agg(
        F.count("*").alias(count),
        *[F.count_if(F.col(f"`{limit}`") < F.col(f"`{value}`")).alias(name) for name, limit in limits.items()],
        F.sum(f"`{value}`").alias(f"sum_{value}"),
        F.max(f"`{value}`").alias(f"max_{value}"),
    )
    cut = report.orderBy(F.desc(slot) if last else F.asc(slot)).limit(n)
    return cut.orderBy(slot)


def mean_by(df: DataFrame, keys: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in numbers])


def sum_by(df: DataFrame, keys: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numbers])


def mean_median(df: DataFrame, value: str) -> DataFrame:
    mean = df.agg(F.avg(value).alias("mean"))
    middle = exact_quantiles(df, value, [0.5]).first()["quantiles"][0]
    return mean.withColumn("median", F.lit(middle).cast("double"))


def span(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value of each column."""
    return df.agg(*[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("min", F.min), ("max", F.max))])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group; tasks cut to ``n`` rows before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def first_rows(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def last_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Last ``n`` rows in the given ascending order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; missing columns are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def modes(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long table ``group…, column, value``: the most frequent value, ties to the smallest.

    Counts are merged before the choice, so no group is held in one buffer.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    counted = (
        drop_missing(df.select(*group, F.explode(cells).alias("_c")).select(*group, "_c.*"))
        .groupBy(*group, "column", "value").agg(F.count("*").alias("n"))
    )
    return counted.groupBy(*group, "column").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("value"))


def medians(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long table ``group…, column, value`` with exact medians."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(*group, F.explode(cells).alias("_c")).select(*group, "_c.*")
    found = exact_quantiles(long, "value", [0.5], by=[*group, "column"])
    return found.select(*group, "column", F.col("quantiles")[0].alias("value"))


def centroids(df: DataFrame, group: str, columns: Sequence[str], encoded: str = "_encoded") -> DataFrame:
    """One row per group: mode of the encoded columns, median of the others."""
    codes = [c for c in columns if c.endswith(encoded)]
    numbers = [c for c in columns if not c.endswith(encoded)]
    parts = []
    if codes:
        parts.append(modes(df, [group], codes))
    if numbers:
        parts.append(medians(df, [group], numbers))
    cells, _ = small_table(union_all(*parts))
    return cells.groupBy(group).pivot("column", list(columns)).agg(F.first("value"))


def filter_funnel(df: DataFrame, steps: Mapping[str, Column], id_column: str) -> DataFrame:
    """Rows and distinct ids left after each of several filters applied in turn, in one scan."""
    flags, held = [], F.lit(True)
    for condition in steps.values():
        held = held & F.coalesce(condition, F.lit(False))
        flags.append(held)
    # rows are merged to one per id before the ids are counted
    best = df.groupBy(id_column).agg(F.count("*").alias("r0"), *[F.count_if(f).alias(f"r{i + 1}") for i, f in enumerate(flags)])
    names = ["all", *steps]
    wide = best.agg(
        *[F.coalesce(F.sum(f"r{i}"), F.lit(0)).alias(f"rows{i}") for i in range(len(names))],
        *[F.count_if((F.col(f"r{i}") > 0) & F.col(id_column).isNotNull()).alias(f"ids{i}") for i in range(len(names))],
    )
    rows = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"rows{i}").alias("rows"), F.col(f"ids{i}").alias("ids"))
        for i, n in enumerate(names)
    ])
    return wide.select(F.explode(rows).alias("_s")).select("_s.*")


def observed_funnel(df: DataFrame, steps: Mapping[str, Column]) -> tuple[DataFrame, Callable[[], list[tuple[int, str, int]]]]:
    """``df`` filtered step by step, and a function that gives ``step, name, rows`` of every step once the result
    was written: the running job counts as it goes, no row is read again for it. The result must run once."""
    seen = [Observation()]
    df = df.observe(seen[0], F.count("*").alias("rows"))
    for condition in steps.values():
        seen.append(Observation())
        df = df.where(condition).observe(seen[-1], F.count("*").alias("rows"))
    return df, lambda: [(i, name, o.get["rows"]) for i, (name, o) in enumerate(zip(["all", *steps], seen))]
