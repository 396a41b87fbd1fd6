"""Column profiles, quantile reports, histograms, correlation, classification counts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.columns import drop_missing, nan_to_null
from tessella.functions.quantiles import exact_quantiles
from tessella.functions.sizing import attach, small_table
from tessella.operators.clean import numeric_columns, text_columns


def _cells(df: DataFrame, columns: Sequence[str], as_type: str) -> DataFrame:
    """Long form ``column, value`` made in place, without a shuffle."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(as_type).alias("value")) for c in columns]
    return df.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def _stack(one_row: DataFrame, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn one wide row of aggregates into a long table."""
    structs = [F.struct(*[c.alias(name) for name, c in row.items()]) for row in rows]
    return one_row.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")


def distinct_profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct values per column and whether the column is a unique key."""
    columns = list(columns) if columns is not None else text_columns(df)
    count = F.approx_count_distinct if approximate else F.count_distinct
    wide = df.agg(F.count("*").alias("_rows"), *[count(f"`{c}`").alias(f"_d{i}") for i, c in enumerate(columns)])
    return _stack(wide, [
        {"column": F.lit(c), "distinct_values": F.col(f"_d{i}"), "is_unique_key": F.col(f"_d{i}") == F.col("_rows")}
        for i, c in enumerate(columns)
    ])


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, many: int = 10, top: int = 5) -> DataFrame:
    """Counts of the values of each text column; columns with more than ``many`` values show the ``top``."""
    columns = list(columns) if columns is not None else text_columns(df)
    counts = _cells(df, columns, "string").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("count"))
    distinct = counts.groupBy("column").agg(F.count("*").alias("distinct_values"))
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    shown = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(many, top))
    return (
        shown.join(F.broadcast(distinct), "column")  # one row per column of the frame
        .where((F.col("distinct_values") <= many) | (F.col("rank") <= top))
    )


def multi_value_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return (
        df.where(F.col(key).isNotNull()).groupBy(key)
        .agg(F.count_distinct(value).alias("distinct_values")).where("distinct_values > 1")
    )


def key_check(df: DataFrame, keys: Sequence[str], others: Sequence[str]) -> DataFrame:
    """Distinct keys against distinct keys with further columns; equal if the keys decide the rest."""
    wide = df.agg(
        F.count_distinct(F.struct(*keys)).alias("distinct_keys"),
        F.count_distinct(F.struct(*keys, *others)).alias("distinct_with_others"),
    )
    return wide.withColumn("is_key", F.col("distinct_keys") == F.col("distinct_with_others"))


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column, as a number and as a share of all rows, most first."""
    columns = list(columns) if columns is not None else df.columns
    wide = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_m{i}") for i, c in enumerate(columns)])
    long = _stack(wide, [
        {"column": F.lit(c), "missing": F.col(f"_m{i}"), "share": F.try_divide(F.col(f"_m{i}"), F.col("_rows"))}
        for i, c in enumerate(columns)
    ])
    return long.orderBy(F.desc("missing"), "column")


def describe(df: DataFrame, columns: Sequence[str] | None = None, by: str | None = None) -> DataFrame:
    """Count, mean, std (ddof 1), min, exact quartiles and max per numeric column, also per class."""
    columns = list(columns) if columns is not None else [c for c in numeric_columns(df) if c != by]
    keys = [by] if by else []
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    long = df.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")
    keys.append("column")
    basic = long.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quarters = exact_quantiles(long, "value", [0.25, 0.5, 0.75], by=keys)
    quarters = quarters.select(*keys, *[F.col("quantiles")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))])
    return basic.join(quarters, keys, "left").select(*keys, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Long table ``by…, prob, quantile`` of exact quantiles."""
    found = exact_quantiles(df, value, probs, by)
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.col("quantiles").alias("quantile"))
    return found.select(*by, F.explode(pairs).alias("_q")).select(*by, F.col("_q.prob"), F.col("_q.quantile"))


def quantile_buckets(df: DataFrame, value: str, source: DataFrame | None = None, probs: tuple[float, float] = (0.75, 0.95), unit: str = "hours") -> DataFrame:
    """Add ``bucket`` (0 below the first quantile of ``source``, 1 below the second, 2 above) and its label."""
    low, high = exact_quantiles(source if source is not None else df, value, probs).first()["quantiles"]
    v = F.col(value)
    # fixed values: the wording of the labels
    code = F.when(v < low, 0).when(v < high, 1).otherwise(2)
    label = (
        F.when(v < low, F.lit(f"Between 0 and {low} {unit}"))
        .when(v < high, F.lit(f"Between {low} and {high} {unit}"))
        .otherwise(F.lit(f"Greater than {high} {unit}"))
    )
    return df.withColumns({"bucket": code, "bucket_label": label})


def pattern_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per combination of the columns, most first."""
    return drop_missing(df, columns).groupBy(*columns).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *columns)


def class_histogram(df: DataFrame, value: str, label: str, bins: int = 10) -> DataFrame:
    """Rows in equal bins between the minimum and maximum of each class; the maximum is in the last bin."""
    rows = drop_missing(df.select(label, F.col(value).cast("double").alias("_v")))
    ends, fits = small_table(rows.groupBy(label).agg(F.min("_v").alias("low"), F.max("_v").alias("high")))
    place = F.floor((F.col("_v") - F.col("low")) * bins / (F.col("high") - F.col("low")))
    placed = attach(rows, ends, [label], fits).select(
        label, F.when(F.col("high") > F.col("low"), F.least(place, F.lit(bins - 1))).otherwise(0).cast("int").alias("bin")
    )
    counted = placed.groupBy(label, "bin").agg(F.count("*").alias("count"))
    width = (F.col("high") - F.col("low")) / bins
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counted, [label, "bin"], "left").select(
        label, "bin", (F.col("low") + F.col("bin") * width).alias("low_edge"),
        (F.col("low") + (F.col("bin") + 1) * width).alias("high_edge"), F.coalesce("count", F.lit(0)).alias("count"),
    )


def boxplot_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 IQR of the box) and outliers per class."""
    quarters = exact_quantiles(df, value, [0.25, 0.5, 0.75], by=[by])
    q1, q2, q3 = (F.col("quantiles")[i] for i in range(3))
    fences, fits = small_table(quarters.select(
        by, q1.alias("q1"), q2.alias("median"), q3.alias("q3"),
        (q1 - 1.5 * (q3 - q1)).alias("_low"), (q3 + 1.5 * (q3 - q1)).alias("_high"),
    ))
    v = F.col(value).cast("double")
    inside = v.between(F.col("_low"), F.col("_high"))
    return attach(drop_missing(df.select(by, value)), fences, [by], fits).groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def class_distribution(df: DataFrame, value: str, label: str, bins: int = 10) -> DataFrame:
    """Density of a column by class: bin counts as shares of the class, divided by the bin width."""
    hist = class_histogram(df, value, label, bins)
    total = F.sum("count").over(Window.partitionBy(label))  # ``bins`` rows per class
    return hist.select(
        label, "bin", "low_edge", "high_edge", "count",
        F.try_divide(F.col("count"), total * (F.col("high_edge") - F.col("low_edge"))).alias("density"),
    )


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson r of each pair ``left`` before ``right``, over the rows where both are present.

    NaN counts as missing, and a column that does not vary over the rows of a pair gives null. Centred
    cross products are added up task by task, whatever the number of columns.
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    numbers = df.select(*[nan_to_null(F.col(f"`{c}`").cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    row = numbers.agg(*[F.avg(c).alias(c) for c in numbers.columns]).first()
    means = np.array([row[c] if row[c] is not None else 0.0 for c in numbers.columns])
    left, right = np.triu_indices(len(columns), k=1)

    def sums(batches):
        total = np.zeros((6, len(columns), len(columns)))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - means
            there = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += np.stack([there.T @ there, x.T @ there, there.T @ x, (x * x).T @ there, there.T @ (x * x), x.T @ x])
        yield pd.DataFrame({"i": left.astype("int32"), "j": right.astype("int32"),
                            **{f"s{k}": total[k][left, right] for k in range(6)}})

    schema = "i int, j int, " + ", ".join(f"s{k} double" for k in range(6))
    added = numbers.mapInPandas(sums, schema).groupBy("i", "j").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(6)])
    n, a, b, aa, bb, ab = (F.col(f"s{k}") for k in range(6))
    spread = (aa - F.try_divide(a * a, n)) * (bb - F.try_divide(b * b, n))
    r = F.when(spread > 0, (ab - F.try_divide(a * b, n)) / F.sqrt(spread))
    names = F.array(*[F.lit(c) for c in columns])
    return added.select(names[F.col("i")].alias("left"), names[F.col("j")].alias("right"), "i", "j", r.alias("r"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long symmetric matrix ``row, column, r`` with 1 on the diagonal of columns that vary."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    pairs = correlation_pairs(df, columns)
    varies = df.agg(*[F.stddev_pop(nan_to_null(F.col(f"`{c}`").cast("double"))).alias(f"v{i}") for i, c in enumerate(columns)])
    diagonal = _stack(varies, [
        {"row": F.lit(c), "column": F.lit(c), "r": F.when(F.col(f"v{i}") > 0, 1.0)} for i, c in enumerate(columns)
    ])
    upper = pairs.select(F.col("left").alias("row"), F.col("right").alias("column"), "r")
    lower = pairs.select(F.col("right").alias("row"), F.col("left").alias("column"), "r")
    return diagonal.unionByName(upper).unionByName(lower)


def high_correlation(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 0.95) -> DataFrame:
    """Columns that correlate above the limit with an earlier column, in column order."""
    pairs = correlation_pairs(df, columns).where(F.abs("r") > limit)
    return pairs.groupBy("j").agg(F.first("right").alias("column")).orderBy("j").select("column", F.col("j").alias("position"))


def drop_high_correlation(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 0.95) -> DataFrame:
    found = [row["column"] for row in high_correlation(df, columns, limit).collect()]  # at most one row per column
    return df.drop(*found)


def anomaly_rate(df: DataFrame, column: str = "anomaly") -> DataFrame:
    """Number and percentage of rows marked −1."""
    marked = F.count_if(F.col(column) == -1)
    return df.agg(marked.alias("anomalies"), F.count("*").alias("rows"),
                  F.round(F.try_divide(marked, F.count("*")) * 100, 2).alias("percent"))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count("*").alias("count"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, f1 and support per class, then ``accuracy``, ``macro avg`` and ``weighted avg``."""
    counts = df.select(F.col(label).cast("string").alias("l"), F.col(prediction).cast("string").alias("p")).groupBy("l", "p").agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.col("l").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )
    hits = F.when((F.col("l") == F.col("p")) & (F.col("_s.support") > 0), F.col("n")).otherwise(0)
    per_class = (
        counts.withColumn("_s", F.explode(sides))
        .groupBy(F.col("_s.class").alias("class"))
        .agg(F.sum(hits).alias("hits"), F.sum("_s.support").alias("support"), F.sum("_s.predicted").alias("predicted"))
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    scored = per_class.select(
        "class", precision.alias("precision"), recall.alias("recall"),
        ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"), "support", "hits",
    )
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    total = F.sum("support").alias("support")
    accuracy = ratio(F.sum("hits"), F.sum("support"))
    empty = F.lit(None).cast("double")
    return (
        scored.drop("hits")
        .unionByName(scored.agg(F.lit("accuracy").alias("class"), empty.alias("precision"), empty.alias("recall"), accuracy.alias("f1"), total))
        .unionByName(scored.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total))
        .unionByName(scored.agg(F.lit("weighted avg").alias("class"), *[weighted(c).alias(c) for c in ("precision", "recall", "f1")], total))
    )
