"""Casts, predicates, projections and row cleaning."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import columns as C


def cast_by_schema(df: DataFrame, types: Mapping[str, str | T.DataType]) -> DataFrame:
    """Cast the named columns, strictly: a bad value is an error."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def ensure_date(df: DataFrame, column: str) -> DataFrame:
    """Parse a text column as ``yyyy-MM-dd`` unless it is a date; bad text becomes null."""
    if isinstance(df.schema[column].dataType, T.DateType):
        return df
    return df.withColumn(column, C.parse_date(column))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Use null as the only missing marker."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: C.nan_to_null(c) for c in floats}) if floats else df


def keep_equal(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def drop_equal(df: DataFrame, column: str, value: object) -> DataFrame:
    """Drop rows with this value; rows with null stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def keep_after(df: DataFrame, column: str, day: str) -> DataFrame:
    """Rows strictly after a day."""
    return df.where(F.col(column) > F.lit(day).cast(df.schema[column].dataType))


def keep_in(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def keep_between(df: DataFrame, column: str, low: object, high: object) -> DataFrame:
    """Rows inside a closed range."""
    return df.where(F.col(column).between(low, high))


def drop_any_null(df: DataFrame) -> DataFrame:
    return C.drop_missing(df)


def drop_null_in(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return C.drop_missing(df, columns)


def drop_zero_text(df: DataFrame, column: str) -> DataFrame:
    """Drop rows whose text is exactly ``'0'``; run it before the cast, ``'0,0'`` stays."""
    return df.where(F.col(column) != "0")


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Names in which the pattern is found anywhere."""
    import re

    return [c for c in df.columns if re.search(pattern, c)]


def select_like(df: DataFrame, *patterns: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and every column whose name matches one of the patterns, side by side."""
    found = [c for p in patterns for c in columns_like(df, p)]
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, *found])])


def side_by_side(df: DataFrame, *projections: Sequence[str | Column]) -> DataFrame:
    """Several projections of one frame put next to each other; one select, no join."""
    return df.select(*[c for p in projections for c in p])


def reorder(df: DataFrame, first: Sequence[str]) -> DataFrame:
    return df.select(*first, *[F.col(f"`{c}`") for c in df.columns if c not in first])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def with_composite_id(df: DataFrame, parts: Sequence[str], name: str = "ID") -> DataFrame:
    """Replace the parts by one key column in front."""
    return reorder(df.withColumn(name, C.composite(*parts)).drop(*parts), [name])


def with_shares(df: DataFrame, parts: Sequence[str], suffix: str = " PERC") -> DataFrame:
    """Share of each part in the sum of all parts; null where the sum is 0."""
    return df.withColumns({c + suffix: C.share(f"`{c}`", *[f"`{p}`" for p in parts]) for c in parts})


def keep_major_share(df: DataFrame, part: str, parts: Sequence[str], least: float = 0.75) -> DataFrame:
    """Rows where ``part`` makes up at least the given share of all parts."""
    return df.where(C.share(f"`{part}`", *[f"`{p}`" for p in parts]) >= least)


def with_threshold_flags(df: DataFrame, value: str, flags: Mapping[str, str]) -> DataFrame:
    """One 0/1 column per ``{name: threshold column}``."""
    return df.withColumns({name: C.over_threshold(f"`{limit}`", f"`{value}`") for name, limit in flags.items()})


def fill_constant(df: DataFrame, value: object = 0) -> DataFrame:
    """Fill every column: numbers with the value, text with its text form."""
    return df.na.fill(value).na.fill(str(value))


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def duplicate_report(df: DataFrame) -> DataFrame:
    """``rows``, ``distinct_rows`` and ``duplicates`` of a frame."""
    copies = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"),
    )


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row per key in the stated order.

    An aggregation, not a window: each task keeps one row per key before the shuffle.
    """
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_row")).select("_row.*")


def binary_target(df: DataFrame, column: str, value: object, name: str) -> DataFrame:
    """1 where the column has the value, else 0."""
    return df.withColumn(name, F.when(F.col(column) == F.lit(value), 1).otherwise(0))
