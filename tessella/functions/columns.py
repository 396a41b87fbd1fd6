"""Column expressions used by the operators and offered to callers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decimal_comma(c: Column | str) -> Column:
    """``'12,5'`` to 12.5."""
    return F.regexp_replace(_col(c), ",", ".").cast("double")


def to_number(c: Column | str) -> Column:
    """Text to number; text that is no number becomes null."""
    return _col(c).try_cast("double")


def parse_date(c: Column | str, pattern: str = "yyyy-MM-dd") -> Column:
    """Non-strict date: text that does not fit the pattern becomes null."""
    return F.try_to_timestamp(_col(c), F.lit(pattern)).cast("date")


def over_threshold(threshold: Column | str, value: Column | str) -> Column:
    """1 where the value is strictly above the threshold, else 0, also for nulls."""
    return F.when(_col(threshold) < _col(value), 1).otherwise(0)


def share(part: Column | str, *parts: Column | str) -> Column:
    """``part`` by the sum of ``parts``; null where that sum is 0."""
    return F.try_divide(_col(part).cast("double"), reduce(lambda a, b: a + b, map(_col, parts)))


def composite(*parts: Column | str) -> Column:
    """Text parts put together; null if one of them is null."""
    return F.concat(*[_col(p).cast("string") for p in parts])


def recode(c: Column | str, mapping: Mapping, otherwise: object = None, keep: bool = True) -> Column:
    """Replace values; others stay (``keep``) or become ``otherwise``."""
    c = _col(c)
    out = None
    for old, new in mapping.items():
        out = F.when(c == F.lit(old), F.lit(new)) if out is None else out.when(c == F.lit(old), F.lit(new))
    return out.otherwise(c if keep else F.lit(otherwise))


def percent_to_ratio(c: Column | str) -> Column:
    return _col(c) / 100


def nan_to_null(c: Column | str) -> Column:
    return F.nanvl(_col(c), F.lit(None).cast("double"))


def remove_pattern(c: Column | str, pattern: str) -> Column:
    return F.regexp_replace(_col(c), pattern, "")


def bucket_start(ts: Column | str, width: str = "3 hours") -> Column:
    """Start of the fixed window a timestamp falls in, counted from midnight."""
    return F.window(_col(ts), width).start


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which all columns have a value.

    One null test per column, which Spark can push to the scan, instead of a single count over all
    columns, whose variants multiply in the optimizer when columns are renamed.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    tests = [F.col(f"`{f.name}`").isNotNull() for f in fields]
    tests += [~F.isnan(f"`{f.name}`") for f in fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df
