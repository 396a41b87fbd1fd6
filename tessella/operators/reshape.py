"""Wide to long, long to wide, encodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime
from functools import reduce
from itertools import count

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import drop_missing
from tessella.functions.sizing import literal_rows

DAY_FORMAT = "%d_%m_%Y"


def _day_in(name: str) -> date | None:
    try:
        return datetime.strptime(name.rsplit(" ", 1)[-1], DAY_FORMAT).date()
    except ValueError:
        return None


def days_in_names(df: DataFrame) -> list[date]:
    """Days found at the end of column names, in order."""
    return sorted({d for d in map(_day_in, df.columns) if d})


def wide_days_to_long(df: DataFrame, ids: Sequence[str], measures: Mapping[str, str], day: str = "DATA") -> DataFrame:
    """One row per id and day from columns named ``<prefix> dd_mm_yyyy``.

    ``measures`` maps the new column to its prefix. Rows with a null id or measure are dropped.
    All days come out of one generated array per row, so nothing is shuffled; days without a value
    are taken out of the array before it becomes rows.
    """
    present = set(df.columns)
    days = []
    for d in days_in_names(df):
        names = {new: f"{prefix} {d.strftime(DAY_FORMAT)}" for new, prefix in measures.items()}
        if present.issuperset(names.values()):
            days.append(F.struct(*[F.col(f"`{c}`").alias(new) for new, c in names.items()], F.lit(d).alias(day)))
    if not days:
        raise ValueError("no day columns with all measures")
    plain = [F.col(f"`{c}`") for c in ids]
    there = F.filter(F.array(*days), lambda d: reduce(lambda a, b: a & b, [d[new].isNotNull() for new in measures]))
    return drop_missing(df.select(*plain, F.explode(there).alias("_day")).select(*plain, "_day.*"))


def long_to_wide_days(df: DataFrame, ids: Sequence[str], day: str, measures: Mapping[str, str], days: Sequence[date]) -> DataFrame:
    """The inverse for a given list of days: one column ``<prefix> dd_mm_yyyy`` per measure and day."""
    cells = [
        F.max(F.when(F.col(day) == F.lit(d), F.col(c))).alias(f"{prefix} {d.strftime(DAY_FORMAT)}")
        for d in days
        for c, prefix in measures.items()
    ]
    return df.groupBy(*[F.col(f"`{c}`") for c in ids]).agg(*cells)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None, variable: str = "variable", value: str = "value") -> DataFrame:
    """All value columns as text, one row per id and column."""
    values = list(values) if values is not None else [c for c in df.columns if c not in ids]
    typed = df.select(*[F.col(f"`{c}`") for c in ids], *[F.col(f"`{c}`").cast("string").alias(c) for c in values])
    return typed.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in values], variable, value)


def category_values(df: DataFrame, columns: Sequence[str], max_values: int = 10_000) -> dict[str, list]:
    """Sorted distinct values of each column, in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    pairs = df.select(F.explode(cells).alias("_c")).select("_c.*").where(F.col("value").isNotNull()).distinct()
    found: dict[str, list] = {c: [] for c in columns}
    for row in literal_rows(pairs, max_values):
        found[row["column"]].append(row["value"])
    return {c: sorted(v) for c, v in found.items()}


def one_hot(df: DataFrame, columns: Sequence[str], values: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Replace each column by 0/1 columns ``column_value``; null gives zeros everywhere.

    Names that differ in case only would be one name to Spark: the second gets ``_2``, and so on.

    Pass ``values`` where the categories are known; otherwise one pass finds them.
    """
    values = values if values is not None else category_values(df, columns)
    taken = {c.lower() for c in df.columns if c not in columns}
    dummies = []
    for c in columns:
        for v in values[c]:
            tries = (f"{c}_{v}" if k == 1 else f"{c}_{v}_{k}" for k in count(1))
            name = next(n for n in tries if n.lower() not in taken)
            taken.add(name.lower())
            dummies.append(F.when(F.col(f"`{c}`").cast("string") == F.lit(str(v)), 1).otherwise(0).alias(name))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], *dummies)


def string_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_encoded``: 0 for the most frequent value; rows with nulls are skipped."""
    indexer = StringIndexer(
        inputCols=list(columns), outputCols=[f"{c}_encoded" for c in columns], handleInvalid="skip"
    )
    return indexer.fit(df).transform(df)


def date_range(df: DataFrame, start: str, end: str, name: str = "day") -> DataFrame:
    """One row per day from ``start`` to ``end``, both included."""
    days = F.sequence(F.col(start).cast("date"), F.col(end).cast("date"), F.expr("interval 1 day"))
    return df.withColumn(name, F.explode(days))
