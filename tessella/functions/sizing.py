"""Size checks in front of every broadcast this library asks for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import cut

SMALL_ROWS = 10_000


def small_table(df: DataFrame, max_rows: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """Materialise ``df``; the flag says whether it has at most ``max_rows`` rows.

    Small results become a literal table in one run. A larger one is run again into a checkpoint;
    only ``max_rows + 1`` rows ever reach the driver.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows <= max_rows:
        return df.sparkSession.createDataFrame(rows, df.schema), True
    return cut(df), False


def spread_out(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over the cores where it has fewer partitions than those, for costly row-wise work.

    A file of one row group is one task however many cores wait; on a large table the partitions are
    many and nothing is moved. Rows and their values stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], fits: bool) -> DataFrame:
    """Add the columns of ``table`` to the rows of ``df`` with the same keys.

    A table that passed the size check is broadcast, a larger one is joined as Spark sees fit.
    Without keys the table has one row, whose values become literals.
    """
    if keys:
        return df.join(F.broadcast(table) if fits else table, list(keys))
    row = table.first()
    return df.select("*", *[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in table.schema])


def literal_rows(df: DataFrame, max_rows: int) -> list:
    """Rows of a table that must be small by meaning; fails instead of dropping rows."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows where a small table is needed")
    return rows
