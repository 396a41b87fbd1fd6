"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",", null: str = "") -> None:
    """CSV folder with header lines; missing folders are made."""
    df.write.mode(mode).option("header", True).option("sep", sep).option("nullValue", null).csv(path)


def write_month(df: DataFrame, path: str, month: str) -> None:
    """Add one month to a dataset; writing the same month again replaces it."""
    write_months(df.withColumn("month", F.lit(month)), path)


def write_months(df: DataFrame, path: str) -> None:
    """Add or replace all months that column ``month`` names, in one pass."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def fixed_decimals(df: DataFrame, decimals: int = 3, columns: Sequence[str] | None = None) -> DataFrame:
    """Floating point columns as text with a fixed number of decimals."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    chosen = list(columns) if columns is not None else floats
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals}f", F.col(c))) for c in chosen})


def write_csv_decimals(df: DataFrame, path: str, decimals: int = 3) -> None:
    write_csv(fixed_decimals(df, decimals), path)


def write_json_report(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)


def importance_report(df: DataFrame) -> DataFrame:
    """Ranked importances nested per cluster: ``id_cluster, features_importance, accuracy``."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "feature", "importance")))
    pairs = F.transform(ranked, lambda r: F.struct(r["feature"].alias("feature"), r["importance"].alias("importance")))
    return df.groupBy("id_cluster").agg(pairs.alias("features_importance"), F.first("accuracy").alias("accuracy"))
