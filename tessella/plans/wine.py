"""Wine type and quality from measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tessella.functions.columns import recode
from tessella.operators import clean
from tessella.operators.explain import three_way_split
from tessella.operators.forecast import two_target_model


def wine_rows(df: DataFrame, id_columns: Sequence[str], seed: int = 1) -> DataFrame:
    """Type 0 for white and 1 for anything else, rows without nulls, marked train, val or test."""
    coded = df.withColumn("type", recode("type", {"white": 0}, otherwise=1, keep=False))
    return three_way_split(clean.drop_any_null(coded), id_columns, seed)


def split_labels(df: DataFrame, labels: Sequence[str] = ("quality", "type"), drop: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Names of the feature columns and of the targets."""
    return [c for c in clean.numeric_columns(df) if c not in (*labels, *drop)], list(labels)


def wine_predictions(df: DataFrame, id_columns: Sequence[str], seed: int = 1, **options) -> DataFrame:
    rows = wine_rows(df, id_columns, seed)
    features, _ = split_labels(rows, drop=id_columns)
    return two_target_model(rows, features, "type", "quality", **options)
