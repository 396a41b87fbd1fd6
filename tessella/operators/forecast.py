"""One-step forecasts and the two-target model on Spark ML."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.series import chronological_split, lag_features, shift_time
from tessella.operators.vectors import standardize
from tessella.session import cut


def regression_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """``rmse, mse, mae, rows``."""
    error = F.col(label) - F.col(prediction)
    mse = F.avg(error * error)
    return df.groupBy(*by).agg(F.sqrt(mse).alias("rmse"), mse.alias("mse"), F.avg(F.abs(error)).alias("mae"), F.count(error).alias("rows"))


def forecast_features(series: DataFrame, ts: str = "DATA", key: str = "PROVINCIA", value: str = "MAX_DS", lags: int = 8) -> DataFrame:
    """Lags of the measure, hour and time split of a scaled training series."""
    lagged = lag_features(series, value, [key], ts, lags)
    return chronological_split(lagged.withColumn("hour", F.hour(ts)), ts, key)


def one_step_forecast(
    series: DataFrame,
    ts: str = "DATA",
    key: str = "PROVINCIA",
    value: str = "MAX_DS",
    target: str = "PRED",
    extra: Sequence[str] = ("TIPO_GIORNO_DS",),
    event: Sequence[str] = ("KPI",),
    lags: int = 8,
    iterations: int = 20,
    seed: int = 42,
) -> DataFrame:
    """Test rows with the predicted next bucket, once with and once without the event columns.

    One model for all series; ``ts`` of the result is the predicted bucket.
    """
    rows = forecast_features(series, ts, key, value, lags)
    base = [value, *[f"lag_{i}" for i in range(1, lags + 1)], "hour", *extra]
    rows = cut(rows.na.fill(0.0, subset=[*base, *event]))
    out = rows.where("split = 'test'")
    for name, columns in (("predicted_with_event", [*base, *event]), ("predicted", base)):
        model = Pipeline(stages=[
            VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep"),
            GBTRegressor(featuresCol="_x", labelCol=target, predictionCol=name, maxIter=iterations, seed=seed),
        ]).fit(rows.where("split = 'train'"))
        out = model.transform(out).drop("_x")
    return shift_time(out.select(key, ts, F.col(target).alias("expected"), "predicted", "predicted_with_event"), ts)


def series_models(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    """A linear model for each key by least squares: ``keys, coefficients`` (intercept first) and ``rows``.

    Products of the columns are summed up for each key, within tasks before they are shuffled, so that a key
    of any size becomes one row of fixed size; the normal equations of that row are solved where it lies.
    Rows with a missing value are left out. Of several best models (columns that depend on each other, few
    rows) the one with the smallest coefficients is taken.
    """
    columns = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in features]]
    y, n = F.col(f"`{target}`").cast("double"), len(columns)
    held = F.lit(True)
    for c in (*columns[1:], y):
        held = held & c.isNotNull() & ~F.isnan(c)
    sums = [F.sum(columns[i] * columns[j]).alias(f"_xx_{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(c * y).alias(f"_xy_{i}") for i, c in enumerate(columns)]
    totals = df.where(held).groupBy(*keys).agg(*sums, F.count("*").alias("rows"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for row in frame.to_dict("records"):
                xx = np.array([[row[f"_xx_{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
                scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
                answer = np.linalg.lstsq(xx / np.outer(scale, scale), np.array([row[f"_xy_{i}"] for i in range(n)]) / scale, rcond=1e-12)[0]
                found.append((answer / scale).tolist())
            yield frame[[*keys, "rows"]].assign(coefficients=found)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    return totals.mapInPandas(solve, f"{kinds}, rows long, coefficients array<double>")


def series_predictions(df: DataFrame, models: DataFrame, features: Sequence[str], keys: Sequence[str], name: str = "predicted") -> DataFrame:
    """Add what the model of a row's key says; null without a model or with a missing feature."""
    values = F.array(F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in features])
    said = F.aggregate(F.zip_with(values, F.col("_model"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    renamed = models.select(*[F.col(f"`{c}`").alias(f"_of_{i}") for i, c in enumerate(keys)], F.col("coefficients").alias("_model"))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_of_{i}"))
    return df.join(renamed, same, "left").withColumn(name, said).drop("_model", *[f"_of_{i}" for i in range(len(keys))])


def series_forecast(
    series: DataFrame, ts: str = "DATA", key: str = "PROVINCIA", value: str = "MAX_DS", target: str = "PRED",
    extra: Sequence[str] = ("TIPO_GIORNO_DS",), event: Sequence[str] = ("KPI",), lags: int = 8,
) -> DataFrame:
    """As ``one_step_forecast``, with a model of its own for each series, all fitted in one aggregation."""
    rows = forecast_features(series, ts, key, value, lags)
    base = [value, *[f"lag_{i}" for i in range(1, lags + 1)], "hour", *extra]
    rows = cut(rows.na.fill(0.0, subset=[*base, *event]))
    out = rows.where("split = 'test'")
    for name, columns in (("predicted_with_event", [*base, *event]), ("predicted", base)):
        models = series_models(rows.where("split = 'train'"), columns, target, [key])
        out = series_predictions(out, models, columns, [key], name)
    return shift_time(out.select(key, ts, F.col(target).alias("expected"), "predicted", "predicted_with_event"), ts)


def two_target_model(
    df: DataFrame, features: Sequence[str], binary: str, number: str, split: str = "split", iterations: int = 20, seed: int = 1
) -> DataFrame:
    """Rows outside ``train`` with ``predicted_<binary>`` and ``predicted_<number>``.

    Features are scaled by the statistics of the training rows.
    """
    df = cut(df)  # statistics, two fits and the prediction read it
    scaled = standardize(df, features, ddof=1, train=df.where(F.col(split) == "train"))
    x = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(scaled)
    train, rest = x.where(F.col(split) == "train"), x.where(F.col(split) != "train")
    kind = LogisticRegression(featuresCol="_x", labelCol=binary, predictionCol=f"predicted_{binary}", maxIter=100).fit(train)
    level = GBTRegressor(featuresCol="_x", labelCol=number, predictionCol=f"predicted_{number}", maxIter=iterations, seed=seed).fit(train)
    return level.transform(kind.transform(rest).drop("rawPrediction", "probability")).drop("_x")


def two_target_metrics(df: DataFrame, binary: str, number: str, split: str = "split") -> DataFrame:
    """Accuracy of the binary and RMSE of the number target per split."""
    error = F.col(number) - F.col(f"predicted_{number}")
    hit = (F.col(binary) == F.col(f"predicted_{binary}")).cast("double")
    return df.groupBy(split).agg(F.avg(hit).alias("accuracy"), F.sqrt(F.avg(error * error)).alias("rmse"), F.count("*").alias("rows"))
