"""Splits that keep class shares, random forests and what they rely on."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.sizing import attach, literal_rows, small_table
from tessella.operators.forest import fit_forest

LEAST_RANGES = 1_024


def _hash(id_columns: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in id_columns])


def stratified_split(df: DataFrame, label: str, id_columns: Sequence[str], train_share: float = 0.7, seed: int = 42, name: str = "split") -> DataFrame:
    """Mark rows ``train`` or ``test`` so that each class has exactly its rounded share of train rows.

    Rows are ordered by a hash of their id. Counts per hash range show in which range the cut of a
    class lies; only that range is ranked. There are about as many ranges as rows in a range, whatever
    the number of rows. The mark itself is a comparison, made without a shuffle. The ids must be unique;
    a row without a label has no mark.
    """
    ranges = max(LEAST_RANGES, math.isqrt(df.count()))
    keyed = df.select(label, _hash(id_columns, seed).alias("_h")).where(F.col(label).isNotNull())
    ranged = keyed.withColumn("_range", F.floor(F.col("_h") / F.lit(2.0**64 / ranges)))
    upto = Window.partitionBy(label).orderBy("_range")  # one row per range and class
    sizes = (
        ranged.groupBy(label, "_range").agg(F.count("*").alias("_c"))
        .withColumn("_end", F.sum("_c").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_want", F.round(F.sum("_c").over(Window.partitionBy(label)) * F.lit(train_share)).cast("long"))
    )
    holder = sizes.where((F.col("_end") >= F.col("_want")) & (F.col("_end") - F.col("_c") < F.col("_want")))
    holder, fits = small_table(holder.select(label, "_range", (F.col("_want") - F.col("_end") + F.col("_c")).alias("_left")))
    inside = attach(ranged, holder, [label, "_range"], fits)
    ranked = inside.withColumn("_n", F.row_number().over(Window.partitionBy(label, "_range").orderBy("_h")))
    cuts, fits = small_table(ranked.where(F.col("_n") == F.col("_left")).select(label, F.col("_h").alias("_cut")))
    marked = df.join(F.broadcast(cuts) if fits else cuts, label, "left")
    return marked.withColumn(name, F.when(_hash(id_columns, seed) <= F.col("_cut"), "train").when(F.col(label).isNotNull(), "test")).drop("_cut")


def balanced_split(df: DataFrame, id_columns: Sequence[str], train_share: float = 0.7, seed: int = 42, name: str = "split") -> DataFrame:
    """Mark each row by its own hash: about the share of every class, one pass, no shuffle."""
    place = F.pmod(_hash(id_columns, seed), F.lit(1_000_000)) / 1_000_000
    return df.withColumn(name, F.when(place < train_share, "train").otherwise("test"))


def three_way_split(df: DataFrame, id_columns: Sequence[str], seed: int = 1, name: str = "split") -> DataFrame:
    """64 % ``train``, 16 % ``val``, 20 % ``test``: a fifth for testing, then a fifth of the rest for validation."""
    place = F.pmod(_hash(id_columns, seed), F.lit(1_000_000)) / 1_000_000
    return df.withColumn(name, F.when(place < 0.64, "train").when(place < 0.80, "val").otherwise("test"))


def forest_pipeline(label: str, features: Sequence[str], trees: int = 20, max_bins: int = 32, seed: int = 42, depth: int = 5) -> Pipeline:
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=list(features), outputCol="features_col", handleInvalid="keep"),
        RandomForestClassifier(labelCol="label", featuresCol="features_col", numTrees=trees, maxBins=max_bins, seed=seed, maxDepth=depth),
    ])


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Features by importance, largest first."""
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, values)), key=lambda x: (-x[1], x[0]))


def random_forest_importance(
    df: DataFrame, features: Sequence[str], label: str, id_columns: Sequence[str], trees: int = 100, train_share: float = 0.7, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Importance table ``rank, feature, importance`` and the test rows with ``predicted`` labels."""
    split = stratified_split(df, label, id_columns, train_share, seed)
    forest = fit_forest(split.where("split = 'train'"), features, label, trees, seed=seed)
    rows = [(i + 1, f, v) for i, (f, v) in enumerate(forest.importances())]
    table = df.sparkSession.createDataFrame(rows, "rank int, feature string, importance double")
    return table, forest.predict(split.where("split = 'test'"))


def one_vs_rest_importance(
    df: DataFrame,
    features: Sequence[str],
    cluster: str,
    id_columns: Sequence[str],
    trees: int = 20,
    max_bins: int = 256,
    seed: int = 42,
    max_clusters: int = 1_000,
    workers: int = 4,
) -> DataFrame:
    """For each cluster a forest against all others: ``id_cluster, rank, feature, importance, accuracy``.

    All forests read one persisted frame and are trained side by side. Where the train part lacks the
    cluster or the others, importances and accuracy are null; without test rows the accuracy is.
    """
    values = sorted(r[0] for r in literal_rows(df.select(cluster).where(F.col(cluster).isNotNull()).distinct(), max_clusters))
    lean = df.select(F.col(cluster).alias("_cluster"), *[F.col(f"`{c}`") for c in dict.fromkeys([*features, *id_columns])])
    held = balanced_split(lean, id_columns, seed=seed).persist(StorageLevel.MEMORY_AND_DISK)
    score = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")

    def run(value) -> list[tuple]:
        target = held.withColumn("label", F.when(F.col("_cluster") == F.lit(value), 1.0).otherwise(0.0))
        train, test = target.where("split = 'train'"), target.where("split = 'test'")
        if train.select("label").distinct().count() < 2:
            return [(value, i + 1, f, None, None) for i, f in enumerate(sorted(features))]
        model = Pipeline(stages=forest_pipeline("_target", features, trees, max_bins, seed).getStages()[1:]).fit(train)
        accuracy = float(score.evaluate(model.transform(test))) if test.limit(1).count() else None
        return [(value, i + 1, f, v, accuracy) for i, (f, v) in enumerate(importances(model, features))]

    try:
        with ThreadPoolExecutor(workers) as pool:
            rows = [row for part in pool.map(run, values) for row in part]
    finally:
        held.unpersist()
    kind = df.schema[cluster].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"id_cluster {kind}, rank int, feature string, importance double, accuracy double")
