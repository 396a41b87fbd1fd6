"""k-means and the choice of k."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame

from tessella.functions.sizing import spread_out


def kmeans(df: DataFrame, k: int, features: str = "pca_features", max_iter: int = 1000, seed: int = 42) -> tuple[DataFrame, KMeansModel]:
    """The frame with ``prediction`` and the fitted model.

    Each round reads all points, so they are dealt over all cores before the first.
    """
    model = KMeans(featuresCol=features, k=k, maxIter=max_iter, seed=seed).fit(spread_out(df.select(features)))
    return model.transform(df), model


def silhouette_sweep(df: DataFrame, ks: Iterable[int], features: str = "pca_features", seed: int = 42, workers: int = 4) -> DataFrame:
    """``k, silhouette, cost`` for each k: squared Euclidean silhouette and training cost.

    The fits share one persisted frame and run side by side, so the cluster stays busy.
    """
    held = spread_out(df.select(features)).persist(StorageLevel.MEMORY_AND_DISK)
    evaluator = ClusteringEvaluator(featuresCol=features, metricName="silhouette", distanceMeasure="squaredEuclidean")

    def run(k: int) -> tuple[int, float, float]:
        model = KMeans(featuresCol=features, k=k, seed=seed).fit(held)
        return k, float(evaluator.evaluate(model.transform(held))), float(model.summary.trainingCost)

    try:
        with ThreadPoolExecutor(workers) as pool:
            rows = list(pool.map(run, ks))
    finally:
        held.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, cost double")
