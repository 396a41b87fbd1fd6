"""Vectors, scaling, principal components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler, Tokenizer, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import cut

MOST_NAMES = 1 << 19  # words with a vector of their own; the driver gets about 700 bytes for each


def assemble(df: DataFrame, columns: Sequence[str], name: str = "features", invalid: str = "keep") -> DataFrame:
    """Number columns as one vector column."""
    return VectorAssembler(inputCols=list(columns), outputCol=name, handleInvalid=invalid).transform(df)


def as_vector(df: DataFrame, array: str, name: str = "features") -> DataFrame:
    """An array column as vector column; rows without it are dropped."""
    return df.where(F.col(array).isNotNull()).withColumn(name, array_to_vector(F.col(array).cast("array<double>")))


def standardize(df: DataFrame, columns: Sequence[str], center: bool = True, ddof: int = 0, train: DataFrame | None = None) -> DataFrame:
    """``(x - mean) / std`` per column, with the statistics of ``train`` (default: the frame itself).

    ``ddof`` 0 divides by n, 1 by n - 1; without ``center`` the mean stays. A constant column is
    only centred.
    """
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = (train if train is not None else df).agg(
        *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)], *[std(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns)]
    ).first()
    scaled = {}
    for i, c in enumerate(columns):
        mean, spread = stats[f"m{i}"], stats[f"s{i}"]
        shifted = F.col(f"`{c}`") - F.lit(mean if center else 0.0)
        scaled[c] = shifted / F.lit(spread) if spread else shifted
    return df.withColumns(scaled)


@dataclass
class Components:
    """A fitted scaling and projection; signs are fixed so that the largest loading is positive."""

    model: PipelineModel
    columns: list[str]
    matrix: np.ndarray
    variance: list[float]
    output: str

    def transform(self, df: DataFrame, k: int | None = None) -> DataFrame:
        """Add the component vector; ``k`` keeps the first components only."""
        out = self.model.transform(df).drop("_raw", "_scaled", "_components")
        if k is not None and k < len(self.variance):
            out = out.withColumn(self.output, array_to_vector(F.slice(vector_to_array(self.output), 1, k)))
        return out

    def transform_columns(self, df: DataFrame, k: int | None = None) -> DataFrame:
        """Components as columns ``PC1 …`` next to the columns that were not features."""
        k = k or len(self.variance)
        values = vector_to_array(F.col(self.output))
        rest = [c for c in df.columns if c not in self.columns]
        return self.transform(df).select(*[values[i].alias(f"PC{i + 1}") for i in range(k)], *[F.col(f"`{c}`") for c in rest])

    def explained(self, spark) -> DataFrame:
        """``component, variance, cumulative`` (at most one row per feature)."""
        total = np.cumsum(self.variance)
        return spark.createDataFrame(
            [(i + 1, float(v), float(total[i])) for i, v in enumerate(self.variance)],
            "component int, variance double, cumulative double",
        )

    def loadings(self, spark) -> DataFrame:
        """Long table ``feature, component, loading``."""
        rows = [(c, k + 1, float(self.matrix[i, k])) for i, c in enumerate(self.columns) for k in range(self.matrix.shape[1])]
        return spark.createDataFrame(rows, "feature string, component int, loading double")

    def k_for_variance(self, share: float = 0.70) -> int:
        """Fewest components that keep the share of the variance."""
        reached = np.nonzero(np.cumsum(self.variance) >= share - 1e-12)[0]
        return int(reached[0]) + 1 if len(reached) else len(self.variance)


def fit_components(df: DataFrame, columns: Sequence[str] | str, k: int, output: str = "pca_features") -> Components:
    """Scale to mean 0 and deviation 1, then project on ``k`` principal components.

    ``columns`` is a list of number columns or the name of one vector column. Fit once at the
    largest k wanted; a smaller one is a prefix of it.
    """
    if isinstance(columns, str):
        size = df.select(columns).first()[0].size
        names, first, source = [f"{columns}_{i}" for i in range(size)], [], columns
    else:
        names, source = list(columns), "_raw"
        first = [VectorAssembler(inputCols=names, outputCol="_raw", handleInvalid="error")]
    scaler = StandardScaler(inputCol=source, outputCol="_scaled", withMean=True, withStd=True)
    fitted = Pipeline(stages=[*first, scaler, PCA(k=k, inputCol="_scaled", outputCol="_components")]).fit(df)
    pca = fitted.stages[-1]
    matrix = pca.pc.toArray()
    signs = np.where(matrix[np.abs(matrix).argmax(axis=0), np.arange(matrix.shape[1])] < 0, -1.0, 1.0)
    flip = ElementwiseProduct(scalingVec=Vectors.dense(signs), inputCol="_components", outputCol=output)
    model = PipelineModel(stages=[*fitted.stages, flip])
    return Components(model, names, matrix * signs, [float(v) for v in pca.explainedVariance], output)


def first_components(df: DataFrame, vector: str, keep: Sequence[str], n: int = 3) -> DataFrame:
    """The first ``n`` coordinates ``pca1 …`` with label and hover columns, for a scatter chart."""
    values = vector_to_array(F.col(vector))
    return df.select(*keep, *[values[i].alias(f"pca{i + 1}") for i in range(n)])


def _shared_names(words: DataFrame, array: str, min_count: int, most: int) -> DataFrame:
    """The lists of words as they are, if at most ``most`` words occur ``min_count`` times.

    Otherwise the more frequent half of ``most`` keep their names and all others share as many names by a hash: no word
    is left out, and what a model holds for each name stays bounded however many words there are.
    """
    counts = cut(words.select(F.explode(array).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))
    if counts.count() <= most:
        return words
    own = counts.orderBy(F.desc("n"), "w").limit(most // 2).select("w").toArrow().column(0).combine_chunks()
    shared = words.sparkSession.sparkContext.broadcast(own)
    at, rest = words.columns.index(array), most - most // 2

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            encoded = lists.flatten().dictionary_encode()
            names = encoded.dictionary
            hashed = pd.util.hash_array(np.array(names.to_pylist(), dtype=object), categorize=False) % np.uint64(rest)
            names = pc.if_else(pc.is_in(names, value_set=shared.value), names, pc.binary_join_element_wise("\0", pa.array(hashed).cast(pa.string()), ""))
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            renamed = pa.ListArray.from_arrays(pa.array(offsets), names.take(encoded.indices))
            yield pa.record_batch([*batch.columns[:at], renamed, *batch.columns[at + 1:]], batch.schema.names)

    return words.mapInArrow(rename, words.schema)


def average_word_vectors(
    df: DataFrame, text: str, name: str = "embedding", size: int = 64, seed: int = 42, min_count: int = 2, texts_per_task: int = 20_000, most_names: int = MOST_NAMES
) -> DataFrame:
    """Default encoder: Word2Vec fitted on the texts, the mean word vector of each text.

    Training is spread over one task for every ``texts_per_task`` texts. The driver holds the vectors, so beyond
    ``most_names`` words the rarer ones share vectors by a hash.
    """
    words = Tokenizer(inputCol=text, outputCol="_words").transform(df.where(F.col(text).isNotNull()))
    partitions = math.ceil(max(1, words.count()) / texts_per_task)
    words = _shared_names(words, "_words", min_count, most_names)
    model = Word2Vec(
        vectorSize=size, minCount=min_count, seed=seed, numPartitions=partitions, inputCol="_words", outputCol=name
    ).fit(words)
    return model.transform(words).drop("_words")


def encode_texts(df: DataFrame, text: str, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]], name: str = "embedding", per_token: bool = False) -> DataFrame:
    """Run a given encoder over the texts in Arrow batches.

    ``make_encoder`` is called once per task and returns a function from a list of texts to a
    matrix with one row per text, for instance a sentence transformer loaded from disk. With ``per_token``
    the function returns one matrix for each text, with one row per token, and the text gets their mean;
    a text without tokens gets a null. Rows without a text are left out.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator):
        encoder = make_encoder()
        for batch in batches:
            found = encoder(batch[text].tolist())
            if per_token:
                vectors = [np.mean(np.asarray(m, dtype="float64"), axis=0).astype("float32") if len(m) else None for m in found]
            else:
                vectors = list(np.asarray(found, dtype="float32"))
            yield batch.assign(**{name: pd.Series(vectors, index=batch.index, dtype=object)})

    return df.where(F.col(text).isNotNull()).mapInPandas(run, schema)
