"""Topics of short texts: embedding, components, clusters, words per cluster."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame

from tessella.operators import words
from tessella.operators.clusters import kmeans
from tessella.operators.vectors import Components, as_vector, average_word_vectors, encode_texts, fit_components
from tessella.session import cut


@dataclass
class Topics:
    rows: DataFrame
    words: DataFrame
    components: Components
    model: KMeansModel


def sentence_vectors(df: DataFrame, text: str, keep: Sequence[str], encoder: Callable | None = None, seed: int = 42, size: int = 64, **cleaning) -> DataFrame:
    """One row per cleaned sentence with its ``embedding``; without ``encoder`` the mean of word vectors."""
    rows = cut(words.clean_sentences(df, text, keep, **cleaning).where("sentence <> ''"))  # each step of a fit reads them
    if encoder is not None:
        return as_vector(encode_texts(rows, "sentence", encoder), "embedding", "embedding")
    return average_word_vectors(rows, "sentence", size=size, seed=seed)


def extract_topics(
    sentences: DataFrame, order: Sequence[str], text: str = "sentence", vector: str = "embedding", components: int = 30, k: int = 12, n: int = 3, top: int = 10, max_iter: int = 1000, seed: int = 42
) -> Topics:
    """Project the vectors, cluster them and list the n-grams that stand out in each cluster."""
    sentences = cut(sentences)  # read by each step of the fit
    fitted = fit_components(sentences, vector, components)
    clustered, model = kmeans(cut(fitted.transform(sentences).drop(vector)), k, fitted.output, max_iter, seed)
    best = words.top_words(clustered, "prediction", order, text, n, top)
    return Topics(clustered, words.topic_lists(best, "prediction"), fitted, model)


def with_topics(topics: Topics, keep: Sequence[str]) -> DataFrame:
    """Rows with their cluster and its words (one small row per cluster)."""
    return topics.rows.select(*keep, "prediction").join(topics.words, "prediction", "left")
