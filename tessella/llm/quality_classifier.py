"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are hashed byte trigrams and repeated neighbour words. Their document frequencies are counted over
all documents; the latent space is the truncated singular value decomposition of the weighted terms of at
most ``max_labelled`` labelled documents. Those vectors are broadcast (their number and width are
parameters, so their size is bounded), every document is projected, its cosine with every labelled vector
is computed exactly, block by block, and the ``neighbours`` nearest vote with a power of their cosine.

Defined results: a null text is an empty one; a text without terms, or one that is like no labelled
document, gets the share of label 1 among the labelled sample, and so does everything if no label is
known (then 0.5). Ties between neighbours are broken by the order of the sample, which is ordered by a
hash of the id, then by id and label; labels of one id that differ count as separate rows, equal ones as
one, null labels are left out. Null ids have no label. Of the texts of one labelled id the one with the
smallest hash is learnt from. Repeated rows are scored each; an empty table gives an empty one.
Other columns stay; ``score`` and ``predicted`` are replaced if they are there.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import strings

BUCKETS = 4096
MARKS = 16  # levels of the share of words that repeat the word before; as a field they weigh like all trigrams
WIDTH = BUCKETS + MARKS
BLOCK = 512


class Model(NamedTuple):
    idf: np.ndarray  # weight of each term
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled documents x dimensions, of length 1
    labels: np.ndarray
    prior: float
    neighbours: int
    power: float


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and count of the terms of a text."""
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0)
    padded = np.concatenate([[32], raw, [32]]).astype(np.uint32)
    grams = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
    counts = np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=WIDTH).astype(np.float64)
    words = text.split()
    again = sum(map(str.__eq__, words, words[1:]))
    counts[BUCKETS:BUCKETS + min(MARKS, 20 * again // max(1, len(words)))] = 1
    at = np.flatnonzero(counts)
    return at, counts[at]


def _weights(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logarithmic counts of trigrams by rarity, of length 1, beside the marks."""
    out = (1 + np.log(counts)) * idf[at]
    grams = at < BUCKETS
    out[grams] /= np.sqrt((out[grams] ** 2).sum())
    out[~grams] = MARKS ** -0.5
    return out.astype(np.float32)


def _matrix(found: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """Weighted terms, one row for each document."""
    out = np.zeros((len(found), WIDTH), np.float32)
    for i, (at, counts) in enumerate(found):
        if len(at):
            out[i, at] = _weights(at, counts, idf)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows.astype(np.float64) ** 2).sum(1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0).astype(np.float32)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and the number of documents. Tasks count on their own;
    at most ``WIDTH + 1`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(WIDTH + 1, np.int64), 0
        for batch in batches:
            for text_ in strings(batch.column(0)):
                seen[terms(text_)[0]] += 1
                n += 1
        seen[WIDTH] = n
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at), pa.array(seen[at])], ["term", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(count, "term long, n long")
    total = np.zeros(WIDTH + 1, np.int64)
    for row in rows.groupBy("term").agg(F.sum("n").alias("n")).collect():
        total[row["term"]] = row["n"]
    return total[:WIDTH], int(total[WIDTH])


def fit(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text", max_labelled: int = 3000,
        dimensions: int = 64, neighbours: int = 15, power: float = 8.0, seed: int = 7) -> Model:
    """Learn from ``docs`` (term statistics: all of them) and ``labels`` (``doc_id`` and the 0/1 column
    ``label``): the documents of the ``max_labelled`` ids with the smallest hashes, one text for each id and
    label however many rows have it."""
    df, n = document_frequencies(docs, text)
    idf = np.log((1 + n) / (1 + df)) + 1

    @F.arrow_udf("struct<at: array<int>, counts: array<float>>")
    def found(texts: pa.Array) -> pa.Array:
        pairs = [terms(t) for t in strings(texts)]
        return pa.StructArray.from_arrays([pa.array([a.astype(np.int32) for a, _ in pairs], pa.list_(pa.int32())), pa.array([c.astype(np.float32) for _, c in pairs], pa.list_(pa.float32()))], ["at", "counts"])

    marks = labels.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{label}`").cast("int").alias("_label")).dropna().distinct()
    # at most max_labelled ids are broadcast, so no text is shuffled to find their documents
    chosen = F.broadcast(marks.orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_labelled))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text")).join(chosen, "_id")
    # tasks keep one text of each id before anything is shuffled, so an id that holds many rows takes one place
    rows = rows.groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("_hash"), "_text")).alias("one"))
    rows = rows.select("_id", "_label", found("one._text").alias("t")).orderBy(F.xxhash64("_id"), "_id", "_label")
    sample = rows.select("_label", "t.at", "t.counts").collect()
    y = np.array([r["_label"] for r in sample], np.float32)
    x = _matrix([(np.array(r["at"], np.int64), np.array(r["counts"])) for r in sample], idf)
    random = np.random.default_rng(seed).standard_normal((WIDTH, dimensions + 16)).astype(np.float32)
    basis = np.linalg.qr(x @ random)[0] if len(x) else np.zeros((0, 0), np.float32)
    for _ in range(4):
        basis = np.linalg.qr(x @ (x.T @ basis))[0]
    axes = np.linalg.svd(basis.T @ x, full_matrices=False)[2][:dimensions].T if len(x) else np.zeros((WIDTH, 1))
    axes = np.ascontiguousarray(axes, np.float32)
    return Model(idf, axes, _unit(x @ axes), y, float(y.mean()) if len(y) else 0.5, neighbours, power)


def votes(model: Model, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Scores of a block of documents, from their cosines with every labelled vector."""
    if not len(model.labels):
        return np.full(len(found), model.prior)
    latent = np.zeros((len(found), model.axes.shape[1]), np.float32)
    for i, (at, counts) in enumerate(found):
        if len(at):
            latent[i] = _weights(at, counts, model.idf) @ model.axes[at]
    cosine = _unit(latent) @ model.vectors.T
    k = min(model.neighbours, cosine.shape[1])
    nearest = np.argsort(-cosine, axis=1, kind="stable")[:, :k] if k == cosine.shape[1] else _top(cosine, k)
    weight = np.clip(np.take_along_axis(cosine, nearest, 1), 0, 1).astype(np.float64) ** model.power
    total = weight.sum(1)
    share = (weight * model.labels[nearest]).sum(1)
    return np.clip(np.divide(share, total, out=np.full(len(found), model.prior), where=total > 0), 0, 1)


def _top(cosine: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest of each row; of equals at the border those that come first."""
    bound = np.partition(cosine, -k, axis=1)[:, -k][:, None]
    rank = np.where(cosine > bound, 2, np.where(cosine == bound, 1, 0))
    # the larger ones all, of those at the border as many as are missing
    missing = k - (rank == 2).sum(1, keepdims=True)
    at_border = (rank == 1) & (np.cumsum(rank == 1, axis=1) <= missing)
    return np.nonzero((rank == 2) | at_border)[1].reshape(len(cosine), k)


def score(docs: DataFrame, model: Model, text: str = "text", accept: float = 0.7) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``accept`` on)."""
    # plain arrays, which a worker reads without this package
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = strings(batch)
            out = [votes(Model(*shared.value), [terms(t) for t in texts[i:i + BLOCK]]) for i in range(0, len(texts), BLOCK)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return docs.withColumn("score", scores(F.col(f"`{text}`").cast("string"))).withColumn("predicted", (F.col("score") >= accept).cast("int"))
