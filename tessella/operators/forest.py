"""Random forests of classification trees, grown level by level over counted rows.

Rows with the same label whose features fall in the same bins are one cell with a count. The bootstrap of a tree takes a
cell as often as a Poisson draw of that mean says, which is what a draw for each of its rows adds up to. The draw follows
from a hash of the cell: nothing is kept for a tree but its nodes, a level is one pass over the cells, and the disk taken
is that of the cells, however many trees there are. Neither the order nor the partitions of the rows matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.sizing import literal_rows
from tessella.session import stored

MOST_LABELS = 1_000
COUNT_BYTES = 1 << 26  # of the counts a task holds; trees beyond that wait for another pass
FOUND = "tree int, node int, feature int, bin int, gain double, left array<long>, right array<long>"


def _numbers(features: Sequence[str]) -> list[Column]:
    """Features as numbers, a missing one as NaN, which is above all others."""
    return [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"f{i}") for i, c in enumerate(features)]


def _between(values: np.ndarray) -> np.ndarray:
    low, high = values[:-1], values[1:]
    with np.errstate(invalid="ignore"):
        middle = low + (high - low) / 2
    return np.where(np.isfinite(middle) & (middle < high), middle, low)


def thresholds(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Bounds of the bins of each feature: between all its values if it has at most ``bins``, else at its quantiles."""
    numbers = df.select(*_numbers(features))
    width = len(features)

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list = [np.zeros(0)] * width
        for batch in batches:
            for i in range(width):
                if seen[i] is not None:
                    values = np.union1d(seen[i], batch.column(i).to_numpy(zero_copy_only=False))
                    seen[i] = values if len(values) <= bins + 1 else None  # NaN may be one of them
        pairs = [(i, v) for i, values in enumerate(seen) for v in ([None] if values is None else values.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int32()), pa.array([v for _, v in pairs], pa.float64())], ["i", "v"])

    seen = numbers.mapInArrow(few, "i int, v double").distinct().groupBy("i").agg(
        F.max(F.col("v").isNull()).alias("many"), F.slice(F.array_sort(F.collect_set("v")), 1, bins + 2).alias("values")
    )
    found = {r["i"]: None if r["many"] else np.array(r["values"]) for r in seen.collect()}  # a row for each feature
    bounds, wide = {}, []
    for i in range(width):
        values = found.get(i, np.zeros(0))
        plain = values[~np.isnan(values)] if values is not None else None
        if plain is None or len(plain) > bins:
            wide.append(i)
        else:
            bounds[i] = np.append(_between(plain), plain[-1:] if len(plain) < len(values) else [])
    if wide:
        marks = F.array(*[F.lit(k / bins) for k in range(1, bins)])
        there = {i: F.nanvl(f"f{i}", F.lit(None).cast("double")) for i in wide}
        row = numbers.agg(
            *[F.percentile_approx(there[i], marks, 10_000).alias(f"q{i}") for i in wide],
            *[F.max(there[i]).alias(f"m{i}") for i in wide], *[F.max(F.isnan(f"f{i}")).alias(f"n{i}") for i in wide],
        ).first()
        for i in wide:
            marked = np.unique(np.array(row[f"q{i}"], dtype=float))
            bounds[i] = np.append(marked[marked < row[f"m{i}"]], [row[f"m{i}"]] if row[f"n{i}"] else [])
    return [bounds[i] for i in range(width)]


def _codes(columns: Sequence[np.ndarray], bounds: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of each value: the number of bounds below it."""
    return np.stack([np.searchsorted(b, x, side="left").astype(np.uint8) for x, b in zip(columns, bounds)], axis=1)


def _cells(df: DataFrame, features: Sequence[str], label: str, labels: Sequence[str], bounds: list[np.ndarray]) -> DataFrame:
    """``cell, n``: bins and label of equal rows as bytes, and how many rows they are."""
    place = (F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label).cast("string")) - 1).cast("int")
    width = len(features)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _codes([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)], bounds)
            marks = batch.column(width).to_numpy(zero_copy_only=False).astype("<u2").view(np.uint8).reshape(-1, 2)
            rows = np.ascontiguousarray(np.concatenate([codes, marks], axis=1))
            ends = np.arange(0, rows.size + 1, width + 2, dtype=np.int32)
            cells = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])
            yield pa.RecordBatch.from_arrays([cells], ["cell"])

    rows = df.select(*_numbers(features), place.alias("_label")).mapInArrow(code, "cell binary")
    return rows.groupBy("cell").agg(F.count("*").alias("n"))


def _uniform(spots: np.ndarray, tree: int) -> np.ndarray:
    """A number from 0 to 1 for each hash and the tree (splitmix64)."""
    x = spots + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53


def _poisson(mean: int) -> tuple[int, np.ndarray]:
    """Lowest number with a chance worth the name, and the shares up to each number from there on."""
    reach = 10 * math.sqrt(mean) + 20
    low = max(0, math.floor(mean - reach))
    k = np.arange(low, math.ceil(mean + reach) + 1, dtype=float)
    logs = np.concatenate([[math.lgamma(low + 1)], np.log(k[1:])]).cumsum()
    return low, np.exp(k * math.log(mean) - mean - logs).cumsum()


def draws(spots: np.ndarray, counts: np.ndarray, trees: Sequence[int]) -> np.ndarray:
    """How often each tree takes each cell."""
    out = np.empty((len(trees), len(counts)))
    chance = np.stack([_uniform(spots, t) for t in trees])
    for n in np.unique(counts).tolist():
        here = counts == n
        low, shares = _poisson(n)
        out[:, here] = low + np.searchsorted(shares, chance[:, here], side="right")
    return out


def _subset(seed: int, tree: int, node: int, width: int, size: int) -> np.ndarray:
    """The features a node may be split by."""
    if size == width:
        return np.arange(width)
    return np.sort(np.random.default_rng([seed, tree, node]).choice(width, size, replace=False))


def _down(codes: np.ndarray, feature: np.ndarray, split: np.ndarray, levels: int, stay: bool) -> np.ndarray:
    """Node of each row after some levels; rows of a leaf further up stay there or go to node 0."""
    flat, base, node = codes.ravel(), np.arange(len(codes)) * codes.shape[1], np.ones(len(codes), np.int64)
    for _ in range(levels):
        f = feature.take(node)
        below = 2 * node + (flat.take(base + np.maximum(f, 0)) > split.take(node))
        node = np.where(f >= 0, below, node if stay else 0)
    return node


def _impurity(counts: np.ndarray) -> np.ndarray:
    total = np.maximum(counts.sum(axis=-1, keepdims=True), 1)
    return 1.0 - ((counts / total) ** 2).sum(axis=-1)


def _best(counts: np.ndarray) -> tuple[int, int, float, np.ndarray, np.ndarray]:
    """Best split by counts of ``feature, bin, class``: place of the feature, bin, gain in Gini impurity, classes on both sides."""
    left = counts.cumsum(axis=1)
    right = left[:, -1:] - left
    whole, n_left, n_right = left[0, -1], left.sum(axis=2), right.sum(axis=2)
    n = whole.sum()
    gain = _impurity(whole) - (n_left * _impurity(left) + n_right * _impurity(right)) / max(n, 1)
    gain = np.where((n_left > 0) & (n_right > 0), gain, -1.0)
    j, b = np.unravel_index(gain.argmax(), gain.shape)
    return int(j), int(b), float(gain[j, b]), left[j, b], right[j, b]


def _level(cells: DataFrame, trees: Sequence[int], feature: np.ndarray, split: np.ndarray, level: int, seed: int, shape: tuple[int, ...], bagged: bool) -> list:
    """The best split of every node of one level of some trees."""
    width, size, bins, classes = shape
    nodes = 1 << level
    subsets = np.stack([[_subset(seed, t, nodes + i, width, size) for i in range(nodes)] for t in trees])
    shipped = cells.sparkSession.sparkContext.broadcast((feature[trees], split[trees], subsets))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, split, subsets = shipped.value
        counts = np.zeros((len(trees), nodes * size * bins * classes))
        for batch in batches:
            if not len(batch):
                continue
            rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(len(batch), width + 2)
            codes = np.ascontiguousarray(rows[:, :width])
            label = np.ascontiguousarray(rows[:, width:]).view("<u2").ravel().astype(np.int64)
            many = batch.column(1).to_numpy()
            taken = draws(batch.column(2).to_numpy().view(np.uint64), many, trees) if bagged else many.astype(float)[None].repeat(len(trees), 0)
            flat = codes.ravel()
            for i in range(len(trees)):
                node = _down(codes, feature[i], split[i], level, stay=False)
                here = np.flatnonzero((node > 0) & (taken[i] > 0))
                local = node[here] - nodes
                f = subsets[i][local]  # cell x place
                at = (local[:, None] * size + np.arange(size)) * bins + flat.take((here * width)[:, None] + f)
                at = at * classes + label[here][:, None]
                counts[i] += np.bincount(at.ravel(), np.repeat(taken[i][here], size), minlength=counts.shape[1])
        counts = counts.reshape(len(trees), nodes, -1)
        some = np.argwhere(counts.any(axis=2))
        yield pa.RecordBatch.from_arrays([
            pa.array([trees[i] for i, _ in some], pa.int32()), pa.array([nodes + int(j) for _, j in some], pa.int32()),
            pa.array([counts[i, j].tobytes() for i, j in some], pa.binary()),
        ], ["tree", "node", "counts"])

    def pick(key, part):
        counts = sum(np.frombuffer(c) for c in part["counts"]).reshape(size, bins, classes)
        j, b, gain, left, right = _best(counts)
        chosen = _subset(seed, int(key[0]), int(key[1]), width, size)[j]
        return pd.DataFrame([(key[0], key[1], chosen, b, gain, left.astype(np.int64), right.astype(np.int64))], columns=["tree", "node", "feature", "bin", "gain", "left", "right"])

    counted = cells.mapInArrow(count, "tree int, node int, counts binary")
    return counted.groupBy("tree", "node").applyInPandas(pick, FOUND).collect()  # a row for each node


@dataclass
class Forest:
    """Nodes are numbered as in a heap from 1 on; a leaf has feature -1. ``counts`` are the classes of each node."""

    features: list[str]
    labels: list[str]
    bounds: list[np.ndarray]
    feature: np.ndarray
    split: np.ndarray
    gain: np.ndarray
    counts: np.ndarray

    def prune(self) -> None:
        """Two leaves that say the same become one."""
        said = self.counts.argmax(axis=2)
        for node in range(self.feature.shape[1] // 2 - 1, 0, -1):
            leaves = (self.feature[:, 2 * node] < 0) & (self.feature[:, 2 * node + 1] < 0)
            self.feature[(self.feature[:, node] >= 0) & leaves & (said[:, 2 * node] == said[:, 2 * node + 1]), node] = -1

    def importances(self) -> list[tuple[str, float]]:
        """Features by importance, largest first: gain times rows, every tree counting the same."""
        total = np.zeros(len(self.features))
        for feature, gain, counts in zip(self.feature, self.gain, self.counts.sum(axis=2)):
            inner = feature >= 0
            own = np.bincount(feature[inner], (gain * counts)[inner], minlength=len(total))
            total += own / (own.sum() or 1.0)
        total /= total.sum() or 1.0
        return sorted(zip(self.features, total.tolist()), key=lambda x: (-x[1], x[0]))

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        """Add the label that has the largest share in the leaves of all trees."""
        shares = self.counts / np.maximum(self.counts.sum(axis=2, keepdims=True), 1)
        plain = (self.feature, self.split, shares, self.bounds, np.array(self.labels, dtype=object))
        shipped, levels = df.sparkSession.sparkContext.broadcast(plain), int(self.feature.shape[1]).bit_length() - 2

        @F.pandas_udf("string")
        def say(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            feature, split, shares, bounds, labels = shipped.value
            for batch in batches:
                if not len(batch):
                    yield pd.Series([], dtype=object)
                    continue
                codes = _codes(np.stack(batch.to_numpy()).astype(float).T, bounds)
                votes = sum(shares[t].take(_down(codes, feature[t], split[t], levels, stay=True), axis=0) for t in range(len(feature)))
                yield pd.Series(labels[votes.argmax(axis=1)])

        return df.withColumn(name, say(F.array(*_numbers(self.features))))


def fit_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 100, bins: int = 32, depth: int = 5, seed: int = 42) -> Forest:
    """A forest over the rows with a label; labels are compared as text.

    Each tree takes a bootstrap of the rows (a single one takes them as they are), each node the best of a random subset
    of features, as many as the square root of their number (a single tree: of all).
    """
    if not 2 <= bins <= 250:
        raise ValueError("from 2 to 250 bins")
    features, rows = list(features), df.where(F.col(label).isNotNull())
    labels = sorted(r[0] for r in literal_rows(rows.select(F.col(label).cast("string")).distinct(), MOST_LABELS))
    if not labels:
        raise ValueError("no rows with a label")
    bounds = thresholds(rows, features, bins)
    cells = stored(_cells(rows, features, label, labels, bounds)).select("cell", "n", F.xxhash64(F.lit(seed), "cell").alias("spot"))
    width = len(features)
    shape = (width, width if trees == 1 else math.ceil(math.sqrt(width)), max(map(len, bounds)) + 1, len(labels))
    feature, split = np.full((trees, 2 << depth), -1), np.zeros((trees, 2 << depth), np.int64)
    gain, counts = np.zeros((trees, 2 << depth)), np.zeros((trees, 2 << depth, len(labels)))
    open_trees = list(range(trees))
    for level in range(depth):
        at_once = max(1, COUNT_BYTES // (8 * math.prod(shape[1:]) << level))
        groups = [open_trees[i:i + at_once] for i in range(0, len(open_trees), at_once)]
        found = [r for g in groups for r in _level(cells, g, feature, split, level, seed, shape, trees > 1)]
        for r in found:
            t, node = r["tree"], r["node"]
            counts[t, node] = np.add(r["left"], r["right"])
            if r["gain"] > 0:
                feature[t, node], split[t, node], gain[t, node] = r["feature"], r["bin"], r["gain"]
                counts[t, 2 * node], counts[t, 2 * node + 1] = r["left"], r["right"]
        open_trees = sorted({r["tree"] for r in found if r["gain"] > 0})
    forest = Forest(features, labels, bounds, feature, split, gain, counts)
    forest.prune()
    return forest
