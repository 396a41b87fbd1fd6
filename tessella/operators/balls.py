"""Neighbours within a distance in many dimensions, and DBSCAN on top of them.

A grid has too many cells beyond a few dimensions. Points are dealt into balls instead: each belongs to the
nearest of some pivots, and is shown to every other ball that may hold a point within ``eps``. For a point
``y`` with home ``j`` and any point of ball ``i``, the triangle inequality leaves a distance of at least half of
``d(y, p_i) - d(y, p_j)``, and at least ``d(y, p_i)`` less the ball's radius; where either exceeds
``eps``, the ball is left out. All neighbours of a point are then among those its own ball was shown.

A ball is cut into parts of a bounded number of points, and each pair of parts is one group, compared
with matrix products. Equal points are one point with a weight, so copies are never compared. A group gives
counts and a spanning forest of its links, not its pairs.

Points without structure lie near the border of most balls and would be shown to most. The copies are counted before
they move; where large parts of all points, paired with each other, move fewer rows, these are compared instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import cut

PART_ROWS = 4096  # points of a part; a group holds two parts
LARGE_BYTES = 32 << 20  # numbers of a large part
LEAST_PARTS = 8  # large parts, if there are as many of ``PART_ROWS``
BLOCK = 1 << 22  # distances held at once
MOST_PIVOTS = 4096  # sent to every task; beyond that many parts, balls have more parts


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (points * points).sum(1)[:, None] + (centres * centres).sum(1) - 2 * points @ centres.T
    return np.sqrt(np.maximum(squares, 0))


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which points of ``a`` and ``b`` are within ``eps``; what the matrix product cannot tell is subtracted."""
    squares_a, squares_b, limit = (a * a).sum(1), (b * b).sum(1), eps * eps
    squares = a @ (-2 * b.T) + squares_a[:, None] + squares_b
    slack = 1e-9 * (squares_a.max(initial=0) + squares_b.max(initial=0) + limit)
    near = squares <= limit + slack
    i, j = np.nonzero(near & (squares >= limit - slack))
    for at in range(0, len(i), 1 << 16):
        x, y = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
        near[x, y] = ((a[x] - b[y]) ** 2).sum(1) <= limit
    return near


def _blocks(a: np.ndarray, b: np.ndarray, eps: float) -> Iterator[tuple[int, np.ndarray]]:
    """``_near`` for consecutive rows of ``a``, with the number of the first."""
    rows = max(1, BLOCK // max(1, len(b)))
    for at in range(0, len(a), rows):
        yield at, _near(a[at:at + rows], b, eps)


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _choose(points: DataFrame, part_rows: int, most: int) -> tuple[np.ndarray, int]:
    """Pivots: the points with the smallest hashes, about one for each part."""
    n = points.count()
    rows = points.orderBy(F.xxhash64("x"), "node").limit(min(most, max(1, math.ceil(n / part_rows)))).select("x").collect()
    return np.array([r["x"] for r in rows], float), n


def _large_parts(n: int, d: int, part_rows: int) -> tuple[int, int]:
    """How many large parts there are, and their rows."""
    parts = max(math.ceil(n * 8 * d / LARGE_BYTES), min(LEAST_PARTS, math.ceil(n / part_rows)), 1)
    return parts, max(1, math.ceil(n / parts))


def shown(points: DataFrame, eps: float, d: int, part_rows: int = PART_ROWS, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """``ball, home, node, weight, x``: every point in its own ball (``home``) and in those it is shown to."""
    return _shown(points, eps, d, part_rows, most_pivots)[0]


def _shown(points: DataFrame, eps: float, d: int, part_rows: int, most_pivots: int) -> tuple[DataFrame, int]:
    """``shown`` and the rows of a part: one ball with all points, cut into large parts, where balls would show more."""
    centres, n = _choose(points, part_rows, most_pivots)
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _distances(_vectors(batch.column(2), d), shared.value)
                home = far.argmin(1)
                yield pa.record_batch([*batch.columns, pa.array(home.astype(np.int32)), pa.array(far[np.arange(len(home)), home])], [*batch.schema.names, "ball", "far"])

    placed = cut(points.select("node", "weight", "x").mapInArrow(homes, "node long, weight long, x array<double>, ball int, far double"))
    radius = np.full(len(centres), -np.inf)
    for r in placed.groupBy("ball").agg(F.max("far").alias("r")).collect():  # a row for each pivot
        radius[r["ball"]] = r["r"]
    slack = 1e-9 * (1 + np.abs(centres).max(initial=0))

    def met(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        far = _distances(_vectors(batch.column(2), d), shared.value)
        home = batch.column(3).to_numpy()
        own = far[np.arange(len(home)), home][:, None]
        meets = (far - own <= 2 * eps + slack) & (far <= radius + eps + slack)
        meets[np.arange(len(home)), home] = True
        return meets, home

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                meets, home = met(batch)
                each = np.bincount(np.nonzero(meets)[1], minlength=len(radius))
                own = np.bincount(home, minlength=len(radius))
                ball = np.flatnonzero(each)
                yield pa.record_batch([pa.array(ball.astype(np.int32)), pa.array(each[ball]), pa.array(own[ball])], ["ball", "each", "own"])

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            meets, home = met(batch)
            row, ball = np.nonzero(meets)
            few = batch.select(["node", "weight", "x"]).take(pa.array(row))
            yield pa.record_batch([pa.array(ball.astype(np.int32)), pa.array(ball == home[row]), *few.columns], ["ball", "home", "node", "weight", "x"])

    sizes = placed.mapInArrow(number, "ball int, each long, own long").groupBy("ball").agg(F.sum("each").alias("each"), F.sum("own").alias("own")).collect()
    # what ``_grouped`` makes of the balls, and of all points in large parts
    moved = sum(r["own"] * -(-r["each"] // part_rows) + r["each"] * -(-r["own"] // part_rows) for r in sizes)
    parts, large_rows = _large_parts(n, d, part_rows)
    if moved > 2 * n * parts:
        return placed.select(F.lit(0).alias("ball"), F.lit(True).alias("home"), "node", "weight", "x"), large_rows
    return placed.mapInArrow(copies, "ball int, home boolean, node long, weight long, x array<double>"), part_rows


def _grouped(rows: DataFrame, extra: Sequence[str], part_rows: int) -> tuple[DataFrame, DataFrame]:
    """Home points and shown points of each ball, dealt so that each pair of parts is one group."""
    sizes = rows.groupBy(F.col("ball").alias("_ball")).agg(
        F.ceil(F.count_if("home") / part_rows).cast("int").alias("homes"), F.ceil(F.count("*") / part_rows).cast("int").alias("all")
    )
    rows = rows.join(sizes, rows["ball"] == sizes["_ball"])
    part = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("home").withColumn("p", part("homes", 1)).withColumn("q", each("all"))
    right = rows.where("homes > 0").withColumn("q", part("all", 2)).withColumn("p", each("homes"))
    columns = ["ball", "p", "q", "node", "weight", "x", *extra]
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in columns])  # noqa: E731 (two sides of one table)
    return fresh(left), fresh(right)


def _counter(eps: float):
    def count(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "n": []}).astype("int64")
        weight = right["weight"].to_numpy(np.int64)
        sums = (lambda near: np.count_nonzero(near, axis=1)) if (weight == 1).all() else (lambda near: near @ weight)
        n = np.concatenate([sums(near) for _, near in _blocks(np.stack(left["x"]), np.stack(right["x"]), eps)])
        return pd.DataFrame({"node": left["node"].to_numpy(), "n": n})

    return count


def _linker(eps: float):
    """Links of a group: a forest of those between core points, and for other points one link into each tree."""

    def link(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right[right["core"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "core": []}).astype({"a": "int64", "b": "int64", "core": "bool"})
        names = np.unique(np.concatenate([left["node"], right["node"]]))
        a, b = np.searchsorted(names, left["node"]), np.searchsorted(names, right["node"])
        up = np.arange(len(names))

        def roots(i: np.ndarray) -> np.ndarray:
            top = up[i]
            while (up[top] != top).any():
                top = up[top]
            up[i] = top
            return top

        out, is_core = [], left["core"].to_numpy(bool)
        vectors, others = np.stack(left["x"]), np.stack(right["x"])
        for wanted in (True, False):  # trees of core points first, then who touches them
            which = np.flatnonzero(is_core == wanted)
            for at, near in _blocks(vectors[which], others, eps):
                for i, row in zip(which[at:at + len(near)], near):
                    j = b[row]
                    trees, first = np.unique(roots(j), return_index=True)
                    if wanted and len(trees):
                        own = roots(a[i:i + 1])[0]
                        out += [(a[i], x, True) for x in j[first[trees != own]]]
                        up[np.append(trees, own)] = min(own, trees[0])
                    elif not wanted:
                        out += [(a[i], x, False) for x in j[first]]
        rows = np.array(out, np.int64).reshape(-1, 3)
        return pd.DataFrame({"a": names[rows[:, 0]], "b": names[rows[:, 1]], "core": rows[:, 2] == 1})

    return link


def dbscan_points(points: DataFrame, d: int, eps: float, min_samples: int, part_rows: int = PART_ROWS, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """``node, kind, cluster`` of distinct points ``node, weight, x`` (an array of ``d`` numbers)."""
    from tessella.operators.density import connected

    rows, part_rows = _shown(points, eps, d, part_rows, most_pivots)
    rows = cut(rows)
    left, right = _grouped(rows, [], part_rows)
    keys = ["ball", "p", "q"]
    counts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_counter(eps), "node long, n long")
    core = cut(counts.groupBy("node").agg((F.sum("n") >= min_samples).alias("core")))
    left, right = _grouped(rows.join(core, "node"), ["core"], part_rows)
    links = cut(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_linker(eps), "a long, b long, core boolean"))
    labels = connected(core.where("core").select("node"), links.where("core").select("a", "b"))
    touched = links.where("NOT core").join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("touched"))
    marked = core.join(labels, "node", "left").join(touched, "node", "left")
    kind = F.when(F.col("core"), "core").when(F.col("touched").isNotNull(), "border").otherwise("noise")
    return cut(marked.select("node", kind.alias("kind"), F.coalesce("label", "touched", F.lit(-1)).alias("cluster")))
