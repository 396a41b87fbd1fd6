"""Outlier detection by isolation forest (Liu, Ting and Zhou 2008) as Spark jobs.

A bounded sample feeds the trees, the trees are grown in parallel tasks, and the small forest is
shipped to the tasks that score the rows in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.quantiles import exact_quantiles
from tessella.session import stored

NODE = "tree int, node int, feature int, cut double, left int, right int, depth double"
EULER = 0.5772156649015329


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """One tree as rows ``node, feature, cut, left, right, depth``; leaves have feature -1."""
    rows: list[tuple] = []
    waiting = [(points, 0, 0)]
    taken = 1
    while waiting:
        part, node, depth = waiting.pop()
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (None, None)
        choices = np.nonzero(high > low)[0] if len(part) > 1 and depth < limit else []
        if len(choices) == 0:
            rows.append((node, -1, 0.0, -1, -1, depth + float(mean_path(np.array([len(part)]))[0])))
            continue
        feature = int(rng.choice(choices))
        cut = float(rng.uniform(low[feature], high[feature]))
        side = part[:, feature] < cut
        if side.all() or not side.any():  # the cut fell on the lower end
            side = part[:, feature] <= low[feature]
            cut = float(part[~side, feature].min())
        rows.append((node, feature, cut, taken, taken + 1, 0.0))
        waiting += [(part[side], taken, depth + 1), (part[~side], taken + 1, depth + 1)]
        taken += 2
    return rows


def _point(features: Sequence[str] | str) -> Column:
    """The features of a row as one array."""
    return F.col(f"`{features}`") if isinstance(features, str) else F.array(*[F.col(f"`{c}`").cast("double") for c in features])


def _complete(point: Column) -> Column:
    return F.coalesce(F.forall(point, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))


def fit_forest(df: DataFrame, features: Sequence[str] | str, id_columns: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 42) -> pd.DataFrame:
    """Grow the trees; returns the nodes (at most ``trees * (2 * sample - 1)`` rows).

    The pool holds ``trees * sample`` rows chosen by hash, a block of ``sample`` rows for each tree. Rows with a missing
    feature take no part. ``features`` are columns or one column of arrays.
    """
    wanted, spot = trees * sample, F.xxhash64(F.lit(seed), *[F.col(c) for c in id_columns])
    # only about four times the rows wanted are kept and sorted into one place, however many there are; features that
    # are computed on the way are computed for these rows only
    share = min(1.0, 4 * wanted / max(1, df.count()))
    while True:
        near = df if share == 1 else df.where(spot <= F.lit(int(-2**63 + share * (2**64 - 1))))
        near = stored(near.select(_point(features).alias("_point"), spot.alias("_spot")).where(_complete(F.col("_point"))))
        if share == 1 or near.count() >= wanted:
            break
        share = min(1.0, 4 * share)
    pool = near.orderBy("_spot", "_point").limit(wanted)
    # bounded rows in random order; tree i takes the i-th block of them, from the front again at the end
    shuffled = Window.orderBy("_spot", "_point")
    placed = pool.withColumns({"_n": F.row_number().over(shuffled) - 1, "_size": F.count("*").over(Window.partitionBy())})
    in_block = lambda i: F.pmod(F.col("_n") - i * sample, F.col("_size")) < sample
    chosen = placed.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), in_block)))

    def grow(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_n")
        points = np.stack(part["_point"].to_numpy()).astype(float)
        limit = int(np.ceil(np.log2(max(len(points), 2))))
        rows = _grow(points, np.random.default_rng([seed, int(key[0])]), limit)
        nodes = pd.DataFrame(rows, columns=["node", "feature", "cut", "left", "right", "depth"])
        nodes.insert(0, "tree", int(key[0]))
        return nodes

    return chosen.groupBy("tree").applyInPandas(grow, NODE).toPandas().sort_values(["tree", "node"])


def _levels(tree: pd.DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """A tree with all leaves on one level: ``feature, cut`` of each level, then the depths; a short branch goes on both ways."""
    feature, cut, left, right, depth = (tree[c].to_numpy() for c in ("feature", "cut", "left", "right", "depth"))
    at, levels = np.zeros(1, np.int64), []
    while (feature[at] >= 0).any():
        inner = feature[at] >= 0
        levels.append((np.where(inner, feature[at], 0), cut[at]))
        at = np.stack([np.where(inner, left[at], at), np.where(inner, right[at], at)], axis=1).ravel()
    return levels, depth[at]


def _score(x: np.ndarray, forest: list[tuple], norm: float) -> np.ndarray:
    total = np.zeros(len(x))
    values, base = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    for levels, depth in forest:
        node = np.zeros(len(x), dtype=np.int64)
        for feature, cut in levels:
            right = ~(values.take(feature.take(node) + base) < cut.take(node))
            node += node
            node += right
        total += depth.take(node)
    return -np.power(2.0, -(total / len(forest)) / norm)


def score_forest(df: DataFrame, features: Sequence[str] | str, nodes: pd.DataFrame, sample: int = 256, name: str = "score") -> DataFrame:
    """Add the score of each row, from -1 (isolated at once) towards 0; null features give null."""
    forest = [_levels(t.sort_values("node")) for _, t in nodes.groupby("tree")]
    norm = float(mean_path(np.array([sample]))[0]) or 1.0
    shipped = df.sparkSession.sparkContext.broadcast(forest)  # bounded by trees * sample

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            there, out = batch.notna().to_numpy(), np.full(len(batch), np.nan)
            if there.any():
                out[there] = _score(np.stack(batch[there].to_numpy()).astype(float), shipped.value, norm)
            yield pd.Series(out)

    point = _point(features)
    return df.withColumn(name, F.nanvl(score(F.when(_complete(point), point)), F.lit(None).cast("double")))


def isolation_forest(
    df: DataFrame,
    features: Sequence[str] | str,
    id_columns: Sequence[str],
    contamination: float = 0.01,
    trees: int = 100,
    sample: int = 256,
    seed: int = 42,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``score`` and ``anomaly``: -1 for rows below the contamination quantile of the scores, else 1.

    ``features`` are columns or one column of arrays. Rows with a missing feature take no part; both are null for
    them. ``keep`` names the columns that stay beside the two, all by default.
    """
    nodes = fit_forest(df, features, id_columns, trees, sample, seed)
    used = df.select(_point(features).alias("_point")).where(_complete(F.col("_point"))).limit(sample).count()
    scored = score_forest(df, features, nodes, used)
    scored = stored(scored if keep is None else scored.select(*[F.col(f"`{c}`") for c in keep], "score"))
    # the quantile reads the scores several times, and nothing else
    limit = exact_quantiles(scored.select("score"), "score", [contamination]).first()["quantiles"][0]
    return scored.withColumn("anomaly", F.when(F.col("score") < F.lit(limit), -1).when(F.col("score").isNotNull(), 1))
