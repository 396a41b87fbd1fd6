"""DBSCAN as Spark jobs: on a grid for one to three dimensions, on balls around pivots for more.

Cells of the grid have side eps / sqrt(d), so two points of a cell are always neighbours. That removes the pairs
inside a cell, however full it is:

* all points of a cell with at least ``min_samples`` points are core points;
* points of other cells (fewer than ``min_samples`` each) are compared with the points of the
  cells around them, a bounded number of comparisons per point;
* whether two full cells touch is decided on bounding boxes, halved only where still undecided.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import drop_missing
from tessella.functions.sizing import small_table
from tessella.operators import balls
from tessella.session import cut

HOT_ROWS = 100_000
SHRINK = 1 - 1e-9


def _cell(xs: Sequence[str], side: float) -> Column:
    return F.struct(*[F.floor(F.col(x) / side).cast("long").alias(f"c{i}") for i, x in enumerate(xs)])


def _offsets(d: int, own: bool) -> list[tuple[int, ...]]:
    """Cells that can hold points within eps of a cell."""
    reach = math.ceil(math.sqrt(d)) + 1
    near = [o for o in product(range(-reach, reach + 1), repeat=d) if sum(max(abs(v) - 1, 0) ** 2 for v in o) <= d + 1e-6]
    return near if own else [o for o in near if any(o)]


def _around(cell: str, d: int, offsets: Sequence[tuple[int, ...]]) -> Column:
    moved = [F.struct(*[(F.col(f"{cell}.c{i}") + o[i]).alias(f"c{i}") for i in range(d)]) for o in offsets]
    return F.explode(F.array(*moved))


def _hot(cells: DataFrame, hot_rows: int) -> DataFrame:
    """The cells with more than ``hot_rows`` points, each with the number of salts it is dealt into.

    There is at most one such cell for ``hot_rows`` points; broadcast where the table passes the size check.
    """
    hot, fits = small_table(cells.where(F.col("n") > hot_rows).select("_cell", F.ceil(F.col("n") / hot_rows).cast("int").alias("salts")))
    return F.broadcast(hot) if fits else hot


def _by_cell(points: DataFrame, table: DataFrame, hot: DataFrame) -> DataFrame:
    """Join points with a per-cell table; points of hot cells stay where they are."""
    keys = hot.select("_cell")
    warm = table.join(keys, "_cell", "left_semi")
    cold = points.join(keys, "_cell", "left_anti").join(table, "_cell")
    return points.join(warm, "_cell").unionByName(cold)


def _reach(thin: DataFrame, points: DataFrame, hot: DataFrame, xs: Sequence[str], eps: float, own: bool) -> DataFrame:
    """``_id, _from, _cell, n``: points within eps of each thin point, per cell, counted before the shuffle.

    Points of hot cells carry a salt, the few thin points next to them are copied to every salt.
    """
    d = len(xs)
    asked = thin.select("_id", F.col("_cell").alias("_from"), *[F.col(x).alias(f"_q{x}") for x in xs])
    asked = asked.select("*", _around("_from", d, _offsets(d, own)).alias("_cell"))
    salts = hot
    asked = asked.join(salts, "_cell", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    ).drop("salts")
    held = points.select(F.col("_id").alias("_other"), "_cell", *xs).join(salts, "_cell", "left")
    held = held.withColumn("_salt", F.pmod(F.xxhash64("_other"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts", "_other")
    near = sum(((F.col(x) - F.col(f"_q{x}")) ** 2 for x in xs), F.lit(0.0)) <= eps * eps
    return asked.join(held, ["_cell", "_salt"]).where(near).groupBy("_id", "_from", "_cell").agg(F.count("*").alias("n"))


def _gap(xs: Sequence[str]) -> tuple[Column, Column]:
    """Squared smallest and largest distance between two boxes ``_a`` and ``_b``."""
    low, high = [], []
    for x in xs:
        apart = F.greatest(F.col(f"_b.lo{x}") - F.col(f"_a.hi{x}"), F.col(f"_a.lo{x}") - F.col(f"_b.hi{x}"), F.lit(0.0))
        wide = F.greatest(F.col(f"_b.hi{x}") - F.col(f"_a.lo{x}"), F.col(f"_a.hi{x}") - F.col(f"_b.lo{x}"))
        low.append(apart * apart)
        high.append(wide * wide)
    return reduce(lambda a, b: a + b, low), reduce(lambda a, b: a + b, high)


def _full_cell_edges(points: DataFrame, xs: Sequence[str], side: float, eps: float) -> DataFrame:
    """``left, right``: full cells with at least one pair of points within eps.

    A pair of boxes closer than eps at its widest is an edge, one further than eps at its closest
    is not; the rest is cut in half along every axis and asked again.
    """
    d = len(xs)
    box = F.struct(*[f(x).alias(f"{p}{x}") for x in xs for p, f in (("lo", F.min), ("hi", F.max))])
    shortest, widest = _gap(xs)
    forward = [o for o in _offsets(d, False) if o > (0,) * d]
    first = points.groupBy("_cell").agg(box.alias("box"))
    pairs = (
        first.select(F.col("_cell").alias("left"), F.col("box").alias("_a"), _around("_cell", d, forward).alias("right"))
        .join(first.select(F.col("_cell").alias("right"), F.col("box").alias("_b")), "right")
        .select("left", "right", F.col("left").alias("_sa"), F.col("right").alias("_sb"), "_a", "_b")
    )
    edges, half = [], side
    while True:
        pairs = cut(pairs.where(shortest <= eps * eps).withColumn("sure", widest <= eps * eps).drop("_a", "_b"))
        agreed = pairs.where("sure").select("left", "right").distinct()
        edges.append(agreed)
        open_pairs = pairs.where("not sure").drop("sure").join(agreed, ["left", "right"], "left_anti")
        if open_pairs.limit(1).count() == 0:
            return reduce(DataFrame.unionByName, edges)
        parent, half = _cell(xs, half), half / 2
        asked = open_pairs.select(F.explode(F.array("_sa", "_sb")).alias("_parent")).distinct()
        boxes = points.select("_cell", parent.alias("_parent"), _cell(xs, half).alias("_sub"), *xs)
        boxes = cut(
            boxes.groupBy("_cell", "_parent", "_sub").agg(box.alias("box"))
            .join(asked, "_parent", "left_semi")
        )
        pairs = (
            open_pairs
            .join(boxes.select(F.col("_cell").alias("left"), F.col("_parent").alias("_sa"), F.col("_sub").alias("_na"), F.col("box").alias("_a")), ["left", "_sa"])
            .join(boxes.select(F.col("_cell").alias("right"), F.col("_parent").alias("_sb"), F.col("_sub").alias("_nb"), F.col("box").alias("_b")), ["right", "_sb"])
            .select("left", "right", F.col("_na").alias("_sa"), F.col("_nb").alias("_sb"), "_a", "_b")
        )


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each connected component.

    Labels move to neighbours and then jump to the label of the label, so the rounds grow with the
    logarithm of the longest path. Every round is written to the checkpoint folder.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    ).distinct()
    both = cut(both)
    labels = cut(nodes.select("node", F.col("node").alias("label")))
    while True:
        offered = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("_l")), "other")
        offered = offered.groupBy("node").agg(F.min("_l").alias("_l"))
        # the root of a component hears the smallest label any of its members has heard
        heard = labels.join(offered, "node").groupBy(F.col("label").alias("node")).agg(F.min("_l").alias("_m"))
        moved = labels.join(offered, "node", "left").join(heard, "node", "left").select(
            "node", F.col("label").alias("_old"), F.least("label", "_l", "_m").alias("label")
        )
        jump = moved.select(F.col("node").alias("label"), F.col("label").alias("_to"))
        after = cut(moved.join(jump, "label", "left").select("node", "_old", F.least("label", "_to").alias("label")))
        changed = after.where("label <> _old").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels


def dbscan(df: DataFrame, features: Sequence[str], id_column: str, eps: float, min_samples: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``kind`` (``core``, ``border``, ``noise``) and ``cluster``.

    Rows with a missing feature have neither. A cluster is named by the smallest id among its core points, noise is -1. A border point next
    to several clusters joins the one with the smallest name. Ids must be unique integers.
    """
    d = len(features)
    if not d:
        raise ValueError("one feature at least")
    if d > 3:
        return _in_many_dimensions(df, features, id_column, eps, min_samples)
    xs = [f"x{i}" for i in range(d)]
    side = eps / math.sqrt(d) * SHRINK
    points = df.select(F.col(id_column).alias("_id"), *[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(features, xs)])
    points = drop_missing(points).withColumn("_cell", _cell(xs, side))
    cells = cut(points.groupBy("_cell").agg(F.count("*").alias("n")))
    hot = _hot(cells, hot_rows)

    sized = _by_cell(points, cells, hot)
    thin = cut(sized.where(F.col("n") < min_samples))
    full = sized.where(F.col("n") >= min_samples).drop("n")
    others = _reach(thin, points, hot, xs, eps, own=False).groupBy("_id").agg(F.sum("n").alias("_near"))
    thin = cut(
        thin.join(others, "_id", "left")
        .withColumn("core", F.col("n") + F.coalesce("_near", F.lit(0)) >= min_samples).drop("n", "_near")
    )
    thin_core = thin.where("core").drop("core")
    core = full.unionByName(thin_core.select(*full.columns))
    names = cut(core.groupBy("_cell").agg(F.min("_id").alias("node")))

    reach = cut(_reach(thin, core, hot, xs, eps, own=True).drop("n"))
    thin_edges = reach.join(thin_core.select("_id"), "_id", "left_semi").select(F.col("_from").alias("left"), F.col("_cell").alias("right")).distinct()
    links = thin_edges.unionByName(_full_cell_edges(full, xs, side, eps))
    links = links.join(names.select(F.col("_cell").alias("left"), F.col("node").alias("a")), "left")
    links = links.join(names.select(F.col("_cell").alias("right"), F.col("node").alias("b")), "right").select("a", "b").where("a <> b")
    labels = connected(names.select("node"), links)
    by_cell = cut(names.join(labels, "node").select("_cell", F.col("label").alias("cluster")))

    core_rows = _by_cell(core, by_cell, hot).select("_id", F.lit("core").alias("kind"), "cluster")
    touched = reach.join(by_cell, "_cell").groupBy("_id").agg(F.min("cluster").alias("cluster"))
    rest = thin.where("not core").select("_id").join(touched, "_id", "left").select(
        "_id", F.when(F.col("cluster").isNull(), "noise").otherwise("border").alias("kind"), F.coalesce("cluster", F.lit(-1)).alias("cluster")
    )
    marks = core_rows.unionByName(rest).withColumnRenamed("_id", id_column)
    return df.join(marks, id_column, "left")


def _in_many_dimensions(df: DataFrame, features: Sequence[str], id_column: str, eps: float, min_samples: int) -> DataFrame:
    """Equal points become one with a weight, named by their smallest id, and are marked alike."""
    vector = F.array(*[F.col(f"`{c}`").cast("double") + F.lit(0.0) for c in features])  # -0.0 is 0.0
    points = df.select(F.col(id_column).alias("_id"), vector.alias("_x")).where(F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v)))
    distinct = cut(points.groupBy(F.col("_x").alias("x")).agg(F.min("_id").alias("node"), F.count("*").alias("weight")))
    marks = balls.dbscan_points(distinct, len(features), eps, min_samples)
    by_point = distinct.join(marks, "node").select(F.col("x").alias("_x"), "kind", "cluster")
    return df.join(points.join(by_point, "_x").select(F.col("_id").alias(id_column), "kind", "cluster"), id_column, "left")
