"""Exact quantiles whose memory does not grow with the data.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here a mergeable
sketch proposes a narrow band around each wanted rank, exact counts say in which segment the rank
lies, and only the rows of that segment are counted value by value. The sketch decides the speed,
never the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.columns import drop_missing
from tessella.functions.sizing import attach, small_table

ACCURACY = 10_000
BAND_ROWS = 1_000_000
REFINE_STEPS = 32


def _segment(value: Column, edges: Column, n_edges: int) -> Column:
    """Even numbers are the open intervals between edges, odd numbers an edge itself."""
    steps = [
        (value > edges[i]).cast("int") + (value >= edges[i]).cast("int") for i in range(n_edges)
    ]
    return reduce(lambda a, b: a + b, steps)


def _ranks(probs: Sequence[float], n: Column) -> Column:
    """Zero-based ranks below and above each probability, for linear interpolation."""
    wanted = []
    for p in probs:
        place = F.lit(float(p)) * (n - 1)
        wanted += [F.floor(place), F.ceil(place)]
    return F.array_distinct(F.array(*wanted))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """One row per group with the array ``quantiles``, linear between neighbours.

    Null and NaN values and null group keys are left out. Without ``by`` there is always one row.
    """
    by = list(by)
    v = F.col(value).cast("double")
    base = df.select(*by, v.alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    if by:
        base = drop_missing(base, by)
    margin = 2.0 / accuracy
    marks = sorted({min(1.0, max(0.0, p + s)) for p in probs for s in (-margin, margin)})
    keys, level, found = by, 0, []
    hits = None
    while True:
        sketch = base.groupBy(*keys).agg(
            F.count("*").alias("_n"),
            F.percentile_approx("_v", F.array(*[F.lit(m) for m in marks]), accuracy).alias("_edges"),
        )
        if hits is None:
            sketch = sketch.select(*keys, "_edges", "_n", _ranks(probs, F.col("_n")).alias("_ranks"))
        edges, edges_fit = small_table(sketch)
        if not keys and edges.first()["_n"] == 0:
            return edges.select(F.array(*[F.lit(None).cast("double") for _ in probs]).alias("quantiles"))
        tagged = attach(base, edges.select(*keys, "_edges"), keys, edges_fit)
        tagged = tagged.withColumn("_seg", _segment(F.col("_v"), F.col("_edges"), len(marks)))
        segments = tagged.groupBy(*keys, "_seg").agg(
            F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
        if hits is None:
            entry = lambda r: F.struct(r.alias("rank"), r.alias("local"), F.col("_n").alias("n"))
            segments = attach(segments, edges.select(*keys, "_ranks", "_n"), keys, edges_fit)
            segments = segments.withColumn("_hits", F.transform("_ranks", entry)).drop("_ranks", "_n")
        else:
            segments = attach(segments, hits, keys, hits_fit)

        before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
        inside = lambda h: (h["local"] >= F.col("_start")) & (h["local"] < F.col("_start") + F.col("_c"))
        shift = lambda h: F.struct(h["rank"].alias("rank"), (h["local"] - F.col("_start")).alias("local"), h["n"].alias("n"))
        segments = (
            segments
            .withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0)))
            .withColumn("_hits", F.transform(F.filter("_hits", inside), shift))
            .where(F.size("_hits") > 0)
        )
        needed, needed_fit = small_table(segments)
        found.append(needed.where("_lo = _hi").select(*by, F.explode("_hits").alias("_h"), F.col("_lo").alias("_value")))
        todo = needed.where("_lo < _hi")
        widest = todo.agg(F.max("_c")).first()[0]
        if widest is None:
            break
        level += 1
        name = f"_seg{level}"
        keys = [*keys, name]
        hits = todo.select(*keys[:-1], F.col("_seg").alias(name), "_hits")
        hits_fit = needed_fit
        spot = tagged.select(*keys[:-1], F.col("_seg").alias(name), "_v")
        base = spot.join(F.broadcast(hits.select(*keys)) if hits_fit else hits.select(*keys), keys, "left_semi")
        if widest <= band_rows:
            upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
            values = base.groupBy(*keys, "_v").agg(F.count("*").alias("_c")).withColumn("_end", F.sum("_c").over(upto))
            picked = attach(values, hits, keys, hits_fit).select(*by, "_v", "_c", "_end", F.explode("_hits").alias("_h"))
            found.append(
                picked.where((F.col("_h.local") < F.col("_end")) & (F.col("_h.local") >= F.col("_end") - F.col("_c")))
                .select(*by, "_h", F.col("_v").alias("_value"))
            )
            break
        marks = [i / REFINE_STEPS for i in range(REFINE_STEPS + 1)]

    entries = reduce(DataFrame.unionByName, found)
    looked_up = entries.groupBy(*by).agg(
        F.first("_h.n").alias("_n"),
        F.map_from_entries(F.collect_set(F.struct("_h.rank", "_value"))).alias("_at"),
    )
    return looked_up.select(*by, F.array(*[_between(p) for p in probs]).alias("quantiles"))


def _between(p: float) -> Column:
    place = F.lit(float(p)) * (F.col("_n") - 1)
    low = F.element_at("_at", F.floor(place))
    high = F.element_at("_at", F.ceil(place))
    return low + (high - low) * (place - F.floor(place))


