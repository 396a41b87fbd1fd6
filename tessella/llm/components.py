"""Connected components of a table of links, in rounds that are joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node that has a link: the smallest node of its component.

    Every node is linked to the smallest of its neighbours, first those above it, then those below, until
    all links are stars. Hot centres are harmless: smallest neighbours are aggregated before they are
    shuffled, and the join that spreads them can be split. Every round is a table in the shared folder.
    """
    edges, before = written(_upright(links.select("a", "b")), "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = edges.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(_upright(large), "large-star")
        centre = large.groupBy("b").agg(F.min("a").alias("m"))
        # links run from the larger node (b) to the smaller (a): b's smallest neighbour takes them all
        small = large.join(centre, "b").select("b", "a", "m")
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        edges = written(_upright(small), "small-star")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
        if now == before:  # a round that changes nothing gives the same distinct links
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def _upright(edges: DataFrame) -> DataFrame:
    """Distinct links with the smaller node first."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
