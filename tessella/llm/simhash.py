"""Near-duplicates by SimHash: a self-join of a binary trie over the fingerprints.

A node of the trie is a prefix of bits. Pairs of nodes are walked together, level by level: both go on
with the same bit for free, with different bits for one unit of the budget, and a pair whose budget is
spent is left. Both halves of the walk are spread: the first levels are walked once over the prefixes
that occur, which gives the pairs of subtrees that can still meet; each such pair is one group, whose
remaining levels are walked on sorted arrays of fingerprints.

A subtree pair gives a spanning forest of its links and not every link, so a group of thousands of near
copies costs rows in proportion to its size; components stay the same. Prefixes grow with the number of
fingerprints, and prefixes that hold too many of them are dealt further into salted parts, so a group's
size is bounded. Copies of a fingerprint take part once.

Defined results: a null text is an empty one, and texts without words have fingerprint zero, which is
linked like any other; a null document id is kept, and a component's name is the smallest id that is not
null; repeated rows stay; an empty table gives an empty table. Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import plain_name, strings, written
from tessella.llm.components import components

BITS = 64
SEED = 42
PART_ROWS = 1 << 17  # fingerprints that one side of a subtree pair holds at most, more or less
PAIR_ROWS = 1 << 20  # node pairs held at a time while a level is walked


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Hashes of the ``width``-word shingles in their order; a text with fewer words is one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    ends = ends[min(width, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, n)


def fingerprint_of(text: str, width: int = 3) -> int:
    """SimHash of the ``width``-word shingles, as a signed 64-bit integer."""
    hashes = shingle_hashes(text, width)
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 14):
        counts += np.unpackbits(hashes[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<i8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([fingerprint_of(t) for t in strings(batch)], pa.int64())


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), _fingerprints(F.col(f"`{text}`").cast("string")).alias("fingerprint"))


def _sorted_bits(values: np.ndarray) -> np.ndarray:
    return np.sort(values.view(np.uint64))


def trie_links(left: np.ndarray, right: np.ndarray | None, budget: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of fingerprints with at most ``budget`` differing bits, in blocks.

    ``left`` and ``right`` are sorted unsigned arrays whose members agree on the first ``depth`` bits
    within each array; ``right`` None joins ``left`` with itself. A node is a range of a sorted array.
    """
    own = right is None
    right = left if own else right
    if not len(left) or not len(right):
        return
    shared = bin((int(left[0]) ^ int(right[0])) >> (BITS - depth) if depth else 0).count("1")
    if shared > budget:
        return
    start = np.array([[0, len(left), 0, len(right), budget - shared]], np.int64)
    stack = [(depth, start)]
    while stack:
        level, nodes = stack.pop()
        if len(nodes) > PAIR_ROWS:
            half = len(nodes) // 2
            stack += [(level, nodes[:half]), (level, nodes[half:])]
            continue
        # pairs of single fingerprints need no further walk
        single = (nodes[:, 1] - nodes[:, 0] == 1) & (nodes[:, 3] - nodes[:, 2] == 1)
        if single.any() or level == BITS:
            done = nodes if level == BITS else nodes[single]
            a, b = left[done[:, 0]], right[done[:, 2]]
            rest = a ^ b
            if 0 < level < BITS:
                rest &= np.uint64((1 << (BITS - level)) - 1)
            near = (np.bitwise_count(rest) <= done[:, 4]) if level < BITS else np.ones(len(done), bool)
            near &= a != b
            if near.any():
                yield a[near], b[near]
            if level == BITS:
                continue
            nodes = nodes[~single]
        if not len(nodes):
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - level)
        mids = []
        for side, lo, hi in ((left, nodes[:, 0], nodes[:, 1]), (right, nodes[:, 2], nodes[:, 3])):
            prefix = side[lo] & ~np.uint64((1 << (BITS - level)) - 1)
            mids.append(np.clip(np.searchsorted(side, prefix | bit), lo, hi))
        a, b, (m, k) = nodes[:, :2], nodes[:, 2:4], mids
        parts = []
        for x, y, cost in ((0, 0, 0), (1, 1, 0), (0, 1, 1), (1, 0, 1)):
            if own and (x, y) == (1, 0):
                # a node with itself: the mirrored half is the same pair
                keep = (a[:, 0] != b[:, 0]) | (a[:, 1] != b[:, 1])
            else:
                keep = np.ones(len(nodes), bool)
            lo, hi = (m, a[:, 1]) if x else (a[:, 0], m)
            lo2, hi2 = (k, b[:, 1]) if y else (b[:, 0], k)
            keep &= (hi > lo) & (hi2 > lo2) & (nodes[:, 4] >= cost)
            parts.append(np.column_stack([lo, hi, lo2, hi2, nodes[:, 4] - cost])[keep])
        grown = np.concatenate(parts)
        if own and level + 1 == BITS:
            grown = grown[(grown[:, 0] != grown[:, 2])]
        if len(grown):
            stack.append((level + 1, grown))


class Forest:
    """Union-find over the places of a sorted array."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            over = self.up[self.up]
            if (over == self.up).all():
                return over
            self.up = over

    def add(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links that join two trees, a spanning set of those given."""
        kept_a, kept_b = [], []
        while len(a):
            root = self.roots()
            ra, rb = root[a], root[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            if not len(a):
                break
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            # one link for each higher root; it is a root no longer then
            _, first = np.unique(high, return_index=True)
            kept_a.append(a[first])
            kept_b.append(b[first])
            self.up[high[first]] = low[first]
        empty = np.zeros(0, np.int64)
        return np.concatenate(kept_a or [empty]), np.concatenate(kept_b or [empty])


def _pair_forest(budget: int, depth: int):
    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        values, side = frame["fingerprint"].to_numpy(np.int64), frame["side"].to_numpy()
        both = (side == 2).any()
        left = _sorted_bits(values[side != 1])
        right = None if both else _sorted_bits(values[side == 1])
        every = left if both else np.sort(np.concatenate([left, right]))
        forest, out = Forest(len(every)), []
        for a, b in trie_links(left, right, budget, depth):
            a, b = forest.add(np.searchsorted(every, a), np.searchsorted(every, b))
            out.append(np.column_stack([every[a].view(np.int64), every[b].view(np.int64)]))
        rows = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": rows[:, 0], "b": rows[:, 1]})

    return walk


def _flips(depth: int, budget: int) -> list[int]:
    """Masks over ``depth`` bits with at most ``budget`` of them set."""
    masks = {0}
    for _ in range(min(depth, budget)):
        masks |= {m | 1 << i for m in masks for i in range(depth)}
    return sorted(masks)


def links(distinct: DataFrame, n: int, budget: int = 3, part_rows: int = PART_ROWS) -> DataFrame:
    """``a, b``: links between distinct fingerprints with at most ``budget`` differing bits, enough of
    them to connect whatever is connected. ``n`` is the number of fingerprints."""
    depth = min(max(4, math.ceil(math.log2(max(1, n / part_rows)))), 24)
    prefix: Column = F.shiftrightunsigned("fingerprint", BITS - depth)
    rows = distinct.select("fingerprint", prefix.alias("p"))
    # the first levels of the walk: prefixes that occur, each with how many parts it is dealt into
    nodes = written(rows.groupBy("p").agg(F.count("*").alias("n")), "prefixes").select("p", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    met = nodes.select(F.col("p").alias("x"), F.col("parts").alias("nx"), F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in _flips(depth, budget)]), lambda m: F.col("p").bitwiseXOR(m))).alias("y")).where("x <= y")
    met = met.join(nodes.select(F.col("p").alias("y"), F.col("parts").alias("ny")), "y")
    met = met.withColumn("sx", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).withColumn("sy", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).where("x < y OR sx <= sy")
    met = met.select("x", "sx", "y", "sy", (F.expr("x = y AND sx = sy")).alias("own"))
    asked = met.select(F.col("x").alias("p"), F.col("sx").alias("part"), "x", "sx", "y", "sy", F.when(F.col("own"), 2).otherwise(0).alias("side")).unionByName(
        met.where("NOT own").select(F.col("y").alias("p"), F.col("sy").alias("part"), "x", "sx", "y", "sy", F.lit(1).alias("side"))
    )
    dealt = rows.join(nodes, "p").select("p", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int").alias("part"), "fingerprint")
    groups = dealt.join(asked, ["p", "part"]).select("x", "sx", "y", "sy", "fingerprint", "side")
    return groups.groupBy("x", "sx", "y", "sy").applyInPandas(_pair_forest(budget, depth), "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (64-bit integer) and ``component_id`` of every row: the smallest document
    id that can be reached by links."""
    marked = written(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = written(links(distinct.select("fingerprint"), distinct.count(), budget), "links")
    labels = components(found)
    named = distinct.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("label", "fingerprint"))
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = written(named.join(names, "root").select("fingerprint", "component_id"), "classes")
    return marked.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def row_keys(docs: DataFrame, doc_id: str) -> list[Column]:
    """``_id`` and ``_row``, a hash of all columns: what tells the rows of ``docs`` apart."""
    return [F.col(f"`{doc_id}`").cast("long").alias("_id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")]


def first_row() -> Column:
    """Of rows with ``row_keys`` the one that stays: smallest id (null last), then smallest hash."""
    return F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row"))


def staying(docs: DataFrame, named: DataFrame, doc_id: str) -> DataFrame:
    """The rows of ``docs`` that are the smallest ``first`` of a ``root``, equal ones once."""
    stay = written(named.groupBy("root").agg(F.min("first").alias("first")).select("first._id", "first._row"), "staying")
    a, b = plain_name(docs, "_id"), plain_name(docs, "_row")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(n) for c, n in zip(row_keys(docs, doc_id), (a, b))])
    kept = rows.join(stay, rows[a].eqNullSafe(stay["_id"]) & (rows[b] == stay["_row"]), "left_semi")
    return kept.dropDuplicates([a, b]).drop(a, b)


def first_of_each(docs: DataFrame, budget: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with the columns of ``docs``: the row with the smallest id, and the
    smallest hash of all columns if several have it; where no row has an id, a null id counts as one.
    Rows equal in every column are one row."""
    marked = written(docs.select(*row_keys(docs, doc_id), _fingerprints(F.col(f"`{text}`").cast("string")).alias("fingerprint")), "fingerprints")
    distinct = written(marked.groupBy("fingerprint").agg(first_row().alias("first")), "distinct")
    found = written(links(distinct.select("fingerprint"), distinct.count(), budget), "links")
    named = distinct.join(components(found).withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    return staying(docs, named.withColumn("root", F.coalesce("label", "fingerprint")), doc_id)
