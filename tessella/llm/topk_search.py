"""Exact top-k search by inner product with a table of distances to pivots.

Vectors become whole numbers and are lifted by one more component to one common length; nearest by
Euclidean distance is then highest by inner product. For every vector its distances to the pivots are
computed once. A query knows its own distances to them, and the largest difference between the two is a
lower bound of the distance. Rows are grouped by their nearest pivot; the smallest and largest distances of
a group bound all its rows at once. Some rows of the nearest groups say how far the search must go; rows of
the groups within that reach are evaluated in the order of their own bounds, until the bound alone says that
none of the rest can enter the ``k`` found. Queries whose bounds leave most rows are multiplied with the whole block.

Queries and candidates are dealt into blocks of bounded size, every block of queries meets every block
of candidates once, and only ``k`` results for each query leave a pair of blocks.

Defined results: a vector that is null, or holds null, NaN or an infinite component, takes no part, nor
does one without an id; missing components of a shorter vector are 0; an empty vector has score 0 with
all; equal scores are ordered by the smaller id; repeated rows are candidates each, a query's own row is
left out of its own search only (other rows with its id are not). Ids that repeat among the queries give
one list for each row, told apart by ``copy``. Scores that doubles may not hold are computed with Python integers, and
a score beyond 64 bits becomes the nearest 64-bit number after it was ranked. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import written

QUERY_ROWS, CANDIDATE_ROWS = 4096, 16384
EXACT = 2 ** 52  # doubles hold whole numbers, and sums of them, up to here
TILE = 256
TRIES = 4  # queries of a tile whose rows' own bounds left most rows; then groups' bounds decide for the others


def _ints(vectors: list) -> np.ndarray:
    """Rows of whole numbers, as doubles where those are exact, else as Python integers."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    if np.abs(out).max(initial=0) ** 2 * max(1, width) < EXACT:
        return out
    return np.array([[int(x) for x in row] for row in out], object).reshape(out.shape)


def _pad(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.hstack([a, np.zeros((len(a), width - a.shape[1]), a.dtype)])


def search_block(queries: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, own: np.ndarray, k: int, pivots: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each query the places of its ``k`` best rows (-1: fewer) and their scores, by score, then id;
    and the number of products evaluated. ``own`` has the place of the query's own row, or -1."""
    width = max(queries.shape[1], rows.shape[1])
    queries, rows = _pad(queries, width), _pad(rows, width)
    exact = queries.dtype == rows.dtype == np.float64
    q, x = queries.astype(np.float64), rows.astype(np.float64)
    square = (x * x).sum(1)
    top = square.max(initial=0.0)
    lifted = np.sqrt(top - square)
    # pivots far from each other: the vector farthest from all chosen so far is the next
    at, gap, chosen = 0, np.full(len(x), np.inf), []
    for _ in range(min(pivots, len(x))):
        chosen.append(at)
        gap = np.minimum(gap, np.maximum(2 * (top - x @ x[at] - lifted * lifted[at]), 0))
        at = int(gap.argmax())
    table = np.sqrt(np.maximum(2 * (top - x @ x[chosen].T - np.outer(lifted, lifted[chosen])), 0))
    query_square = (q * q).sum(1)
    to_pivots = np.sqrt(np.maximum(query_square[:, None] + top - 2 * (q @ x[chosen].T), 0))
    best = np.full((len(q), k), -1, np.int64)
    scores = np.zeros((len(q), k), object if not exact else np.int64)
    # rounding of roots must not make a bound too high
    slack = 1e-6 * np.sqrt(top + query_square + 1)
    reach = lambda i, score: math.sqrt(max(query_square[i] + top - 2 * float(score), 0)) * (1 + 1e-9) + 1e-6
    evaluated = 0

    def within_reach(i: int, open_: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Those of the rows whose own bounds do not exclude them, and these bounds."""
        open_ = open_[open_ != own[i]]
        bound = np.maximum(np.abs(table[open_] - to_pivots[i]).max(1, initial=0) * (1 - 1e-9) - slack[i], 0)
        return open_[bound <= limit], bound[bound <= limit]

    def walk(i: int, open_: np.ndarray, bound: np.ndarray, limit: float) -> None:
        """Rows in the order of their bounds, more at a time, until the bound alone ends the search."""
        nonlocal evaluated
        place, score = np.zeros(0, np.int64), np.zeros(0, scores.dtype)
        order = np.argsort(bound, kind="stable")
        open_, bound, step = open_[order], bound[order], 4 * k + TILE
        while len(open_) and bound[0] <= limit:
            few = open_[:min(step, int(np.searchsorted(bound, limit, "right")))]
            open_, bound, step = open_[len(few):], bound[len(few):], 2 * step
            evaluated += len(few)
            found = (x[few] @ q[i]).astype(np.int64) if exact else np.array([sum(a * b for a, b in zip(rows[j], queries[i])) for j in few], object)
            place, score = np.concatenate([place, few]), np.concatenate([score, found])
            order = np.lexsort((row_ids[place], -score)) if exact else np.array(sorted(range(len(place)), key=lambda j: (-score[j], row_ids[place[j]])), np.int64)
            place, score = place[order[:k]], score[order[:k]]
            if len(place) == k:
                limit = reach(i, score[-1])  # a row with this distance or less may still tie
        best[i, :len(place)], scores[i, :len(place)] = place, score

    if not exact or not len(x):
        for i in range(len(q)):
            walk(i, *within_reach(i, np.arange(len(x)), math.inf), math.inf)
        return best, scores, evaluated
    # rows by the pivot they are nearest to, and how near and far each group is to every pivot
    home = table.argmin(1)
    by_home = np.argsort(home, kind="stable")
    x_by_home, starts = x[by_home], np.flatnonzero(np.diff(home[by_home], prepend=-1))
    low, high = np.minimum.reduceat(table[by_home], starts), np.maximum.reduceat(table[by_home], starts)
    stops = np.append(starts[1:], len(x))
    for tile in range(0, len(q), TILE):
        mine = to_pivots[tile:tile + TILE, None, :]
        bounds = np.maximum(np.maximum(low - mine, mine - high).max(2) * (1 - 1e-9) - slack[tile:tile + TILE, None], 0)
        whole, floors, wide = [], [], 0
        for i, bound in enumerate(bounds, tile):
            # some rows of the nearest groups say how far the search must go
            first, at, n = np.argsort(bound, kind="stable"), [], 0
            for g in first:
                at.append(np.arange(starts[g], min(stops[g], starts[g] + 4 * k + TILE - n)))
                n += len(at[-1])
                if n >= 4 * k + TILE:
                    break
            at = np.concatenate(at)
            at = at[by_home[at] != own[i]]
            evaluated += len(at)
            found = x_by_home[at] @ q[i]
            floor = np.partition(found, -k)[-k] if len(found) >= k else -math.inf
            limit = reach(i, floor) if len(found) >= k else math.inf
            open_ = by_home[np.repeat(bound <= limit, stops - starts)]
            many = 4 * len(open_) > len(x)
            if many and wide >= TRIES:
                whole.append(i)
                floors.append(floor)
                continue
            open_, bound = within_reach(i, open_, limit)
            if 4 * len(open_) > len(x):
                wide += 1
                whole.append(i)
                floors.append(floor)
                continue
            wide -= many
            walk(i, open_, bound, limit)
        if whole:
            # the bounds leave most rows: one product of all these queries with the block is cheaper than many with parts
            evaluated += len(whole) * len(x)
            products = q[whole] @ x.T
            asks = np.flatnonzero(own[whole] >= 0)
            products[asks, own[whole][asks]] = -math.inf
            n, place = np.nonzero((products >= np.array(floors)[:, None]) & (products > -math.inf))
            score = products[n, place].astype(np.int64)
            order = np.lexsort((row_ids[place], -score, n))
            n, place, score = n[order], place[order], score[order]
            rank = np.arange(len(n)) - np.searchsorted(n, n)
            n, place, score, rank = (c[rank < k] for c in (n, place, score, rank))
            best[np.array(whole)[n], rank], scores[np.array(whole)[n], rank] = place, score
    return best, scores, evaluated


def _double(score: int) -> float:
    try:
        return float(score)
    except OverflowError:
        return math.inf if score > 0 else -math.inf


def _searcher(k: int, pivots: int):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "copy": [], "id": [], "score": [], "size": []}).astype({"query": "int64", "copy": "int64", "id": "int64", "score": "int64", "size": "float64"})
        ids, copies = right["id"].to_numpy(np.int64), right["copy"].to_numpy(np.int64)
        places = {(a, b): i for i, (a, b) in enumerate(zip(ids.tolist(), copies.tolist()))}
        own = np.array([places.get((a, b), -1) for a, b in zip(left["id"], left["copy"])], np.int64)
        best, scores, _ = search_block(_ints(list(left["vector"])), _ints(list(right["vector"])), ids, own, k, pivots)
        at, rank = np.nonzero(best >= 0)
        score = np.array([min(max(int(s), -2 ** 63), 2 ** 63 - 1) for s in scores[at, rank]], np.int64)
        size = np.array([_double(s) for s in scores[at, rank]])  # what 64 bits may not hold
        return pd.DataFrame({"query": left["id"].to_numpy(np.int64)[at], "copy": left["copy"].to_numpy(np.int64)[at], "id": ids[best[at, rank]], "score": score, "size": size})

    return lambda key, left, right: search(left, right)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int = 32,
          query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """``query_id, copy, rank, vec_id, score`` of the ``k`` rows with the highest inner product of
    ``floor(scale * x)`` for every row that fulfils ``is_query``, its own row left out."""
    raw = F.col(f"`{embedding}`")
    fine = raw.isNotNull() & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) != math.inf))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.when(fine, raw).alias("raw"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where("raw IS NOT NULL AND id IS NOT NULL")
    # a double of this size is whole already, and beyond the integers that floor gives
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
    rows = rows.select("id", "asks", F.transform("raw", lambda x: whole(x.cast("double") * scale)).alias("vector"))
    # a third of all rows may be one vector; they differ in their ids, and rows with one id in their copy
    rows = written(rows.withColumn("copy", F.monotonically_increasing_id()), "vectors")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    blocks, asking = max(1, math.ceil(sizes["n"] / candidate_rows)), max(1, math.ceil(sizes["q"] / query_rows))
    dealt = rows.select("id", "copy", "vector", "asks", F.pmod(F.xxhash64("copy"), F.lit(blocks)).alias("x"), F.pmod(F.xxhash64("copy", F.lit(1)), F.lit(asking)).alias("q"))
    left = dealt.where("asks").select("id", "copy", "vector", "q", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("x"))
    right = dealt.select("id", "copy", "vector", F.explode(F.expr(f"sequence(0L, {asking - 1}L)")).alias("q"), "x")
    found = left.groupBy("q", "x").cogroup(right.groupBy("q", "x")).applyInPandas(_searcher(k, pivots), "query long, copy long, id long, score long, size double")
    order = Window.partitionBy("query", "copy").orderBy(F.desc("size"), F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "copy", "rank", F.col("id").alias("vec_id"), "score")
