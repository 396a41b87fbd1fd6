"""Periodic runs of words, found through a dictionary of basic factors.

A basic factor is a stretch of a power of two words. Equal factors have one name, and the names of a
length are made from the pairs of names of half that length; a factor that occurs once is left out of
all longer ones, so plain prose ends after few lengths.

A run of period ``q`` with ``h <= q < 2 h`` shows a factor of length ``h`` again ``q`` words later. All
occurrences of a factor that follow each other within ``h / 2`` are one arithmetic progression. A period
is therefore proposed from each occurrence to the first one of the following progressions, and from the
last of a progression to the last of those, within ``2 h``: no run escapes. Where the run shows the left
end of its progression, first and first are ``q`` apart; where it shows the right end, last and last are;
where it shows neither, its first word and the next progression's first are.

Each proposal is extended to both sides by halving factor lengths, and of proposals with the same words
the smallest period stays. Documents are joined to long sequences with a word of its own between two,
which no run can hold, so the work is done on whole arrays however short the texts are.

Defined results: a null text is an empty one; a text without words has no runs and is empty when
collapsed; rows are independent, so repeated rows and ties of ids need no rule; an empty table gives an
empty table. Other columns stay; a column that has the name of a new one is replaced by it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JOINED_WORDS = 1 << 16  # words of short texts that are looked at together
RUN = "struct<start: long, length: long, period: long>"
FOUND = f"struct<n_words: long, runs: array<{RUN}>, collapsed: string>"
RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def factor_names(words: np.ndarray) -> list[np.ndarray]:
    """For each power of two, as long as factors of that length repeat, a name for the factor at every place.

    Factors that repeat have names from zero on; one that does not has a negative name no other place has.
    """
    alone = -np.arange(1, len(words) + 1, dtype=np.int64)
    levels: list[np.ndarray] = []
    places, keys, h = np.arange(len(words)), words, 1
    while len(places):
        _, name, times = np.unique(keys, return_inverse=True, return_counts=True)
        repeated = times[name] > 1
        places, name = places[repeated], name[repeated]
        if not len(places):
            break
        names = alone.copy()
        names[places] = name
        levels.append(names)
        places = places[places + h < len(words)]
        places = places[names[places + h] >= 0]
        keys = names[places] * len(words) + names[places + h]
        h *= 2
    return levels


def proposals(names: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods from ``h`` up to ``2 h`` that the factors of length ``h`` propose."""
    live = np.flatnonzero(names >= 0)
    order = np.argsort(names[live], kind="stable")
    at = live[order]
    name = names[at]
    new = np.ones(len(at), bool)
    new[1:] = (name[1:] != name[:-1]) | (2 * (at[1:] - at[:-1]) > h)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    progression = np.cumsum(new) - 1
    places, periods = [], []

    def propose(start: np.ndarray, group: np.ndarray, ends: np.ndarray) -> None:
        for step in (1, 2, 3, 4):  # gaps between progressions are over h / 2
            ahead = group + step
            fits = ahead < len(first)
            fits[fits] &= name[first[ahead[fits]]] == name[first[group[fits]]]
            period = at[ends[ahead[fits]]] - start[fits]
            wanted = (period >= h) & (period < 2 * h)
            places.append(start[fits][wanted])
            periods.append(period[wanted])

    propose(at, progression, first)
    propose(at[last], np.arange(len(last)), last)
    return np.concatenate(places), np.concatenate(periods)


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, side: int) -> np.ndarray:
    """How many words from ``a`` on are those from ``b`` on (side 1), or those before them (side -1)."""
    n, length = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = (a + length, b + length) if side > 0 else (a - length - (1 << k), b - length - (1 << k))
        inside = (x >= 0) & (y < n)
        equal = np.zeros(len(a), bool)
        equal[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        length[equal] += 1 << k
    return length


def find_runs(words: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run of at least ``least`` words and two periods,
    by start, then period. ``words`` are numbers, equal for equal words."""
    levels = factor_names(words)
    found = [np.zeros((0, 3), np.int64)]
    for k, names in enumerate(levels):
        place, period = proposals(names, 1 << k)
        start = place - _common(levels, place, place + period, -1)
        length = place + period + _common(levels, place, place + period, 1) - start
        long = length >= np.maximum(least, 2 * period)
        found.append(np.unique(np.column_stack([start, length, period])[long], axis=0))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # a multiple of a run's period stretches over the same words
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[fresh]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def _together(texts: list[list[bytes]], least: int) -> list[tuple[int, list[dict], bytes]]:
    """Number of words, runs and collapsed text of some texts, whose words are given."""
    number: dict[bytes, int] = defaultdict(count(1).__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    words = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    for begin, text in zip(begins.tolist(), texts):
        words[begin:begin + len(text)] = np.fromiter(map(number.__getitem__, text), np.int64, len(text))
    words[begins + sizes] = -np.arange(1, len(texts) + 1)  # what stands between two texts
    start, length, period = find_runs(words, least)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    kept = (np.cumsum(depth[:-1]) == 0).tolist() if len(start) else []
    owner = np.searchsorted(begins, start, "right") - 1
    runs: dict[int, list[dict]] = defaultdict(list)
    for k, s, n, q in zip(owner.tolist(), (start - begins[owner]).tolist(), length.tolist(), period.tolist()):
        runs[k].append({"start": s, "length": n, "period": q})
    out = []
    for k, (begin, text) in enumerate(zip(begins.tolist(), texts)):
        rest = compress(text, kept[begin:begin + len(text)]) if k in runs else text
        out.append((len(text), runs.get(k, []), b" ".join(rest)))
    return out


def _blocks(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    held, n = [], 0
    for text in texts:
        words = (text or b"").split()  # of bytes: white space is ASCII white space
        if held and n + len(words) > JOINED_WORDS:
            yield held
            held, n = [], 0
        held.append(words)
        n += len(words) + 1
    if held:
        yield held


def collapse(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """Add ``n_words``, ``runs`` (``start`` word from 0, ``length``, ``period``; by start, then period) and
    ``collapsed``: the words without those that a run holds after its first period, joined by a space."""

    @F.arrow_udf(FOUND)
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [row for block in _blocks(batch.cast(pa.binary()).to_pylist()) for row in _together(block, least)]
            n, runs, rest = zip(*rows) if rows else ((), (), ())
            columns = [pa.array(n, pa.int64()), pa.array(runs, pa.list_(RUN_TYPE)), pa.array(rest, pa.binary()).cast(pa.string())]
            yield pa.StructArray.from_arrays(columns, ["n_words", "runs", "collapsed"])

    new = ("n_words", "runs", "collapsed")
    found = look(F.col(f"`{text}`").cast("string"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    place = "_found"
    while place.lower() in {c.lower() for c in docs.columns}:
        place = f"_{place}"
    return docs.select(*kept, found.alias(place)).select(*kept, *[F.col(f"`{place}`.{c}").alias(c) for c in new])
