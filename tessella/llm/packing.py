"""Packing documents into sequences by the histogram of lengths, shortest pack first.

Documents longer than a sequence are cut at multiples of its length. The histogram of piece lengths
(at most one count for each length, whatever the corpus) goes to the driver, where lengths are placed
longest first into the pack that is shortest so far; packs of the same content are one pattern with a
count, so the work depends on the number of lengths and not on the number of documents. Pieces are
numbered within their length, and a piece's number says which pattern, and which sequence of that
pattern, it belongs to.

Defined results: a null text is an empty one, whose document is its end id; a null document id is kept;
repeated rows are packed each; equal lengths are told apart by the place where Spark reads them, so any
assignment of equal lengths is a right one; an empty table gives no pieces. Other columns of the input
are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import strings, written
from tessella.llm.tokens import PartEncoder

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, nth long"


def pieces(docs: DataFrame, encoder: Callable[[], PartEncoder], end_id: int, size: int, doc_id: str = "doc_id", text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """The pieces of every document: its ids and ``end_id``, cut at multiples of ``size``.

    ``part, nth`` number the pieces of one length within the task that made them. ``with_ids`` adds
    the ids of the piece as little-endian unsigned 32-bit integers.
    """
    end = np.array([end_id], "<u4").tobytes()
    schema = PIECES + ", ids binary" * with_ids
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()][: 7 + with_ids]
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder().encode, TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                few, rows = batch.slice(i, 256), []
                for name, ids in zip(few.column(0).to_pylist(), encode(strings(few.column(1)))):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, size):
                        piece = ids[4 * start:4 * (start + size)]
                        length = len(piece) // 4
                        rows.append((name, start, length, zlib.crc32(piece), n, part, seen[length], piece))
                        seen[length] += 1
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    return rows.mapInArrow(cut, schema)


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packs as ``(count, lengths)``: every length of the histogram placed, longest first, into the
    pack with the most room; a new pack where none has enough."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        gap = max((g for g in room if g >= length and room[g]), default=None)
        while left and gap is not None:
            while left and room[gap]:
                count, held = room[gap].pop()
                used = min(count, left)
                if used < count:
                    room[gap].append((count - used, held))
                room[gap - length].append((used, (*held, length)))
                left -= used
            if left:
                gap = max((g for g in room if g >= length and room[g]), default=None)
        if left:
            room[size - length].append((left, (length,)))
    return [p for g in sorted(room) for p in room[g]]


def slots(packs: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For every place in a pattern: its length, the first number of the pieces that go there, the
    first sequence of the pattern and the offset in it; ordered by length and number."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, lengths in packs:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def assign(cut: DataFrame, size: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the pieces of a written table that has ``length`` (1 to
    ``size``), ``part`` and ``nth``.

    The table of places is bounded by the number of lengths, not by the data.
    """
    counts = written(cut.groupBy("part", "length").agg(F.count("*").alias("_n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = slots(patterns(histogram, size))
    before = counts.select("part", "length", (F.sum("_n").over(Window.partitionBy("length").orderBy("part")) - F.col("_n")).alias("_before"))
    shared = cut.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        t = shared.value
        length, number = lengths.to_numpy(zero_copy_only=False).astype(np.int64), numbers.to_numpy(zero_copy_only=False)
        row = np.zeros(len(length), np.int64)
        for n in np.unique(length):
            lo, hi = np.searchsorted(t["length"], [n, n + 1])
            at = length == n
            row[at] = lo + np.searchsorted(t["first"][lo:hi], number[at], "right") - 1
        return pa.StructArray.from_arrays([pa.array(t["sequence"][row] + number - t["first"][row]), pa.array(t["offset"][row])], ["sequence_id", "offset"])

    ranked = cut.join(before, ["part", "length"]).withColumn("_place", place(F.col("length"), F.col("nth") + F.col("_before")))
    return ranked.select(*[c for c in cut.columns if c not in ("part", "nth")], "_place.sequence_id", "_place.offset")
