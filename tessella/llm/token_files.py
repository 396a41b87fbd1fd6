"""Token ids on disk as directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level ``k`` holds the ``k``-th chunk of every id
that has one, a bitmap that says which of them go on in the next level, and a rank directory: how many
bits are set before each block of the bitmap. The chunk of the next level is therefore found by one
rank, and any id is read without decoding its neighbours.

A dataset is a Parquet table of segments: ``part, seq`` in ascending order of the documents, how many
documents and ids the segment has, and its ``payload`` in the format below. Spark's commit protocol
writes it, so retried and lost tasks leave nothing half done, in any store Spark can write to.

Payload: ``magic``, number of documents, ids and levels; then document ids, a null mark for each of
them, start of each document in the segment and the end; then for each level its length, chunks,
bitmap and directory. All numbers are little-endian.

Defined results: a null text is an empty one, whose document has the end id only; a null document id
comes first; equal document ids are ordered by a hash of the text, then by the text, and repeated rows
stay; an empty table gives an empty dataset. Other columns of the input are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import strings
from tessella.llm.tokens import PartEncoder

MAGIC = b"DAC1"
BLOCK = 512  # bits of a bitmap for each entry of its directory
SEGMENT_IDS = 1 << 20
SEGMENTS = "part int, seq int, n_docs long, n_ids long, payload binary"


def pack(ids: np.ndarray, docs: list[int | None], starts: np.ndarray) -> bytes:
    """A segment's payload. ``starts`` has the first id of each document and the end."""
    levels = []
    rest = ids.astype(np.uint64)
    while len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(rest) // BLOCK) * BLOCK, np.uint8)
        padded[:len(rest)] = more
        before = np.concatenate([[0], np.cumsum(padded.reshape(-1, BLOCK).sum(1, dtype=np.int64))[:-1]]).astype("<u8")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + before.tobytes())
        rest = rest[more] >> 8
    head = MAGIC + struct.pack("<QQI", len(docs), len(ids), len(levels))
    names = np.array([d or 0 for d in docs], "<i8").tobytes() + np.array([d is None for d in docs], np.uint8).tobytes()
    return head + names + starts.astype("<u8").tobytes() + b"".join(levels)


class Segment:
    """Random access to the ids of one payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        n_docs, self.n_ids, n_levels = struct.unpack_from("<QQI", payload, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        docs, missing = take("<i8", n_docs), take("u1", n_docs)
        self.docs = [None if m else int(d) for d, m in zip(docs, missing)]
        self.starts = take("<u8", n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            self.levels.append((take("u1", n), take("u1", -(-n // 8)), take("<u8", -(-n // BLOCK))))

    def _rank(self, level: int, i: int) -> int:
        """Bits set before place ``i``."""
        chunks, bits, before = self.levels[level]
        if i >= len(chunks):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        block = i // BLOCK
        inside = np.unpackbits(bits[block * BLOCK // 8:i // 8 + 1], bitorder="little")[:i - block * BLOCK]
        return int(before[block]) + int(inside.sum())

    def id_at(self, i: int) -> int:
        """One id; each level costs one look at its bitmap and directory."""
        value = shift = level = 0
        while True:
            chunks, bits, _ = self.levels[level]
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            i, level, shift = self._rank(level, i), level + 1, shift + 8

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop``."""
        out = np.zeros(stop - start, np.uint64)
        places = np.arange(stop - start)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if not len(places):
                break
            out[places] |= chunks[start:stop].astype(np.uint64) << np.uint64(8 * level)
            more = np.unpackbits(bits[start // 8:-(-stop // 8)], bitorder="little")[start % 8:][:stop - start].astype(bool)
            places = places[more]
            start = self._rank(level, start)
            stop = start + len(places)
        return out.astype("<u4")

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write(docs: DataFrame, path: str, encoder: Callable[[], PartEncoder], end_id: int, doc_id: str = "doc_id", text: str = "text",
          segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of every text, each followed by ``end_id``, in ascending order of ``doc_id``.

    Documents are dealt by ranges of the id and a hash of the text, so that many rows with one id (or
    none) do not meet in one task. A segment ends with the document that brings it to ``segment_ids``.
    """
    end = np.array([end_id], "<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder().encode
        part, seq = TaskContext.get().partitionId(), 0
        kept: list[bytes] = []
        names: list[int | None] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, held
            lengths = [len(x) // 4 for x in kept]
            payload = pack(np.frombuffer(b"".join(kept), "<u4"), names, np.cumsum([0, *lengths]))
            out = pa.record_batch([pa.array([v], t) for v, t in ((part, pa.int32()), (seq, pa.int32()), (len(names), pa.int64()), (sum(lengths), pa.int64()), (payload, pa.binary()))], ["part", "seq", "n_docs", "n_ids", "payload"])
            kept.clear()
            names.clear()
            seq, held = seq + 1, 0
            return out

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                few = batch.slice(i, 256)
                for name, ids in zip(few.column(0).to_pylist(), encode(strings(few.column(1)))):
                    kept.append(ids + end)
                    names.append(name)
                    held += len(ids) // 4 + 1
                    if held >= segment_ids:
                        yield close()
        if names:
            yield close()

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    rows = rows.repartitionByRange(F.col("_id").asc_nulls_first(), "_hash").sortWithinPartitions(F.col("_id").asc_nulls_first(), "_hash", "_text")
    rows.select("_id", "_text").mapInArrow(segments, SEGMENTS).write.option("compression", "uncompressed").parquet(path)


def documents(segments: DataFrame, columns: str, digest: Callable[[np.ndarray], list]) -> DataFrame:
    """One row per document of a dataset: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` and what ``digest`` makes of its ids (its ``columns`` as DDL)."""
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    # one row per task that wrote, whatever the number of documents
    before = sizes.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_part_start"))
    inside = segments.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("_seq_start"))
    names = [c.split()[0] for c in columns.split(",")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, seq, payload in zip(frame["part"], frame["seq"], frame["payload"]):
                segment = Segment(payload)
                starts = segment.starts.astype(np.int64)
                out = pd.DataFrame({"part": part, "seq": seq, "doc_id": pd.array(segment.docs, "Int64"), "_start": starts[:-1], "n_tokens": np.diff(starts)})
                made = [digest(segment.document(k)) for k in range(len(segment.docs))]
                for j, name in enumerate(names):
                    out[name] = [m[j] for m in made]
                yield out

    rows = segments.select("part", "seq", "payload").mapInPandas(read, f"part int, seq int, doc_id long, _start long, n_tokens long, {columns}")
    places = inside.join(before, "part").select("part", "seq", (F.col("_part_start") + F.col("_seq_start")).alias("_at"))
    return rows.join(places, ["part", "seq"]).select("doc_id", (F.col("_at") + F.col("_start")).alias("start"), "n_tokens", *names)
