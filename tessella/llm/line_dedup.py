"""Lines that are there already, exactly or within a few words.

A line is a sequence of words. Two lines are near when at most ``limit_of(n)`` words must be inserted, deleted
or replaced, ``n`` being the number of words of the shorter one: one word in ten, ``MOST_EDITS`` at most, so a
line of under ten words has exact copies only. The shorter line is cut into as many segments as edits and one
more; if the lines are near, one of the segments stands in the longer one unchanged, at a place that
the two lengths and the number of the segment confine. Every line therefore gives its own segments and, for every
shorter length within reach, the runs of words that can be a segment of such a line, each as one hash of
length, segment number and words. Hashes travel by their highest bits, many in a row. Lines that share a hash meet,
and a banded bit-parallel edit distance (one machine word for the band, many lines at a time; a few pairs are
followed along their diagonals instead) has the last word. A hash that many lines share is dealt into
parts, and each pair of parts is compared on its own. Lines that are linked already are not compared again, so many
near copies cost work in proportion to their number, and only a spanning forest of the links leaves the task.

Lines without a word are never touched. Of a class of lines the first one stays: by document id (null last), hash
of the text, line number.

Defined results: a null text has no lines and stays null; rows equal in id and text are the same document
and are treated alike; ties cannot occur then; an empty table gives an empty table. Other columns stay.
Lines are told apart by 128 bits of hash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from operator import ne

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import plain_name, strings, written
from tessella.llm.components import components
from tessella.llm.simhash import Forest

SHARE, MOST_EDITS = 10, 3  # one edit for so many words, and the most
CELLS = 1 << 18  # words of lines compared at a time
FEW = 64  # pairs that are compared one by one
PART_LINES = 1024  # lines of one hash that are compared together; of a hash with more, two parts at a time
LETTERS = 1 << 20  # letters of lines that are hashed at a time
HELD = 1 << 20  # hashes a task holds before it hands them on
BUCKET_BITS = 12  # hashes are dealt by so many of their bits
MET = 1 << 20  # lines a task remembers so as not to give them twice
BITS = 1 << 25  # of the filter in front of the join that fetches lines; a fixed size, 4 MB
SEED = 42
HAS_WORD = r"[^\x20\x09-\x0D]"


def limit_of(words: int, most: int = MOST_EDITS) -> int:
    """Edits between near lines of which the shorter has so many words."""
    return min(most, words // SHARE)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and length of the ``edits + 1`` segments of a line, as even as can be, longer ones last."""
    parts = edits + 1
    short, longer = divmod(length, parts)
    sizes = [short] * (parts - longer) + [short + 1] * longer
    starts = np.cumsum([0, *sizes[:-1]]).tolist()
    return list(zip(starts, sizes))


def probes(length: int, most: int = MOST_EDITS) -> tuple[list[tuple[int, int, int]], list[bool]]:
    """For a line of so many words: ``start, end, seed`` of every run of words to hash, and which are its own
    segments. The seed says the length of the line searched and the segment's number."""
    found, own = [], []
    for other in range(max(SHARE, length - most), length + 1):
        shift, edits = length - other, limit_of(other, most)
        if not edits or shift > edits:
            continue
        for i, (start, size) in enumerate(segments(other, edits)):
            low = max(start - i, start + shift - (edits - i), 0)
            high = min(start + i, start + shift + (edits - i), length - size)
            for at in range(low, high + 1):
                found.append((at, at + size, other * (MOST_EDITS + most + 1) + i))
                own.append(shift == 0 and at == start)
    return found, own


def _core(a: list[int], b: list[int], limit: int) -> tuple[list[int], list[int]]:
    """Two lines without what they begin and end with in common; a few equal words behind both, which
    change no distance, keep them longer than ``limit``."""
    lengths = []
    for cut in (lambda x, n: x[:n], lambda x, n: x[len(x) - n:]):
        low, high = 0, min(len(a), len(b)) - sum(lengths)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if cut(a, middle) == cut(b, middle) else (low, middle - 1)
        lengths.append(low)
    end = [0] * (limit + 1)
    return a[lengths[0]:len(a) - lengths[1]] + end, b[lengths[0]:len(b) - lengths[1]] + end


def within(pairs: list[tuple[list[int], list[int]]], most: int = MOST_EDITS) -> np.ndarray:
    """Whether the two lines of each pair, words as numbers above zero, are near; many pairs of about one
    length at a time."""
    near = np.zeros(len(pairs), bool)
    open_: dict[int, list[int]] = defaultdict(list)
    for k, (a, b) in enumerate(pairs):
        limit = limit_of(min(len(a), len(b)), most)
        if abs(len(a) - len(b)) > limit or not limit:
            continue
        if len(a) == len(b) and sum(map(ne, a, b)) <= limit:  # replaced words only
            near[k] = True
        elif len(set(a).difference(b)) <= limit and len(set(b).difference(a)) <= limit:  # an edit brings one new word at most
            open_[limit].append(k)
    for limit, places in open_.items():
        cores = {k: _core(*pairs[k], limit) for k in places}
        order = sorted(cores, key=lambda k: len(cores[k][1]))
        while order:
            few = order[-max(1, CELLS // (len(cores[order[-1]][1]) + 1)):]
            del order[-len(few):]
            near[few] = _banded([cores[k] for k in few], limit) if len(few) > FEW else [_reached(*cores[k], limit) for k in few]
    return near


def _reached(a: list[int], b: list[int], limit: int) -> bool:
    """The same for one pair: how far each diagonal comes with no edit, one, and so on. It looks at equal
    words only, where the walk over columns costs the same for one pair as for many."""
    m, n = len(a), len(b)
    rows: dict[int, int] = {}
    for edits in range(limit + 1):
        further = {}
        for d in range(-edits, edits + 1):
            # a word replaced, one of a left out, one of b left out
            i = max(rows.get(d, -2) + 1, rows.get(d + 1, -2) + 1, rows.get(d - 1, -2)) if edits else 0
            i = min(i, m, n - d)
            while i < m and i + d < n and a[i] == b[i + d]:
                i += 1
            further[d] = i
        rows = further
        if rows.get(n - m) == m:
            return True
    return False


def _banded(pairs: list[tuple[list[int], list[int]]], limit: int) -> np.ndarray:
    """One word holds the differences down a column, its highest bit the row ``limit`` below the diagonal;
    words are compared on the ``2 * limit + 1`` diagonals that matter only. The distance is followed
    along the lowest diagonal to the last row and along that row to the end; pairs that cannot come back
    below the limit are left, and the walk ends when no pair is."""
    m, n = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
    rows = np.zeros((len(pairs), int(m.max()) + 2 * limit + 1), np.int32) - 1
    columns = np.zeros((len(pairs), int(n.max())), np.int32) - 2
    for k, (a, b) in enumerate(pairs):
        rows[k, limit:limit + len(a)] = a
        columns[k, :len(b)] = b
    word = np.uint64
    one = word(1)
    near = np.zeros(len(pairs), bool)
    at = np.arange(len(pairs))
    plus = np.full(len(pairs), (1 << 64) - (1 << (63 - limit)), np.uint64)
    minus = np.zeros(len(pairs), np.uint64)
    distance = np.full(len(pairs), limit, np.int64)
    turn, worst = m - limit, 2 * limit + n - m
    for j in range(columns.shape[1]):
        letter = columns[at, j]
        equal = np.zeros(len(at), np.uint64)
        for d in range(2 * limit + 1):
            if j + d < rows.shape[1]:
                equal |= (letter == rows[at, j + d]).astype(np.uint64) << word(63 - 2 * limit + d)
        diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
        up = minus | ~(diagonal | plus)
        down = diagonal & plus
        bit = np.clip(62 - (j - turn), 0, 62).astype(np.uint64)
        along = (up >> bit & one).astype(np.int64) - (down >> bit & one).astype(np.int64)
        distance += np.where(j < turn, 1 - (diagonal >> word(63)).astype(np.int64), along)
        shifted = diagonal >> one
        plus = down | ~(shifted | up)
        minus = shifted & up
        done = n == j + 1
        near[at[done & (distance <= limit)]] = True
        left = ~done & (distance <= worst)
        if not left.all():
            if not left.any():
                break
            at, plus, minus, distance, turn, worst, n = (x[left] for x in (at, plus, minus, distance, turn, worst, n))
    return near


def _lines(text: str) -> list[bytes]:
    return [line for line in text.encode().split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]


def _runs(most: int):
    """Task that gives a hash for every run of words to look for, once for each line that the task meets (again
    for those it no longer remembers): ``bucket``, the highest bits of the hashes, and ``keys, ids, own``, the
    hashes, their lines and whether they are the lines' own segments, many of one bucket in a row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, met, hashes = xxhash.xxh64_intdigest, set(), _RunHashes(most)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        plain, lengths, ids = [], [], []
        size = letters = 0

        def hash_lines() -> None:
            nonlocal size, letters
            if ids:
                keys, counts, own = hashes.of(plain, lengths)
                held.append((keys, np.repeat(np.array(ids, np.uint64), counts), own))
                size += len(keys)
            letters = 0
            for kept in (plain, lengths, ids):
                kept.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                for text in strings(batch.column(0).slice(at, 250)):
                    for line in _lines(text):
                        words = line.split()
                        if len(words) < SHARE or (name := digest(line, SEED)) in met:
                            continue
                        if len(met) >= MET:
                            met.clear()
                        met.add(name)
                        plain.append(b" ".join(words))
                        lengths.append(len(words))
                        ids.append(name)
                        letters += len(line)
                        if letters >= LETTERS:
                            hash_lines()
                hash_lines()
                if size >= HELD:
                    yield _in_buckets(held)
                    held.clear()
                    size = 0
        if held:
            yield _in_buckets(held)

    return find


class _RunHashes:
    """Hashes of the runs of words of many lines at once: differences of sums over letters, each with its own
    power of an odd number, mixed with the seed. Runs that share a hash by chance are told apart when compared."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, most: int):
        self.most, self.plans = most, {}
        self.letters = np.array([xxhash.xxh64_intdigest(bytes([i]), SEED) for i in range(256)], np.uint64)
        self.powers = self.inverse = np.ones(1, np.uint64)

    def of(self, plain: list[bytes], lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of lines with one space between words, and their numbers of words: the hashes, how many each line
        has, and which are its own segments."""
        for n in set(lengths).difference(self.plans):
            found, own = probes(n, self.most)
            self.plans[n] = (*np.array(found, np.int64).T, np.array(own, bool))
        first, last, seeds, own = (np.concatenate(c) for c in zip(*map(self.plans.__getitem__, lengths)))
        counts = np.array([len(self.plans[n][3]) for n in lengths])
        words = np.repeat(np.cumsum([0, *lengths[:-1]]), counts)
        raw = np.frombuffer(b" ".join(plain) + b" ", np.uint8)
        if len(raw) >= len(self.powers):
            self.powers, self.inverse = (np.cumprod(np.append(np.uint64(1), np.full(len(raw), x, np.uint64))) for x in (self.BASE, pow(self.BASE, -1, 1 << 64)))
        starts = np.concatenate([[0], np.flatnonzero(raw == 32) + 1])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letters[raw] * self.powers[:len(raw)], dtype=np.uint64)])
        begin, end = starts[words + first], starts[words + last] - 1
        keys = (sums[end] - sums[begin]) * self.inverse[begin] + seeds.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            keys = (keys ^ (keys >> np.uint64(shift))) * np.uint64(factor)
        return keys ^ (keys >> np.uint64(33)), counts, own


def _in_buckets(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*held)]
    bucket = (columns[0] >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    stops = np.append(starts, len(bucket))
    packed = [pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((c.itemsize * stops).astype(np.int32)), pa.py_buffer(c[order])]) for c in columns]
    return pa.record_batch([pa.array(bucket[starts].astype(np.int32)), *packed], ["bucket", "keys", "ids", "own"])


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches sorted by their first column as tables of whole groups, of ``rows`` rows or more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        key = table.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield table.slice(0, last)
        held, size = table.slice(last).to_batches(), table.num_rows - last
    if held:
        yield pa.Table.from_batches(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket the hashes that are a segment of some line and stand in another.

    Their lines get a key made of all ids that share theirs, so lines that meet in several segments meet once.
    """
    for table in _whole_groups(batches, 1000):
        key, name, own = (np.frombuffer(b"".join(table.column(k).to_pylist()), kind) for k, kind in ((1, np.uint64), (2, np.uint64), (3, bool)))
        order = np.argsort(key)
        key = key[order]
        same = np.concatenate([[False], key[1:] == key[:-1], [False]])
        twin = same[1:] | same[:-1]  # most hashes stand in one line only
        if not twin.any():
            continue
        key, name, own = key[twin], name[order[twin]], own[order[twin]]
        order = np.lexsort((name, key))
        key, name, own = key[order], name[order], own[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])
        live = (np.add.reduceat(new.astype(np.int64), starts) > 1) & np.logical_or.reduceat(own, starts)
        keep = new & np.repeat(live, np.diff(np.append(starts, len(key))))
        if keep.any():
            mixed = name * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            everyone = np.add.reduceat(np.where(new, mixed, np.uint64(0)), starts)
            together = np.repeat(everyone, np.diff(np.append(starts, len(key)))).view(np.int64)
            yield pa.record_batch([pa.array(together[keep]), pa.array(name[keep].view(np.int64))], ["key", "id"])


def _forests(most: int):
    """Task that gives a spanning forest ``a, b`` of the near lines of each key, from rows sorted by key."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 2000):
            key, name = table.column(0).to_numpy(), table.column(1).to_numpy()
            number: dict[bytes, int] = defaultdict(count(1).__next__)
            lines = [list(map(number.__getitem__, line.split())) for line in table.column(2).to_pylist()]
            reach = [limit_of(len(x), most) for x in lines]
            forest, found = Forest(len(key)), []
            # one line of each group at a time against those of the group that it is not yet linked to
            open_ = [(a, b) for a, b in zip(*_bounds(key))]
            while open_:
                root = forest.roots().tolist()
                ahead, pairs = [], []
                for first, stop in open_:
                    n, r = len(lines[first]), reach[first]
                    pairs += [(first, j) for j in range(first + 1, stop) if root[j] != root[first] and abs(len(lines[j]) - n) <= min(r, reach[j])]
                    if stop - first > 2:
                        ahead.append((first + 1, stop))
                for i in range(0, len(pairs), 4096):
                    part = np.array(pairs[i:i + 4096])
                    near = part[within([(lines[x], lines[y]) for x, y in part.tolist()], most)]
                    a, b = forest.add(near[:, 0], near[:, 1])
                    found.append(np.column_stack([name[a], name[b]]))
                open_ = ahead
            links = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            yield pa.record_batch([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return verify


def _bounds(key: np.ndarray) -> tuple[list[int], list[int]]:
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return starts.tolist(), np.append(starts[1:], len(key)).tolist()


def near_lines(docs: DataFrame, text: str = "text", most: int = MOST_EDITS) -> DataFrame:
    """``node, label``: hashes of the lines that are near another one, with the smallest hash of the class."""
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("_text"))
    keys = texts.mapInArrow(_runs(most), "bucket int, keys binary, ids binary, own binary")
    live = keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "key long, id long")
    live = written(live.distinct(), "shared-segments")
    asked = written(live.select("id").distinct(), "lines-asked")
    lines = texts.mapInArrow(_named_lines(_filter_of(asked)), "id long, line binary")
    known = written(lines.join(asked, "id", "left_semi").groupBy("id").agg(F.min("line").alias("line")), "lines")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # comparing costs more than its bytes suggest
    met = in_parts(live).join(known, "id").select("key", "id", "line").repartition(parts, "key").sortWithinPartitions("key", "id")
    return components(written(met.mapInArrow(_forests(most), "a long, b long"), "near-lines"))


def in_parts(live: DataFrame, part_lines: int | None = None) -> DataFrame:
    """``key, id`` with the keys of many ids dealt into parts; each pair of parts is a key of its own."""
    part_lines = part_lines or PART_LINES
    hot = live.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > part_lines)
    hot = written(hot.select("key", F.ceil(F.col("n") / part_lines).cast("int").alias("parts")), "hot-segments")
    dealt = live.join(hot, "key", "left").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    dealt = dealt.select("key", "id", "own", "parts", other.alias("other"))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(F.when(F.col("parts").isNull(), F.col("key")).otherwise(pair).alias("key"), "id")


def _filter_of(asked: DataFrame):
    """A bitmap of fixed size of the ids asked for, broadcast. It only spares most other lines the way to
    the join; the fuller it is, the less it spares."""
    spot = asked.select((F.pmod("id", F.lit(BITS)) + 1).alias("p"))
    rows = spot.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    bitmap = np.zeros((BITS // 32768, 4096), np.uint8)
    for r in rows:
        bitmap[r["b"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return asked.sparkSession.sparkContext.broadcast(bitmap.reshape(-1))


def _named_lines(wanted):
    """Task that gives ``id, line`` for the lines that may be asked for, once for each line it meets."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, bitmap, met = xxhash.xxh64_intdigest, wanted.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                lines = [line for text in strings(batch.column(0).slice(at, 2000)) for line in _lines(text)]
                names = np.fromiter((digest(line, SEED) for line in lines), np.uint64, len(lines))
                spots = names % np.uint64(BITS)
                hits = np.flatnonzero(bitmap[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8) & 1)
                new = []
                for k in hits:
                    if names[k] not in met:
                        if len(met) >= MET:
                            met.clear()
                        met.add(names[k])
                        new.append(k)
                yield pa.record_batch([pa.array(names[new].view(np.int64)), pa.array([lines[k] for k in new], pa.binary())], ["id", "line"])

    return find


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each line with a word: ``doc_id, text_hash, line_no`` and the line's hashes ``h1, h2``."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    rows = rows.select("doc_id", F.xxhash64("_text").alias("text_hash"), F.posexplode(F.split("_text", "\n")).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(HAS_WORD)).select("doc_id", "text_hash", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST_EDITS) -> DataFrame:
    """The lines that go, once for all rows equal in id and text: ``doc_id, text_hash, line_no``, ``exact``
    (equal to the line that stays), ``first_doc`` and ``first_line`` (where that one is)."""
    every = written(occurrences(docs, doc_id, text), "occurrences")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "line_no", "h2")
    lines = written(every.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.count("*").alias("n")), "distinct-lines")
    labels = near_lines(docs, text, most).select(F.col("node").alias("h1"), "label")
    classed = lines.join(labels, "h1", "left").withColumns({"c1": F.coalesce("label", "h1"), "c2": F.when(F.col("label").isNull(), F.col("h2"))})
    firsts = written(classed.groupBy("c1", "c2").agg(F.min("place").alias("first"), F.sum("n").alias("total")).where("total > 1"), "classes")
    first_of = classed.join(firsts, classed["c1"].eqNullSafe(firsts["c1"]) & classed["c2"].eqNullSafe(firsts["c2"]))
    first_of = written(first_of.select("h1", "h2", "first"), "line-classes")
    gone = every.join(first_of, ["h1", "h2"]).where(
        ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")) & (F.col("line_no") == F.col("first.line_no")))
    )
    return gone.select(
        "doc_id", "text_hash", "line_no", (F.col("h2") == F.col("first.h2")).alias("exact"),
        F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"),
    ).distinct()


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST_EDITS) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``n_lines`` (with a word, before),
    ``n_exact`` and ``n_near`` (lines that went) and ``first_docs`` (ids of the documents that keep them)."""
    g = {c: plain_name(docs, f"_{c}") for c in ("id", "hash", "gone", "exact", "near", "firsts", "row_id", "row_hash", "lines")}
    gone = repeated(docs, doc_id, text, most).groupBy(F.col("doc_id").alias(g["id"]), F.col("text_hash").alias(g["hash"])).agg(
        F.collect_list("line_no").alias(g["gone"]), F.count_if("exact").alias(g["exact"]), F.count_if(~F.col("exact")).alias(g["near"]),
        F.sort_array(F.collect_set("first_doc")).alias(g["firsts"]),
    )
    gone = written(gone, "lines-gone")
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_exact", "n_near", "first_docs")]
    string = F.col(f"`{text}`").cast("string")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{doc_id}`").cast("long").alias(g["row_id"]), F.xxhash64(string).alias(g["row_hash"]))
    rows = rows.join(gone, rows[g["row_id"]].eqNullSafe(gone[g["id"]]) & (rows[g["row_hash"]] == gone[g["hash"]]), "left")
    rows = rows.withColumn(g["lines"], F.coalesce(F.split(string, "\n"), F.array().cast("array<string>")))
    left = F.array_except(F.sequence(F.lit(0), F.size(g["lines"]) - 1), F.col(g["gone"]))
    new = F.when(F.col(g["gone"]).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(g["lines"]), i)), "\n"))
    return rows.select(
        *[new.alias(c) if c == text else F.col(f"`{c}`") for c in keep],
        F.size(F.filter(g["lines"], lambda x: x.rlike(HAS_WORD))).cast("long").alias("n_lines"),
        F.coalesce(g["exact"], F.lit(0)).cast("long").alias("n_exact"), F.coalesce(g["near"], F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(g["firsts"], F.array().cast("array<long>")).alias("first_docs"),
    )
