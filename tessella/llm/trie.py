"""The prefix trie of conversations, with its shared part grouped exactly and the rest emitted on the spot.

A prefix is known by a digest that grows turn by turn: the exclusive or of 128-bit hashes of each turn and
its place. Tasks count the digests in a count-min sketch whose cells end at two, so that sketches merge
to few megabytes whatever the number of turns. Where the smallest of a digest's cells is one, one
conversation alone has the prefix; its node is made where the row lies. Only prefixes that may be shared are
shuffled and grouped. A full sketch proves less and more is grouped, with the same result.

What a node sums over its subtree comes from its members: every node is counted at its smallest member, at
its depth, so a sum over a subtree is a sum over members of what they have at this depth and below. Sums
along a conversation go through blocks of turns, level by level, so a long conversation is no group. Members
that end at one node are sorted by ranges, joined to pieces of text, and a stream of pieces is digested.

Defined results: a conversation without turns is a member of the root only; null roles and texts are empty;
turns are ordered by ``turn`` (null first), then role and text, and repeated rows are turns of their own;
rows without a conversation id are left out; without any conversation there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WORD, written
from tessella.operators.scan import numbered

BLOCK = 1024  # turns of a conversation that one window sees
HASHES = 3
CHUNK = 1 << 16  # cells of the sketch in one row while sketches are merged
MOST_CELLS = 1 << 24  # of each hash: the merged sketch has 2 bits a cell, 12 MB at most
ENDS = 512  # ids in one piece of text
KEY = ["depth", "x1", "x2"]
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, pos`` (from 0), two hashes of role and text, and the number of words of every turn."""
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    rows = conversations.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), *said).where("conv_id IS NOT NULL")
    hashes = [F.xxhash64(F.lit(k), "role", F.length("role"), "text").alias(f"h{k}") for k in (1, 2)]
    rows = rows.select("conv_id", "turn", *hashes, F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    placed = numbered(rows, ["conv_id"], ["turn", "h1", "h2"], "pos", lambda df: written(df, "turns"))
    return written(placed.select("conv_id", "pos", "h1", "h2", "words"), "placed")


def _along(rows: DataFrame, totals: dict[str, tuple[str, str]], order: str, backwards: bool) -> DataFrame:
    """Add running aggregates along each conversation: ``totals`` maps a new column to an SQL aggregate and the
    column it takes, over all rows of the conversation up to this one (from the end, if ``backwards``).

    Windows see one block of ``BLOCK`` places; what the blocks before amount to is found by the same
    function on the blocks, as often as the longest conversation needs.
    """
    block = f"{order}_block"
    rows = rows.withColumn(block, F.expr(f"{order} div {BLOCK}"))
    window = Window.partitionBy("conv_id", block).orderBy(F.col(order).desc() if backwards else F.col(order).asc())
    inner = rows.withColumns({new: F.expr(f"{how}({c})").over(window.rowsBetween(Window.unboundedPreceding, 0)) for new, (how, c) in totals.items()})
    if rows.agg(F.max(block)).first()[0] in (None, 0):
        return inner.drop(block)
    each = rows.groupBy("conv_id", block).agg(*[F.expr(f"{how}({c})").alias(new) for new, (how, c) in totals.items()])
    long = each.where(F.col(block) > 0).select("conv_id").distinct()
    sums = _along(written(each.join(long, "conv_id", "left_semi"), "blocks"), {f"_{new}": (how, new) for new, (how, _) in totals.items()}, block, backwards)
    # what the blocks up to this one amount to, for the next one
    ahead = sums.select(F.col("conv_id").alias("_c"), (F.col(block) + F.lit(-1 if backwards else 1)).alias("_b"), *[f"_{new}" for new in totals])
    joined = inner.join(ahead, (F.col("conv_id") == F.col("_c")) & (F.col(block) == F.col("_b")), "left")
    both = {new: F.coalesce({"bit_xor": F.col(new).bitwiseXOR(F.col(f"_{new}")), "sum": F.col(new) + F.col(f"_{new}")}[how], F.col(new)) for new, (how, _) in totals.items()}
    return joined.withColumns(both).drop(block, "_c", "_b", *[f"_{new}" for new in totals])


def _cells(digests: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each digest for each hash."""
    factors = np.random.default_rng(5).integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = digests.view(np.uint64) * factors[:, None]
    return ((mixed ^ (mixed >> np.uint64(29))) * factors[::-1, None] >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)


def sketch(rows: DataFrame, column: str, cells: int) -> np.ndarray:
    """Count-min sketch of ``column``: for each hash which cells were met twice or more (one bit each).

    A cell counts none, one, or more, which merges like any count-min sketch. ``cells`` is a power of two.
    """
    chunk, schema = min(CHUNK, cells), "chunk int, once binary, more binary"

    def emit(once: np.ndarray, more: np.ndarray, chunks) -> pa.RecordBatch:
        bits = [[np.packbits(x.reshape(-1, chunk)[k]).tobytes() for k in chunks] for x in (once, more)]
        return pa.record_batch([pa.array(chunks, pa.int32()), *[pa.array(b, pa.binary()) for b in bits]], ["chunk", "once", "more"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more = np.zeros(HASHES * cells, bool), np.zeros(HASHES * cells, bool)
        for batch in batches:
            for k, at in enumerate(_cells(batch.column(0).to_numpy(), cells)):
                at, times = np.unique(at + k * cells, return_counts=True)
                more[at] |= once[at] | (times > 1)
                once[at] = True
        yield emit(once, more, np.flatnonzero(once.reshape(-1, chunk).any(1)).tolist())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, once, more in zip(*(c.to_pylist() for c in batch.columns)):
                once, more = np.frombuffer(once, np.uint8), np.frombuffer(more, np.uint8)
                if k in held:
                    held[k] = [held[k][0] | once, held[k][1] | more | held[k][0] & once]
                else:
                    held[k] = [once, more]
        rows = sorted(held)
        yield pa.record_batch([pa.array(rows, pa.int32()), *[pa.array([held[k][j].tobytes() for k in rows], pa.binary()) for j in (0, 1)]], ["chunk", "once", "more"])

    merged = rows.select(column).mapInArrow(count, schema).repartition("chunk").mapInArrow(merge, schema)
    bits = np.zeros((HASHES * cells // chunk, -(-chunk // 8)), np.uint8)
    for r in merged.select("chunk", "more").collect():  # HASHES * cells bits
        bits[r["chunk"]] = np.frombuffer(r["more"], np.uint8)
    return bits.reshape(HASHES, -1)


def screened(rows: DataFrame, cells: int | None = None) -> DataFrame:
    """Add ``alone``: the sketch proves that one conversation has the prefix, and ``parent_alone``: it
    proves it for the prefix without the last turn."""
    if cells is None:
        cells = min(MOST_CELLS, max(1 << 12, 1 << (4 * rows.count()).bit_length()))
    shared = rows.sparkSession.sparkContext.broadcast(sketch(rows, "x1", cells))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            x, k = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("x1", "k1"))
            one = [np.zeros(len(x), bool), np.zeros(len(x), bool)]
            for flags, digests in zip(one, (x, x ^ k)):
                for row, at in zip(bits, _cells(digests, cells)):
                    flags |= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1) == 0
            parent = one[1] & (batch.column(batch.schema.get_field_index("depth")).to_numpy() > 1)
            yield pa.record_batch([*batch.columns, pa.array(one[0] | parent), pa.array(parent)], [*batch.schema.names, "alone", "parent_alone"])

    names = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(look, f"{names}, alone boolean, parent_alone boolean")


def digests(ends: DataFrame) -> DataFrame:
    """``depth, x1, x2, ends_sha256``: the digest of the ascending, comma-joined ids ``conv_id`` of each key.

    Ids are sorted by ranges and joined to pieces in each range; a key's pieces pass through one
    task as a stream, one row for up to ``ENDS`` ids.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, nth = None, [], 0

        def piece() -> pa.RecordBatch:
            return pa.record_batch([[v] for v in (*key, nth, ",".join(map(str, held)))], names=[*KEY, "nth", "ids"])

        for batch in batches:
            for *new, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (new != key or len(held) == ENDS):
                    yield piece()
                    nth, held = nth + 1, []
                key = new
                held.append(conv)
        if held:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for *new, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if new == key:
                    state.update(b",")
                else:
                    if state:
                        out.append((*key, state.hexdigest()))
                    key, state = new, hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.record_batch([list(c) for c in zip(*out)], names=[*KEY, "ends_sha256"])
        if state:
            yield pa.record_batch([[v] for v in (*key, state.hexdigest())], names=[*KEY, "ends_sha256"])

    by = [*KEY, "conv_id"]
    pieces = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(join, "depth long, x1 long, x2 long, nth long, ids string")
    # a range's pieces are ordered by its first id, which grows from range to range
    pieces = pieces.withColumn("first", F.substring_index("ids", ",", 1).cast("long"))
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ids").mapInArrow(digest, "depth long, x1 long, x2 long, ends_sha256 string")


def nodes(placed: DataFrame, convs: DataFrame, cells: int | None = None) -> DataFrame:
    """One row for each distinct prefix of the conversations ``convs`` (``conv_id, n_turns``, one row each),
    whose turns are ``placed`` (``conv_id, pos`` from 0 without gaps, ``h1, h2, words``).

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens`` and
    ``ends_sha256``. ``cells`` of the sketch follow the number of turns if not given.
    """
    spark = placed.sparkSession
    # hashes that tell the place of a turn too, and what they amount to so far
    parts = placed.join(convs.where("n_turns > 0"), "conv_id")  # a long conversation is a skewed join; the table cuts it off
    parts = parts.select("conv_id", (F.col("pos") + 1).alias("depth"), *[F.xxhash64(F.lit(k), "pos", "h1", "h2").alias(f"k{k}") for k in (1, 2)], "words", (F.col("pos") + 1 == F.col("n_turns")).alias("last"))
    grown = _along(written(parts, "parts"), {"x1": ("bit_xor", "k1"), "x2": ("bit_xor", "k2")}, "depth", False)
    rows = written(screened(written(grown.select("conv_id", *KEY, "k1", "k2", "words", "last"), "prefixes"), cells), "screened")
    above = [(F.col("depth") - 1).alias("depth"), F.col("x1").bitwiseXOR(F.col("k1")).alias("x1"), F.col("x2").bitwiseXOR(F.col("k2")).alias("x2")]

    # from the first prefix that is proven on, a conversation is alone, whatever the sketch says further on
    tops = rows.where("alone AND NOT parent_alone").groupBy("conv_id").agg(F.min(F.struct(*KEY, "k1", "k2")).alias("top"))
    tops = written(tops.select("conv_id", "top.*"), "tops")
    doubtful = rows.where("NOT alone").join(tops.select("conv_id", F.col("depth").alias("from")), "conv_id", "left")
    doubtful = written(doubtful.withColumn("behind", F.coalesce(F.col("depth") >= F.col("from"), F.lit(False))), "doubtful")
    # prefixes that may be shared, exactly
    some = doubtful.where("NOT behind")
    grouped = written(some.groupBy(*KEY).agg(
        F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("words").alias("words"),
        F.count_if("last").alias("n_ends"), F.min(F.when(F.col("last"), F.col("conv_id"))).alias("first_end"),
    ), "grouped")
    children = grouped.select(*above).unionByName(tops.select(*above)).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    children = written(children, "children")
    shared = written(grouped.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "shared")

    # every member with the node it passes; a node counts at its smallest member
    facts = shared.select(*KEY, "rep", "n_ends", "n_children", ((F.col("n") - 1) * F.col("words")).alias("worth"))
    passed = some.join(facts, KEY)
    own = F.col("conv_id") == F.col("rep")
    passed = written(passed.select(
        "conv_id", *KEY, "rep", "last", "n_ends", F.when(own, F.col("worth")).otherwise(0).alias("worth"),
        (own & F.col("last") & (F.col("n_children") == 0)).cast("long").alias("leaf"),
    ), "passed")
    single = tops.select("conv_id", "depth", F.lit(0).cast("long").alias("worth"), F.lit(1).cast("long").alias("leaf"))
    events = passed.select("conv_id", *KEY, "worth", "leaf").unionByName(single, allowMissingColumns=True)
    below = _along(written(events, "events"), {"saved": ("sum", "worth"), "leaves": ("sum", "leaf")}, "depth", True)
    sums = written(below.where("x1 IS NOT NULL").groupBy(*KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")), "sums")

    convs = convs.select("conv_id", "n_turns")
    first, n_convs, n_empty = convs.agg(F.min("conv_id"), F.count("*"), F.count_if(F.col("n_turns") == 0)).first()
    if not n_convs:
        return _shown(rows.select(F.lit(None).cast("long").alias("parent_conv_id"), "*").where("false"), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit(NOTHING))
    tails = rows.where("alone").select("conv_id", "depth", "last", "parent_alone").unionByName(doubtful.where("behind").select("conv_id", "depth", "last", F.lit(True).alias("parent_alone")))
    # the textless root, whose sums are those of all nodes
    many = passed.where("last AND n_ends > 1").select(*KEY, "conv_id")
    empty = convs.where("n_turns = 0").select(*[F.lit(0).cast("long").alias(c) for c in KEY], "conv_id")
    ended = written(digests(many.unionByName(empty)), "ends")
    grand = events.agg(F.coalesce(F.sum("worth"), F.lit(0)), F.coalesce(F.sum("leaf"), F.lit(0))).first()
    level = children.where("depth = 0").agg(F.coalesce(F.sum("n_children"), F.lit(0))).first()[0]
    at_root = [r["ends_sha256"] for r in ended.where("depth = 0").collect()] if n_empty else [NOTHING]
    root = spark.createDataFrame(
        [(first, 0, None, n_convs, level, grand[1] if level else 1, grand[0], at_root[0])],
        "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string",
    )
    # a node's parent is the node its smallest member passes one turn before
    parents = passed.select(F.col("conv_id").alias("_c"), (F.col("depth") + 1).alias("_d"), F.col("rep").alias("_parent"))
    parent = F.when(F.col("depth") == 1, F.lit(first)).otherwise(F.coalesce("_parent", "conv_id")).alias("parent_conv_id")
    met = lambda df: df.join(parents, (df["conv_id"] == F.col("_c")) & (df["depth"] == F.col("_d")), "left").select("*", parent)
    full = shared.join(sums, KEY).join(ended, KEY, "left").withColumn("conv_id", F.col("rep"))
    one_end = F.when(F.col("n_ends") == 1, F.sha2(F.col("first_end").cast("string").cast("binary"), 256))
    grouped_nodes = _shown(met(full), F.col("n"), F.col("n_children"), F.col("n_leaves"), F.col("saved_tokens"), F.coalesce("ends_sha256", one_end, F.lit(NOTHING)))
    here = F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING))
    child = F.when(F.col("last"), 0).otherwise(1)
    tail = lambda df: _shown(df, F.lit(1), child, F.lit(1), F.lit(0), here)
    inner = tail(tails.where("parent_alone").withColumn("parent_conv_id", F.col("conv_id")))
    return root.unionByName(grouped_nodes).unionByName(inner).unionByName(tail(met(tails.where("NOT parent_alone"))))


def _shown(df: DataFrame, n_convs: Column, n_children: Column, n_leaves: Column, saved: Column, ends: Column) -> DataFrame:
    long = {"n_convs": n_convs, "n_children": n_children, "n_leaves": n_leaves, "saved_tokens": saved}
    return df.select("conv_id", "depth", "parent_conv_id", *[c.cast("long").alias(n) for n, c in long.items()], ends.alias("ends_sha256"))
