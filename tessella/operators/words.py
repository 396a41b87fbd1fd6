"""Text cleaning, n-grams and TF-IDF words per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessella.functions.sizing import attach, small_table, spread_out
from tessella.session import cut

# Fixed value: what the normaliser removes from a token.
CLEANUP_PATTERN = r"[^\w\s]|http\S+|\d+|[A-Z][a-z]+"
BLOCK = 4096
MASK_CELLS = 1 << 24
CHUNK_BYTES = 6 << 20  # bytes of text whose n-grams are counted at once; the end of a chunk is the end of a text


def sentences(text: str | Column) -> Column:
    """Array of sentences: a cut after ``. ! ?`` followed by white space."""
    text = F.col(text) if isinstance(text, str) else text
    return F.split(text, r"(?<=[.!?])\s+")


def clean_tokens(text: str | Column, stop_words: Sequence[str] | None = None, pattern: str = CLEANUP_PATTERN, stem: Callable[[Column], Column] | None = None) -> Column:
    """Normalised, lower-case words without stop words; ``stem`` may map the array of words."""
    text = F.col(text) if isinstance(text, str) else text
    words = stop_words if stop_words is not None else StopWordsRemover.loadDefaultStopWords("italian")
    tokens = F.transform(F.split(text, r"\s+"), lambda t: F.lower(F.regexp_replace(t, pattern, "")))
    kept = F.filter(tokens, lambda t: (t != "") & ~t.isin(*words)) if words else F.filter(tokens, lambda t: t != "")
    return stem(kept) if stem else kept


def suffix_stem(suffixes: Sequence[str], least: int = 3) -> Callable[[Column], Column]:
    """A simple ``stem`` for ``clean_tokens``: cut the longest listed ending that leaves ``least`` letters."""
    endings = "|".join(sorted(suffixes, key=len, reverse=True))
    pattern = rf"^(.{{{least},}}?)(?:{endings})$"
    return lambda tokens: F.transform(tokens, lambda t: F.regexp_replace(t, pattern, "$1"))


def clean_text(df: DataFrame, text: str, name: str = "clean", **options) -> DataFrame:
    """The cleaned words put together again with blanks."""
    return spread_out(df).withColumn(name, F.array_join(clean_tokens(text, **options), " "))


def clean_sentences(df: DataFrame, text: str, keep: Sequence[str], name: str = "sentence", **options) -> DataFrame:
    """One row per sentence, cleaned, with its number in the text."""
    split = spread_out(df.select(*keep, text)).select(*keep, F.posexplode(sentences(text)).alias("sentence_no", "_s"))
    return split.select(*keep, "sentence_no", F.array_join(clean_tokens("_s", **options), " ").alias(name))


def words_of(text: str | Column) -> Column:
    """Lower-case words, cut at every white-space character."""
    text = F.col(text) if isinstance(text, str) else text
    return F.split(F.lower(text), r"\s")


def grams_of(words: Column, n: int) -> Column:
    """All runs of ``n`` words inside one array, each an array."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(words, i, n))


def ngrams_of(words: Column, n: int) -> Column:
    """All runs of ``n`` words inside one array, joined by blanks."""
    return F.transform(grams_of(words, n), lambda g: F.array_join(g, " "))


def _word_offsets(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add ``_at``, the position of the first word of each text in its group read in order (null first).

    Two-step running sum: rows are dealt by ranges of the whole order key, of any type, as many as Spark
    makes for their size; totals per range are added up, and only rows of one range meet in one window.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = placed.groupBy(group, "_range").agg(F.sum("_size").alias("_total"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = totals.select(group, "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    starts, fits = small_table(starts)
    inner = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = attach(placed, starts, [group, "_range"], fits)
    return counted.withColumn("_at", F.col("_start") + F.coalesce(F.sum("_size").over(inner), F.lit(0))).drop("_range", "_start")


def _lower_rows(df: DataFrame, group: str, order: Sequence[str], text: str) -> DataFrame:
    rows = spread_out(df.select(group, *order, text).where(F.col(text).isNotNull() & F.col(group).isNotNull()))
    return rows.select(group, *order, F.lower(text).alias("_t"))


def _word_lists(texts: pa.Array) -> pa.Array:
    """``words_of`` lower-cased texts."""
    return pc.split_pattern_regex(texts, r"[ \t\n\x0b\f\r]")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``CHUNK_BYTES`` bytes of text, the last column, in each part."""
    sizes = pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // CHUNK_BYTES
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for at, end in zip(starts, [*starts[1:], len(part)]):
        yield batch.slice(at, end - at)


def _edges(rows: DataFrame, group: str, order: Sequence[str], edge: int) -> DataFrame:
    """``_size``, the number of words of each text, and its first and last ``edge`` words."""
    columns = [group, *order]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                lists = _word_lists(part.column(len(columns)))
                sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
                ends, few = np.cumsum(sizes), np.minimum(sizes, edge)
                offsets = np.concatenate([[0], np.cumsum(few)])
                inner = np.arange(offsets[-1]) - np.repeat(offsets[:-1], few)
                sides = [
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat.take(pa.array(np.repeat(at, few) + inner)))
                    for at in (ends - sizes, ends - few)
                ]
                yield pa.record_batch([*part.columns[:-1], pa.array(sizes), *sides], [*columns, "_size", "_head", "_tail"])

    words = T.ArrayType(T.StringType())
    new = [T.StructField("_size", T.LongType()), T.StructField("_head", words), T.StructField("_tail", words)]
    return rows.mapInArrow(edges, T.StructType([*[rows.schema[c] for c in columns], *new]))


def _crossing(rows: DataFrame, group: str, order: Sequence[str], n: int) -> DataFrame:
    """``group, _g``: the n-grams that begin in one text of a group and end in a later one, as arrays.

    Only the first and last ``n - 1`` words of each text move, in blocks of consecutive positions.
    """
    edge = n - 1
    placed = _word_offsets(cut(_edges(rows, group, order, edge)), group, order)  # a few words per text, sampled and then dealt
    head = F.transform("_head", lambda w, i: F.struct((F.col("_at") + i).alias("at"), w.alias("w"), F.col("_at").alias("of")))
    tail_at = F.col("_at") + F.greatest(F.col("_size") - edge, F.lit(0))
    tail = F.transform("_tail", lambda w, i: F.struct((tail_at + i).alias("at"), w.alias("w"), F.col("_at").alias("of")))
    words = placed.select(group, F.explode(F.array_distinct(F.concat(head, tail))).alias("_x")).select(group, "_x.*")
    block = F.floor(F.col("at") / BLOCK)
    # the first words of a block are also needed at the end of the block before
    copies = F.when((F.col("at") % BLOCK < edge) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    words = words.select(group, "at", "w", "of", block.alias("home"), F.explode(copies).alias("block"))
    run = Window.partitionBy(group, "block").orderBy("at").rowsBetween(0, edge)
    runs = words.select(
        group, "at", "of", "home", "block",
        F.collect_list("w").over(run).alias("_g"), F.max("at").over(run).alias("_end"), F.max("of").over(run).alias("_last"),
    )
    crossing = runs.where((F.col("home") == F.col("block")) & (F.col("_end") == F.col("at") + edge) & (F.col("_last") > F.col("of")))
    return crossing.where(F.size("_g") == n).select(group, "_g")


def _gram_hashes(words: pa.Array, codes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` words from each start, from hashes of the distinct words."""
    of = pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False)
    total = np.zeros(len(starts), np.uint64)
    for k in range(n):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + of[codes[starts + k]]
    return total.view(np.int64)


def _chunk_grams(chunk: pa.RecordBatch, n: int) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray] | None:
    """Distinct n-grams of a chunk: their groups, the words, their codes, where each n-gram starts, how often it is there."""
    groups, lists = chunk.column(0), _word_lists(chunk.column(1))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = lists.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.flatnonzero(np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes)) >= n)
    if not len(starts):
        return None
    kinds = groups.dictionary_encode()
    key = np.repeat(kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)[starts]
    most, base = len(kinds.dictionary), len(encoded.dictionary)
    for k in range(n):
        if most * base >= 1 << 62:  # numbers stay exact: names are dealt anew before they overflow
            key, names = pd.factorize(key)
            most = len(names)
        key, most = key * base + codes[starts + k], most * base
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    rows = np.repeat(np.arange(len(sizes)), sizes)[starts[first]]
    return groups.take(pa.array(rows)), encoded.dictionary, codes, starts[first], times


def _counted(texts: DataFrame, group: str, n: int, mask: np.ndarray | None = None) -> DataFrame:
    """``group, ngram, tf`` of the n-grams inside the lower-cased texts of ``group, _t``.

    Each chunk of texts counts its n-grams as numbers; strings are made of distinct ones only. ``mask``
    leaves those whose hash cell has its bit.
    """
    shared = None if mask is None else texts.sparkSession.sparkContext.broadcast(mask)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _parts(batch):
                found = _chunk_grams(chunk, n)
                if found is None:
                    continue
                of, words, codes, starts, times = found
                if shared is not None:
                    cell = _gram_hashes(words, codes, starts, n) & (len(shared.value) * 64 - 1)
                    kept = np.flatnonzero((shared.value[cell >> 6] >> (cell & 63)) & 1)
                    of, starts, times = of.take(pa.array(kept)), starts[kept], times[kept]
                grams = pc.binary_join_element_wise(*[words.take(pa.array(codes[starts + k])) for k in range(n)], " ")
                yield pa.record_batch([of, grams, pa.array(times.astype(np.int64))], [group, "ngram", "n"])

    kind = T.StructType([texts.schema[group], T.StructField("ngram", T.StringType()), T.StructField("n", T.LongType())])
    counted = texts.select(group, "_t").mapInArrow(count, kind)
    # the null test is what the joins on the n-gram add; stated here, all uses share one shuffle
    return counted.where(F.col("ngram").isNotNull()).groupBy(group, "ngram").agg(F.sum("n").alias("tf"))


def _hashed(texts: DataFrame, group: str, n: int) -> DataFrame:
    """``_h, df, total``: in how many groups and how often each hash of an n-gram is there, in one shuffle by the hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _parts(batch):
                found = _chunk_grams(chunk, n)
                if found is not None:
                    of, words, codes, starts, times = found
                    yield pa.record_batch([pa.array(_gram_hashes(words, codes, starts, n)), of, pa.array(times.astype(np.int64))], ["_h", group, "n"])

    kind = T.StructType([T.StructField("_h", T.LongType()), texts.schema[group], T.StructField("n", T.LongType())])
    counted = texts.select(group, "_t").mapInArrow(count, kind).repartition("_h")
    return counted.groupBy("_h", group).agg(F.sum("n").alias("n")).groupBy("_h").agg(F.count("*").alias("df"), F.sum("n").alias("total"))


def _texts(df: DataFrame, group: str, order: Sequence[str], text: str, n: int) -> DataFrame:
    """``group, _t``: the lower-cased texts, and each n-gram that crosses texts as a text of its own."""
    rows = _lower_rows(df, group, order, text)
    inside = rows.select(group, "_t")
    return inside.unionByName(cut(_crossing(rows, group, order, n)).select(group, F.array_join("_g", " ").alias("_t"))) if n > 1 else inside


def group_ngrams(df: DataFrame, group: str, order: Sequence[str], text: str, n: int) -> DataFrame:
    """``group, ngram, tf``: n-grams of all texts of a group read one after the other.

    Equal to joining the texts of a group with blanks, but no group is ever put in one place:
    n-grams inside a text are counted where the text lies, those that cross texts come from its edges.
    """
    return _counted(_texts(df, group, order, text, n), group, n)


def _mask(hashes: DataFrame, cells: int) -> np.ndarray:
    """The cells of the given hashes as bits of ``cells / 64`` numbers."""
    cell = F.col("_h").bitwiseAND(F.lit(cells - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64).cast("int"))
    packed = hashes.groupBy(F.shiftright(cell, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # cells / 64 rows at most
    mask = np.zeros(cells // 64, np.int64)
    mask[packed["at"].to_numpy()] = packed["bits"].to_numpy()
    return mask


def frequent_ngrams(
    df: DataFrame, group: str, order: Sequence[str], text: str, n: int, vocabulary: int, min_df: int = 2, max_df: float = 0.9, cells: int = MASK_CELLS
) -> DataFrame:
    """``group, ngram, tf`` with exact counts, of all n-grams that ``tfidf`` can take into its vocabulary.

    N-grams are counted by a 64-bit hash first: numbers are shuffled, no strings. A hash bounds the groups and
    the count of each of its n-grams from above, so n-grams of hashes in too few groups or below the count of the
    ``vocabulary``-th fitting hash are left out. The cells of the others become a bitmap (``cells`` bits, a power
    of two of at least 64), and only n-grams of its cells are counted as strings. Should n-grams that share a hash
    have put the bound too high, it is lowered and the count repeated, so the vocabulary is the same as that of all
    n-grams, ties included.
    """
    texts = _texts(df, group, order, text, n)
    n_groups = df.where(F.col(text).isNotNull()).agg(F.count_distinct(group)).first()[0]
    least = max(1, min_df)  # as many groups, so at least as often
    hashes = cut(_hashed(texts, group, n).where(F.col("df") >= min_df))
    fitting = hashes.where(F.col("df") <= max_df * n_groups).select("total")
    top = fitting.orderBy(F.desc("total")).limit(vocabulary).agg(F.count("*"), F.min("total")).first()
    bound = top[1] if vocabulary and top[0] == vocabulary else least
    while True:
        mask = _mask(hashes.where(F.col("total") >= bound), cells)
        counts = cut(_counted(texts, group, n, mask))
        if bound <= least:
            return counts
        sure = _terms(counts, n_groups, min_df, max_df).where(F.col("total") >= bound)
        if sure.limit(vocabulary).count() == vocabulary:
            return counts
        bound = max(least, bound // 4)


def _terms(counts: DataFrame, n_groups: int, min_df: int, max_df: float) -> DataFrame:
    terms = counts.groupBy("ngram").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    return terms.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_groups))


def tfidf(counts: DataFrame, group: str, n_groups: int, vocabulary: int | None = 10_000, min_df: int = 2, max_df: float = 0.9) -> DataFrame:
    """``group, ngram, tf, df, tfidf`` for terms in at least ``min_df`` and at most ``max_df`` of the groups.

    The vocabulary is the ``vocabulary`` most frequent such terms, ties in alphabetical order.
    """
    terms = _terms(counts, n_groups, min_df, max_df)
    if vocabulary is not None:
        terms = terms.orderBy(F.desc("total"), "ngram").limit(vocabulary)
    idf = F.log((F.lit(n_groups) + 1.0) / (F.col("df") + 1.0))
    return counts.join(terms.select("ngram", "df"), "ngram").select(group, "ngram", "tf", "df", (F.col("tf") * idf).alias("tfidf"))


def top_words(
    df: DataFrame,
    group: str,
    order: Sequence[str],
    text: str,
    n: int = 2,
    top: int = 10,
    vocabulary: int | None = 10_000,
    min_df: int = 2,
    max_df: float = 0.9,
) -> DataFrame:
    """The ``top`` n-grams of each group by TF-IDF: ``group, rank, ngram, tfidf``."""
    n_groups = df.where(F.col(text).isNotNull()).agg(F.count_distinct(group)).first()[0]
    if vocabulary is None:
        counts = group_ngrams(df, group, order, text, n)
    else:
        counts = frequent_ngrams(df, group, order, text, n, vocabulary, min_df, max_df)
    scored = tfidf(counts, group, n_groups, vocabulary, min_df, max_df)
    ranked = Window.partitionBy(group).orderBy(F.desc("tfidf"), "ngram")
    return (
        scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
        .select(group, "rank", "ngram", "tfidf")
    )


def topic_lists(top: DataFrame, group: str, name: str = "topN_words") -> DataFrame:
    """The ranked words of each group as one array."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "ngram")))
    return top.groupBy(group).agg(ordered["ngram"].alias(name))


def zip_explode(df: DataFrame, keep: Sequence[str], left: str, right: str, names: Sequence[str] = ("sentence", "embedding")) -> DataFrame:
    """One row per position of two arrays."""
    pairs = F.arrays_zip(F.col(left).alias("_a"), F.col(right).alias("_b"))
    return df.select(*keep, F.explode(pairs).alias("_p")).select(
        *keep, F.col("_p._a").alias(names[0]), F.col("_p._b").alias(names[1])
    )


def spread(df: DataFrame, array: str, size: int, prefix: str | None = None) -> DataFrame:
    """An array column as ``size`` columns ``prefix_0 …``."""
    prefix = prefix or array
    return df.select(*[c for c in df.columns if c != array], *[F.col(array)[i].alias(f"{prefix}_{i}") for i in range(size)])
