"""Sentence boundaries from statistics of the texts themselves: abbreviations, collocations, then one expression.

The statistics are those of Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection" (2006):
how much more often a word is followed by a period than words are at large, and how much more often a word
follows a number or an initial than it stands elsewhere. Both are counts that merge before they shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.sizing import attach, small_table, spread_out
from tessella.session import cut

SPACE = r"[ \t\n\f\r\x0B]"
# Fixed values of the published method
ALTERNATIVE = 0.99
ABBREVIATION_SCORE = 0.3
COLLOCATION_SCORE = 7.88
IN_PLACE = 1_000_000


def bare(token: Column) -> Column:
    """A token in lower case without what surrounds its letters and digits; its last period stays."""
    left = F.regexp_replace(token, r"^[^\p{L}\p{N}]+", "")
    return F.lower(F.reverse(F.regexp_replace(F.reverse(left), r"^[^\p{L}\p{N}.]+", "")))  # from its end: linear


def _dotted(word: Column) -> Column:
    return word.endswith(".") & ~word.endswith("..")


def _stem(word: Column) -> Column:
    return F.when(_dotted(word), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``word, n_dotted, n_plain``: how often each word has a period behind it and how often not."""
    rows = spread_out(df.select(text).where(F.col(text).isNotNull()))
    # tokens are counted as they stand, so the expressions see each distinct one only
    tokens = rows.select(F.explode(F.split(text, f"{SPACE}+")).alias("_x")).groupBy("_x").agg(F.count("*").alias("_n"))
    words = tokens.select(bare(F.col("_x")).alias("_w"), "_n").where("_w <> ''")
    times = lambda kind: F.sum(F.when(kind, F.col("_n")).otherwise(F.lit(0)))
    return words.groupBy(_stem(F.col("_w")).alias("word")).agg(
        times(_dotted(F.col("_w"))).alias("n_dotted"), times(~_dotted(F.col("_w"))).alias("n_plain")
    )


def abbreviations(counts: DataFrame, least: float = ABBREVIATION_SCORE) -> DataFrame:
    """``word, n_dotted, n_plain, score`` of the words that are abbreviations.

    The likelihood ratio of "the period belongs to the word" against "periods fall anywhere" is weighted
    down for long words and for each time the word stands without a period, and up for periods inside.
    """
    totals = counts.agg(F.sum(F.col("n_dotted") + F.col("n_plain")).alias("_n"), F.sum("n_dotted").alias("_dots"))
    rows = attach(counts.where((F.col("n_dotted") > 0) & F.col("word").rlike(r"\p{L}")), totals, [], True)
    share = F.col("_dots") / F.col("_n")
    # where every word has a period, a word without one cannot be weighed; no such word exists then
    missing = F.when(F.col("n_plain") == 0, F.lit(0.0)).otherwise(F.col("n_plain") * F.log((1 - F.lit(ALTERNATIVE)) / (1 - share)))
    ratio = 2 * (F.col("n_dotted") * F.log(F.lit(ALTERNATIVE) / share) + missing)
    inner = F.length("word") - F.length(F.replace(F.col("word"), F.lit("."), F.lit("")))
    letters = F.length("word") - inner
    score = ratio * F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters.cast("double"), -F.col("n_plain").cast("double"))
    return rows.withColumn("score", score).where(F.col("score") >= least).select("word", "n_dotted", "n_plain", "score")


def _loglik(k: Column, n: Column, p: Column) -> Column:
    some = F.when(k > 0, k * F.log(p)).otherwise(F.lit(0.0))
    return some + F.when(n - k > 0, (n - k) * F.log(1 - p)).otherwise(F.lit(0.0))


def collocations(df: DataFrame, text: str, counts: DataFrame, least: float = COLLOCATION_SCORE) -> DataFrame:
    """``word, following, n, score``: words bound to the number or single letter with a period before them."""
    rows = spread_out(df.select(text).where(F.col(text).isNotNull()))
    # tokens of which ``bare`` leaves something; few have a period, and only those are looked at closely
    tokens = rows.select(F.filter(F.split(text, f"{SPACE}+"), lambda w: w.rlike(r"[\p{L}\p{N}]")).alias("_t"))
    numbers = F.transform("_t", lambda w, i: F.when(w.contains(".") & bare(w).rlike(r"^(?:\p{L}|\p{N}+)\.$"), i))
    starts = F.filter(numbers, lambda i: i.isNotNull() & (i + 1 < F.size("_t")))
    pairs = F.transform(starts, lambda i: F.struct(F.get("_t", i).alias("_a"), F.get("_t", i + 1).alias("_b")))
    pairs = tokens.select(F.explode(pairs).alias("_x")).groupBy("_x._a", "_x._b").agg(F.count("*").alias("n"))
    pairs = pairs.select(bare(F.col("_a")).alias("_a"), bare(F.col("_b")).alias("_b"), "n")
    pairs = pairs.groupBy(_stem(F.col("_a")).alias("word"), _stem(F.col("_b")).alias("following")).agg(F.sum("n").alias("n")).where("n > 1")
    of = F.col("n_dotted") + F.col("n_plain")
    pairs = pairs.join(counts.select("word", of.alias("_c1")), "word")
    pairs = pairs.join(counts.select(F.col("word").alias("following"), of.alias("_c2")), "following")
    pairs = attach(pairs, counts.agg(F.sum(of).alias("_n")), [], True)
    n, c1, c2, whole = F.col("n"), F.col("_c1"), F.col("_c2"), F.col("_n")
    bound = _loglik(n, c1, n / c1) + _loglik(c2 - n, whole - c1, (c2 - n) / (whole - c1))
    free = _loglik(n, c1, c2 / whole) + _loglik(c2 - n, whole - c1, c2 / whole)
    found = pairs.where((whole > c1) & (n * whole > c1 * c2)).withColumn("score", 2 * (bound - free))
    return found.where(F.col("score") >= least).select("word", "following", "n", "score")


def _pieces(text: str) -> Column:
    """The text cut wherever white space follows ``. ! ?``; nothing is lost, white space leads the next piece."""
    return F.split(text, rf"(?<=[.!?])(?={SPACE})")


def _end(piece: Column) -> Column:
    """The last word of a piece that ends with a period."""
    return F.when(piece.endswith("."), bare(F.element_at(F.split(F.substring_index(piece, " ", -1), f"{SPACE}+"), -1)))


def _start(piece: Column) -> Column:
    """The first word of a piece; every piece but a text's first begins with white space."""
    return _stem(bare(F.coalesce(F.get(F.split(piece, f"{SPACE}+", 3), F.lit(1)), F.lit(""))))


def _with_joints(pieces: DataFrame) -> DataFrame:
    """Add what is looked up behind each piece of ``_p``, null without a period: ``_w``, the word, and ``_j``, it and the next one."""
    words = F.transform(F.transform("_p", _end), lambda w: F.when(_dotted(w), _stem(w)))
    joint = lambda w, i: F.when(w.isNotNull(), F.concat_ws(" ", w, _start(F.get("_p", i + 1))))
    return pieces.withColumn("_w", words).withColumn("_j", F.transform("_w", joint))


def _joined(pieces: DataFrame, keep: Sequence[str], name: str, known: pa.Array | None) -> DataFrame:
    """Pieces put together where the word or pair behind them is known, to all texts or in the text's own ``_known``."""
    shared = None if known is None else pieces.sparkSession.sparkContext.broadcast(known)
    columns = [*keep, "_p", "_w", "_j", *(["_known"] if known is None else [])]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(len(keep))
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            keys = [batch.column(len(keep) + i).flatten() for i in (1, 2)]
            table = shared.value if shared else None
            if table is None:  # each row has a table of its own
                own = batch.column(len(keep) + 3)
                of = lambda rows, x: pc.binary_join_element_wise(pa.array(rows).cast(pa.string()), x.cast(pa.string()), "\0")
                table = of(np.repeat(np.arange(len(sizes)), own.value_lengths().to_numpy(zero_copy_only=False)), own.flatten())
                keys = [of(row, k) for k in keys]
            held = pc.or_(*[pc.and_(pc.is_valid(k), pc.is_in(k, value_set=table)) for k in keys]).to_numpy(zero_copy_only=False)
            first = np.cumsum(sizes) - sizes
            begins = np.concatenate([[True], ~held[:-1]])
            begins[first] = True
            at = np.flatnonzero(begins)
            flat = lists.flatten().cast(pa.large_string())  # pieces lie one behind the other, so whole sentences do too
            offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1]
            ends = pa.py_buffer(np.append(offsets[at], offsets[-1]).tobytes())
            whole = pa.LargeStringArray.from_buffers(len(at), ends, flat.buffers()[2])
            number = np.arange(len(at)) - np.searchsorted(at, first)[row[at]]
            sentences = pc.utf8_ltrim(whole, characters=" \t\n\f\r\x0b").cast(pa.string())
            kept = batch.select(list(range(len(keep)))).take(pa.array(row[at])).columns
            yield pa.record_batch([*kept, pa.array(number.astype(np.int32)), sentences], [*keep, "sentence_no", name])

    new = [T.StructField("sentence_no", T.IntegerType()), T.StructField(name, T.StringType())]
    return pieces.select(columns).mapInArrow(join, T.StructType([*[pieces.schema[c] for c in keep], *new]))


def known_joints(df: DataFrame, text: str) -> DataFrame:
    """One column ``known``: abbreviations, and collocations as two words with a blank."""
    counts = cut(word_counts(df, text))
    found = abbreviations(counts).select(F.col("word").alias("known"))
    return found.unionByName(collocations(df, text, counts).select(F.concat_ws(" ", "word", "following").alias("known"))).distinct()


def split_sentences(df: DataFrame, text: str, keep: Sequence[str], known: DataFrame | None = None, name: str = "sentence", in_place: int = IN_PLACE) -> DataFrame:
    """One row for each sentence with its number in the text; a period of an abbreviation ends none.

    ``known`` defaults to what ``df`` itself shows. Up to ``in_place`` entries travel to the tasks as one array;
    beyond that each text gets those that occur at its own cuts by a join on the text. Rows with equal
    texts are kept each; a null text gives no row, an empty one an empty sentence.
    """
    known, small = small_table(known if known is not None else known_joints(df, text), in_place)
    rows = spread_out(df.select(*keep, F.col(text).alias("_text")).where(F.col(text).isNotNull()))
    if small:
        pieces = _with_joints(rows.select(*keep, _pieces("_text").alias("_p")))
        return _joined(pieces, keep, name, known.toArrow().column(0).combine_chunks())
    own = _with_joints(rows.select("_text").distinct().select("_text", _pieces("_text").alias("_p")).where(F.size("_p") > 1))
    own = own.select("_text", F.explode(F.array_distinct(F.array_compact(F.concat("_w", "_j")))).alias("known")).join(known, "known")
    own = own.groupBy("_text").agg(F.collect_set("known").alias("_known"))
    rows = rows.join(own, "_text", "left").select(
        *keep, _pieces("_text").alias("_p"), F.coalesce("_known", F.array().cast("array<string>")).alias("_known")
    )
    return _joined(_with_joints(rows), keep, name, None)
