"""Sentence boundaries from statistics, and the vocabulary behind a count sketch."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import boundaries, words

FILLER = [f"Die Leute gehen heute {x} nach Hause. Morgen kommen sie wieder hierher." for x in ("gern", "bald", "langsam", "allein") * 12]
# words that end a sentence also stand inside others; that is what tells them from abbreviations
INSIDE = ["zu Hause war es schön und alle blieben hierher gewandt lange allein und gingen heim und kam es so ging es auch"] * 12
DOCTORS = ["Gestern sprach Dr. Rossi lange. Danach ging Dr. Bianchi heim.", "Hier wohnt Dr. Verdi allein."] * 8
DATES = ["Am 12. Mai begann es. Seit dem 12. Mai regnet es."] * 8


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, "x") for i, t in enumerate([*FILLER, *INSIDE, *DOCTORS, *DATES, "", None, "Dr. Neri kam. Dr. Neri ging."])]
    return spark.createDataFrame(rows, "doc_id long, text string, known string")


@pytest.mark.parametrize("in_place", [1000, 0])
def test_abbreviations_hold_sentences_together(texts, in_place):
    got = {}
    for r in boundaries.split_sentences(texts, "text", ["doc_id", "known"], in_place=in_place).orderBy("doc_id", "sentence_no").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    first = len(FILLER) + len(INSIDE)
    assert got[0] == ["Die Leute gehen heute gern nach Hause.", "Morgen kommen sie wieder hierher."]
    assert got[first] == ["Gestern sprach Dr. Rossi lange.", "Danach ging Dr. Bianchi heim."]
    assert got[first + len(DOCTORS)] == ["Am 12. Mai begann es.", "Seit dem 12. Mai regnet es."]
    last = first + len(DOCTORS) + len(DATES)
    assert got[last] == [""] and last + 1 not in got
    assert got[last + 2] == ["Dr. Neri kam.", "Dr. Neri ging."]


def test_statistics(texts):
    counts = boundaries.word_counts(texts, "text")
    found = {r.word: (r.n_dotted, r.n_plain) for r in boundaries.abbreviations(counts).collect()}
    assert found["dr"] == (26, 0) and "hause" not in found
    assert {(r.word, r.following, r.n) for r in boundaries.collocations(texts, "text", counts).collect()} == {("12", "mai", 16)}


def test_no_rows_and_only_dots(spark, texts):
    assert boundaries.split_sentences(texts.limit(0), "text", ["doc_id"]).count() == 0
    odd = spark.createDataFrame([("... . ! ?",), ("a.",), ("a" + "=" * 50_000 + "b. c",)], "text string")
    assert boundaries.split_sentences(odd, "text", []).count() >= 3
    dotted = spark.createDataFrame([("a. b. c.",)], "text string")  # every word has a period
    assert boundaries.split_sentences(dotted, "text", []).count() >= 1


@pytest.mark.parametrize("cells", [64, 1 << 12])
@pytest.mark.parametrize("vocabulary", [1, 5, 40, 10_000])
@pytest.mark.parametrize("n", [1, 2])
def test_sketch_keeps_the_vocabulary(spark, cells, vocabulary, n):
    texts = [(i, "abc"[i % 3], " ".join(f"w{(i * j * j + j) % (5 + i)}" for j in range(i % 9))) for i in range(60)]
    rows = spark.createDataFrame([*texts, (60, "a", None), (61, None, "w1 w2")], "id long, g string, text string")
    every = words.tfidf(words.group_ngrams(rows, "g", ["id"], "text", n), "g", 3, vocabulary)
    few = words.tfidf(words.frequent_ngrams(rows, "g", ["id"], "text", n, vocabulary, cells=cells), "g", 3, vocabulary)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, few.collect())) != []


def test_sketch_spares_the_shuffle(spark):
    rows = spark.range(2000).select(
        "id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), F.concat(F.lit("said again "), F.col("id"), F.lit(" x"), F.col("id")).alias("text")
    )
    every = words.group_ngrams(rows, "g", ["id"], "text", 2).count()
    assert words.frequent_ngrams(rows, "g", ["id"], "text", 2, 10).count() < every / 100


def test_full_cells_do_not_bring_all_ngrams_back(spark):
    texts = [("a", 1, " ".join(f"a{i}" for i in range(20_000)) + " one two"), ("b", 1, " ".join(f"b{i}" for i in range(20_000)) + " one two")]
    rows = spark.createDataFrame([*texts, ("c", 1, "three")], "g string, id int, text string")
    few = words.frequent_ngrams(rows, "g", ["id"], "text", 2, 10, cells=1 << 12)
    assert few.count() < 400  # before: 40,004, as n-grams of both groups met in every cell
    assert {tuple(r) for r in few.where("ngram = 'one two'").collect()} == {("a", "one two", 1), ("b", "one two", 1)}


def test_ngrams_are_counted_as_numbers(spark, monkeypatch):
    monkeypatch.setattr(words, "CHUNK_BYTES", 64)
    texts = [("a", i, f"w{i % 7} ü  \tx{i}\x0b" + " ".join(f"y{j}" for j in range(i % 5))) for i in range(60)] + [("a", 99, ""), (None, 1, "n n"), ("b", 2, None)]
    rows = spark.createDataFrame(texts, "g string, id int, text string")
    for n in (1, 2, 4):
        found = words.group_ngrams(rows, "g", ["id"], "text", n)
        assert "MapInArrow" in found._jdf.queryExecution().toString()  # before: an array of words for each n-gram
        every = re.split(r"[ \t\n\x0b\f\r]", " ".join(t for _, _, t in texts[:61]))
        expected = Counter(" ".join(every[i:i + n]) for i in range(len(every) - n + 1))
        assert {r["ngram"]: r["tf"] for r in found.collect()} == expected


def test_many_names_do_not_overflow():
    texts = pa.array([" ".join(f"{'abc'[i % 3]}{i % 1000}" for i in range(4_000))] * 2)
    chunk = pa.record_batch([pa.array(["g", "g"]), texts], ["g", "t"])
    of, names, codes, starts, times = words._chunk_grams(chunk, 9)  # 3,000 ** 9 is beyond 64 bits
    every = texts[0].as_py().split(" ")
    expected = Counter(tuple(every[i:i + 9]) for i in range(len(every) - 8))
    assert len(starts) == len(expected) and set(times) == {2 * v for v in expected.values()}


def test_many_known_words_move_no_texts(spark, texts):
    known = spark.createDataFrame([(f"w{i}",) for i in range(3_000)] + [("dr",), ("12 mai",)], "known string")
    found = boundaries.split_sentences(texts, "text", ["doc_id"], known)
    assert "Join" not in found._jdf.queryExecution().toString()  # before: whole texts were joined beyond 1,000 entries
    said = {r["sentence"] for r in found.collect()}
    assert {"Gestern sprach Dr. Rossi lange.", "Am 12. Mai begann es.", "Dr. Neri kam."} <= said
