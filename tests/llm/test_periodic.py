"""Runs of words against a search that tries every period at every place."""

import hashlib
import zlib
from itertools import pairwise

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.catalog.base import Tables
from tessella.llm import periodic
from tessella.llm.queries import QUERIES


def plain_runs(words, least=12):
    """Every stretch with equal words ``q`` apart that cannot grow, its smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found_runs(words, least=12):
    return list(zip(*(x.tolist() for x in periodic.find_runs(np.array(words, np.int64), least))))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80), st.integers(1, 12))
def test_runs_of_small_alphabets(words, least):
    assert found_runs(words, least) == plain_runs(words, least)


def standard_word(turns):
    """A word with few factors of each length, in which immediate next occurrences miss periods."""
    a, b = [0], [0] * turns[0] + [1]
    for t in turns[1:]:
        a, b = b, b * t + a
    return b


@pytest.mark.parametrize("turns", [(1, 1, 1, 1, 1, 1), (2, 1, 3, 1), (1, 2, 1, 2, 1), (4, 3, 2), (3, 1, 1, 4)])
def test_runs_of_words_that_nearly_repeat(turns):
    word = standard_word(turns)
    for shift in range(0, len(word), max(1, len(word) // 40)):
        turned = word[shift:] + word[:shift]
        for tail in (0, 1, len(word) // 2):
            words = [7, *turned, *turned, *turned[:tail], 8]
            assert found_runs(words, 2) == plain_runs(words, 2)


def test_random_periods():
    random = np.random.default_rng(3)
    for _ in range(300):
        words = []
        while len(words) < 150:
            unit = random.integers(0, random.integers(2, 6), random.integers(1, 30)).tolist()
            words += (unit * 4)[:random.integers(1, 4 * len(unit) + 1)]
        assert found_runs(words, 12) == plain_runs(words, 12)


def test_messy_rows(spark, messy, empty):
    rows = periodic.collapse(messy).collect()
    assert len(rows) == messy.count() and periodic.collapse(empty).count() == 0
    assert set(messy.columns) | {"n_words", "runs", "collapsed"} == set(rows[0].asDict())
    for r in rows:
        words = [w.decode() for w in (r["text"] or "").encode().split()]
        expected = plain_runs(words) if len(words) < 1000 else [(0, 27000, 3)]
        assert [tuple(x) for x in r["runs"]] == expected and r["n_words"] == len(words)
        assert r["collapsed"] == plain_collapse(words, expected)
    named = messy.selectExpr("text AS RUNS", "n_words", "_found") if "n_words" in messy.columns else messy.selectExpr("text", "doc_id AS N_Words", "lang AS _found")
    assert periodic.collapse(named).columns == ["text", "_found", "n_words", "runs", "collapsed"]


def test_nothing_runs_across_texts(spark):
    rows = spark.createDataFrame([(i, "a b " * 5) for i in range(50)], "doc_id long, text string").coalesce(1)
    assert periodic.collapse(rows).where("size(runs) > 0").count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    tables = Tables(spark, folder)
    rows = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](tables).collect()}
    texts = {r["doc_id"]: r["text"] for r in tables.documents.select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    some = 0
    for name, text in texts.items():
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(name).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, r = plain_runs(words), rows[name]
        assert r["n_runs"] == len(runs)
        some += len(runs)
        if runs:
            s, length, q = min(runs, key=lambda x: (-x[1], x[0], x[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (s, length, q, 1000 * length // q)
        else:
            assert r["start"] is r["length"] is r["period"] is r["exponent_milli"] is None
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest()
    assert some > 10 and all(a <= b for a, b in pairwise(sorted(rows)))
