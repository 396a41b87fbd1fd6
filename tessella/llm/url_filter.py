"""URL filter: explicit rules first, then naive Bayes over the words in host and path.

Names in a host are written together; a unigram model of the words in the pages cuts them apart: of all
ways to cut a name, Viterbi's algorithm finds the one with the highest product of word probabilities.
Names, their substrings and the word counts meet in joins, so the vocabulary is never broadcast. A
multinomial naive Bayes model over host words and path tokens, hashed into a fixed number of buckets (its
tables are bounded), learns from the urls that a rule decides; seed words among the tokens add fixed odds of their own. What is learnt
are shares of the class's tokens, each with ``LEAST_SHARE`` added, so the odds depend on the make-up of the table and
not on its size. A url is blocked where the log odds are over ``SURE``.

Defined results: a url that is null or has no ``://`` has an empty host and path, no tokens, and the class
with the higher prior, as has any url without tokens; equal odds allow. Of rules of one length that fit,
the first in alphabetical order holds. Repeated rows are judged each; an empty table gives an empty table.
Columns of the input stay; ``host``, ``path``, ``rule`` and ``verdict`` are replaced if they are there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import plain_name, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST_WORD = 63  # fixed value: a name in a host has no more letters
BUCKETS = 1 << 16
# fixed values: words whose presence in a host or path speaks for a page nobody wants
SEED_WORDS = """
    ad ads adult advert affiliate bet bets betting bingo bonus bookmaker bulk casino cash cheap clickbait coupon crack
    credit cupid dating deals diet discount escort farm free gambling hentai hookup jackpot lender loan loans lottery lotto
    meds nude payday pharma pharmacy pill pills poker porn prize promo replica roulette sale sex sexy slots spam spin
    sweepstake tracker track tracking traffic viagra voucher wager warez win winner xxx
""".split()
SEED_ODDS, LEAST_SHARE, SURE = 8.0, 0.002, 2.0


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(action: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(action, host, slash + path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased; path: up to ``?`` or ``#``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    part = lambda i: F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return F.translate(part(1), UPPER, LOWER), part(2)


def first_rule(host: Column, path: Column, rules: Sequence[Rule], pick) -> Column:
    """What ``pick`` gives for the longest rule that fits, null if none does. The rules are a parameter,
    compiled into one expression."""
    found = [
        F.when(((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path)), pick(r))
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text))
    ]
    return F.coalesce(*found, F.lit(None).cast("string"))


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """``word, n`` over all texts: runs of letters, lower-cased; what is between ``<`` and ``>`` is no text."""
    plain = F.regexp_replace(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "<[^>]*>", " ")
    words = texts.select(F.explode(F.split(F.lower(plain), r"[^\p{L}]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def best_cut(name: str, found: list[tuple[int, int, int]], total: int) -> list[str]:
    """Viterbi: the words that a name most probably consists of. ``found`` has ``start, length, count`` of
    the substrings that are words; others cost as one unknown word, the more the longer."""
    n = len(name)
    ends: dict[int, list[tuple[int, float]]] = {}
    for start, length, count in found:
        ends.setdefault(start + length, []).append((start, math.log(count / total)))
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    run = 0  # where an unknown word would best begin, as its cost grows evenly with its length
    unknown, per_letter = -math.log(10.0 * max(total, 1)), -math.log(10.0)
    for end in range(1, n + 1):
        if best[end - 1] - per_letter * (end - 1) > best[run] - per_letter * run:
            run = end - 1
        best[end], back[end] = best[run] + unknown + per_letter * (end - run), run
        for start, cost in ends.get(end, ()):
            if best[start] + cost > best[end]:
                best[end], back[end] = best[start] + cost, start
    words, end = [], n
    while end:
        words.append(name[back[end]:end])
        end = back[end]
    return words[::-1]


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """``name, words`` for distinct ``name``; ``words`` is a written table of ``word, n``."""
    total = words.agg(F.sum("n")).first()[0] or 1
    place = F.expr(f"""flatten(transform(sequence(1, length(name)), i -> transform(sequence(1, least({LONGEST_WORD}, length(name) - i + 1)),
        k -> struct(i - 1 AS start, k AS length, substring(name, i, k) AS word))))""")
    parts = names.where("name <> ''").select("name", F.explode(place).alias("p")).select("name", "p.start", "p.length", "p.word")
    known = parts.join(words, "word").groupBy("name").agg(F.collect_list(F.struct(F.col("start").cast("int"), F.col("length").cast("int"), F.col("n").cast("long"))).alias("found"))

    @F.arrow_udf("array<string>")
    def cut(name: pa.Array, found: pa.Array) -> pa.Array:
        rows = zip(name.to_pylist(), found.to_pylist())
        return pa.array([best_cut(a, [tuple(x.values()) for x in b or ()], total) for a, b in rows], pa.list_(pa.string()))

    return names.join(known, "name", "left").select("name", cut("name", "found").alias("words"))


def host_tokens(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """``host, tokens`` for distinct ``host``: its names cut into words, marked as host words."""
    names = written(hosts.select("host", F.posexplode(F.split("host", r"[^\p{L}]+")).alias("at", "name")).where("name <> ''"), "host-names")
    cut = segmented(names.select("name").distinct(), words)
    each = names.join(cut, "name").select("host", F.explode("words").alias("word"))
    return each.groupBy("host").agg(F.collect_list(F.concat(F.lit("host "), "word")).alias("tokens"))


def path_tokens(path: Column) -> Column:
    """Parts of a path, lower-cased; a run of digits counts as one sign."""
    parts = F.split(F.regexp_replace(F.lower(path), "[0-9]+", "0"), r"[^\p{L}0]+")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit("path "), x))


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def naive_bayes(examples: DataFrame) -> tuple[float, np.ndarray]:
    """Log odds of ``block`` against ``allow`` before and for each bucket, from ``tokens`` and ``blocked``; a
    class without tokens has the same share everywhere."""
    priors = {r["blocked"]: r["n"] for r in examples.groupBy("blocked").agg(F.count("*").alias("n")).collect()}
    rows = examples.select("blocked", F.explode("tokens").alias("token")).groupBy("blocked", _bucket(F.col("token")).alias("b")).agg(F.count("*").alias("n"))
    counts = np.zeros((2, BUCKETS))
    for r in rows.collect():  # at most two rows for each bucket
        counts[int(r["blocked"]), r["b"]] = r["n"]
    total = counts.sum(1, keepdims=True)
    share = np.divide(counts, total, out=np.full_like(counts, 1 / BUCKETS), where=total > 0) + LEAST_SHARE
    prior = math.log(priors.get(True, 0) + 1) - math.log(priors.get(False, 0) + 1)
    return prior, np.log(share[1]) - np.log(share[0])


def tokenized(pages: DataFrame, rules: Sequence[Rule], words: DataFrame, url: str) -> tuple[DataFrame, str, list[str]]:
    """The rows with ``host``, ``path``, ``rule`` and the rule's ``verdict``, and their tokens; with the name of
    that column and the columns that stay."""
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))
    rows = rows.withColumns({
        "rule": first_rule(F.col("host"), F.col("path"), rules, lambda r: F.lit(r.text)),
        "verdict": first_rule(F.col("host"), F.col("path"), rules, lambda r: F.lit(r.action)),
    })
    hosts = written(rows.select("host").distinct(), "hosts")
    by_host = written(host_tokens(hosts, written(words, "words")), "host-tokens")
    tokens, of_host, name = (plain_name(rows, n) for n in ("_tokens", "_of_host", "_name"))
    by_host = by_host.withColumnsRenamed({"host": name, "tokens": of_host})
    none = F.array().cast("array<string>")
    rows = rows.join(by_host, rows["host"] == by_host[name], "left").withColumn(tokens, F.concat(F.coalesce(of_host, none), path_tokens(F.col("path"))))
    return rows.select(*[F.col(f"`{c}`") for c in keep], "host", "path", "rule", "verdict", tokens), tokens, keep


def _blocked(tokens: str, prior: float, odds: np.ndarray, df: DataFrame, seeds: Sequence[str]) -> Column:
    """Whether the odds of a row's tokens speak for ``block``."""
    shared = df.sparkSession.sparkContext.broadcast(odds)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for buckets in batches:
            yield pa.array([prior + float(shared.value[b].sum()) if (b := x or []) else prior for x in buckets.to_pylist()], pa.float64())

    listed = F.array(*[F.lit(f"{place} {w}") for w in seeds for place in ("host", "path")]).cast("array<string>")
    known = F.size(F.filter(F.col(tokens), lambda x: F.array_contains(listed, x)))
    return score(F.transform(F.col(tokens), _bucket)) + SEED_ODDS * known > SURE


def _examples(rows: DataFrame, tokens: str) -> DataFrame:
    return rows.where("rule IS NOT NULL").select(F.col(tokens).alias("tokens"), (F.col("verdict") == "block").alias("blocked"))


def judge(pages: DataFrame, rules: Sequence[Rule], words: DataFrame, url: str = "url", seeds: Sequence[str] = SEED_WORDS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (text of the rule that fits) and ``verdict``.

    ``words``: a table of ``word, n``; the urls that a rule decides are the examples for the rest.
    """
    rows, tokens, _ = tokenized(pages, rules, words, url)
    blocked = _blocked(tokens, *naive_bayes(_examples(rows, tokens)), pages, seeds)
    verdict = F.when(F.col("rule").isNotNull(), F.col("verdict")).when(blocked, "block").otherwise("allow")
    return rows.withColumn("verdict", verdict).drop(tokens)


def held_out_accuracy(pages: DataFrame, rules: Sequence[Rule], words: DataFrame, url: str = "url") -> tuple[int, float]:
    """How many urls that a rule decides were held out (by a hash of the url), and the share of them that a model of
    the other ones, which sees no rule, decides as the rule does."""
    rows, tokens, _ = tokenized(pages, rules, words, url)
    held = F.pmod(F.crc32(F.col(f"`{url}`").cast("string")), F.lit(4)) == 2
    blocked = _blocked(tokens, *naive_bayes(_examples(rows.where(~held), tokens)), pages, SEED_WORDS)
    right = rows.where(held & F.col("rule").isNotNull()).select(((F.col("verdict") == "block") == blocked).cast("int").alias("right"))
    n, share = right.agg(F.count("*"), F.coalesce(F.avg("right"), F.lit(0.0))).first()
    return n, share
