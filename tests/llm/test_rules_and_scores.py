"""Quality rules against plain Python, the classifier on held-out rows, url filter and chat on small cases."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.catalog.base import Tables
from tessella.llm import chat, quality_classifier, quality_rules, url_filter
from tessella.llm.queries import QUERIES, URL_RULES

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
    }


def test_measures(messy, empty):
    for r in quality_rules.judge(messy).collect():
        expected = measured(r["text"])
        assert {k: r[k] for k in expected} == expected
        failed = expected["n_words"] < 50 or 100 * expected["n_repeat_words"] > 50 * expected["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality_rules.judge(empty).count() == 0


def test_filter_on_the_verdict_stays_linear(messy):
    judged = quality_rules.judge(messy)
    assert judged.where("kept").count() + judged.where("NOT kept").count() == messy.count()


def test_each_rule_can_reject(spark):
    good = " ".join(f"the word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    bad = {
        "word length": " ".join("the " + chr(97 + i % 26) * 60 + chr(97 + i // 26) for i in range(60)), "symbols": good.replace("word", "# word"),
        "stop words": " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)), "capitals": good.upper() + " the of",
        "repeated lines": "\n".join(["of it"] * 30 + [good]), "open-ended lines": "\n".join(f"{w}..." for w in good.split()), "bullet lines": "\n".join(f"- {w}" for w in good.split()),
    }
    rows = spark.createDataFrame([("good", good), *bad.items()], "name string, text string")
    kept = {r["name"]: r for r in quality_rules.judge(rows).collect()}
    assert kept["good"]["kept"]
    for rule in quality_rules.RULES:
        judged = quality_rules.measures(rows.where(f"name = '{rule.name}'")).selectExpr(f"{rule.sql()} AS held").first()
        assert not judged["held"], rule.name


def test_held_out_quality(spark):
    rows = QUERIES["op8_quality_classifier"](Tables(spark, FOLDER)).toPandas()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    tested = rows.merge(labels, on="doc_id")
    tested = tested[tested.held_out]
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    assert (tested.predicted == tested.quality).mean() > 0.95
    assert tested[tested.quality == 1].score.mean() - tested[tested.quality == 0].score.mean() > 0.7


def test_scores_on_messy_rows(spark, messy, empty):
    labels = spark.createDataFrame([(0, 1), (0, 1), (7, 0), (None, 1), (3, None), (99, 1)], "doc_id long, quality int")
    model = quality_classifier.fit(messy, labels, "quality", max_labelled=10)
    rows = quality_classifier.score(messy, model).collect()
    assert len(rows) == messy.count()
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[3] == by_id[4] == pytest.approx(model.prior)
    assert by_id[0] > by_id[7]
    assert quality_classifier.score(empty, quality_classifier.fit(empty, labels, "quality")).count() == 0


def test_labelled_id_that_repeats(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    once = [(i, " ".join(words[(i * k) % 10] for k in range(1, 30))) for i in range(8)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    for repeats in ([(3, once[3][1])] * 3000, [(i, f"{once[i][1]} {n}") for n in range(2000) for i in (3, 5)]):
        docs = spark.createDataFrame(once + repeats, "doc_id long, text string").repartition(4)
        model = quality_classifier.fit(docs, labels, "quality", max_labelled=8)
        assert sorted(model.labels.tolist()) == [0, 0, 0, 0, 1, 1, 1, 1]
        assert model.prior == 0.5 and len(model.vectors) == 8


def test_votes_equal_brute_force():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps!!", "zeta|"], 30)) for _ in range(60)]
    found = [quality_classifier.terms(t) for t in texts]
    idf = np.ones(quality_classifier.WIDTH)
    x = quality_classifier._matrix(found, idf)
    axes = np.linalg.svd(x[:40], full_matrices=False)[2][:8].T.astype(np.float32)
    labels = rng.integers(0, 2, 40).astype(np.float32)
    model = quality_classifier.Model(idf, axes, quality_classifier._unit(x[:40] @ axes), labels, float(labels.mean()), 5, 4.0)
    got = quality_classifier.votes(model, found)
    for i in range(60):
        v = x[i] @ axes
        cosine = (model.vectors @ v) / np.linalg.norm(v)
        near = sorted(range(40), key=lambda j: -cosine[j])[:5]
        weight = np.clip(cosine[near], 0, 1) ** 4
        assert got[i] == pytest.approx((weight * labels[near]).sum() / weight.sum(), abs=1e-3)


def test_urls(spark):
    urls = [
        "https://a.example.org/es/5", "http://EXAMPLE.org/en/1x?q", "https://example.org/en/2#t", "ftp://x.com/fr/", "x.com/fr/", None, "", "https://notorg/de/",
        "https://x.com/de/http://y.org/", "https://free-bets.net/en/3", "http://org/", "http://a.org", "http://a.org", "HTTP://" + "verylongname" * 400 + ".net/" + "p/" * 3000,
    ]
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(urls)], "page_id long, url string, tokens string, _host string, `a.b` string")
    words = spark.createDataFrame([("free", 50), ("bets", 9), ("very", 5), ("long", 7), ("name", 8)], "word string, n long")
    rows = {r["page_id"]: r for r in url_filter.judge(pages, URL_RULES, words).collect()}
    assert [rows[i]["rule"] for i in range(9)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", None, None, None, None, "com/de/"]
    assert [rows[i]["verdict"] for i in (0, 1, 2, 3, 8, 9)] == ["block", "block", "allow", "allow", "block", "block"]
    assert (rows[1]["host"], rows[1]["path"]) == ("example.org", "/en/1x") and (rows[5]["host"], rows[5]["path"]) == ("", "")
    assert rows[11]["rule"] is None and rows[11]["path"] == "" and len(rows) == len(urls)
    assert url_filter.judge(pages.limit(0), URL_RULES, words.limit(0)).count() == 0


def test_viterbi_equals_all_cuts():
    counts = {"free": 50, "bets": 9, "bet": 30, "s": 3, "fr": 2, "ee": 2, "the": 90, "rapist": 4, "therapist": 12}
    total = sum(counts.values())

    def cost(word):
        return math.log(counts[word] / total) if word in counts else -math.log(10.0 * total) - len(word) * math.log(10.0)

    def cuts(name):
        return [[name]] + [[name[:i], *rest] for i in range(1, len(name)) for rest in cuts(name[i:])] if name else [[]]

    for name in ("freebets", "therapist", "qqfreeq", "betsbet", "x", "thefrees"):
        found = [(i, n, counts[name[i:i + n]]) for i in range(len(name)) for n in range(1, len(name) - i + 1) if name[i:i + n] in counts]
        got = url_filter.best_cut(name, found, total)
        assert "".join(got) == name
        assert sum(map(cost, got)) == pytest.approx(max(sum(map(cost, c)) for c in cuts(name)))


def test_naive_bayes_equals_plain_counts(spark):
    rows = [(["host a", "path x"], True), (["host a", "path y"], True), (["host b", "path y"], False)]
    prior, odds = url_filter.naive_bayes(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"))
    assert prior == pytest.approx(math.log(3 / 2))
    one = lambda blocked, allowed: math.log((blocked / 4 + url_filter.LEAST_SHARE) / (allowed / 2 + url_filter.LEAST_SHARE))
    expected = {one(2, 0), one(1, 0), one(1, 1), one(0, 1), 0.0}  # host a, path x, path y, host b, all others
    assert sorted(set(odds.round(9))) == pytest.approx(sorted({round(x, 9) for x in expected}), abs=1e-8)
    # the same table ten times over gives the same odds
    assert np.allclose(url_filter.naive_bayes(spark.createDataFrame(rows * 10, "tokens array<string>, blocked boolean"))[1], odds)


def test_verdicts_equal_a_plain_filter(spark):
    tables = Tables(spark, FOLDER)
    pages = [(r["page_id"], r["url"]) for r in tables.pages.collect()] + [(-1, None), (-2, "https://cheapwatchesnow.example.net/fr/1"), (-3, "https://best-casino.example.org2/fr/x")]
    texts = [r["html"] or "" for r in tables.pages.collect()]
    counts = Counter(w for t in texts for w in re.findall(r"[^\W\d_]+", re.sub("<[^>]*>", " ", t).lower()))
    total = sum(counts.values())

    def cut(name):
        best = [(0.0, [])]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(end):
                word = name[start:end]
                cost = math.log(counts[word] / total) if word in counts and len(word) <= url_filter.LONGEST_WORD else -math.log(10.0 * total) - len(word) * math.log(10.0)
                options.append((best[start][0] + cost, [*best[start][1], word]))
            best.append(max(options, key=lambda o: o[0]))
        return best[-1][1]

    def parts(url):
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (found.group(1), found.group(2)) if found else ("", "")
        host = host.translate({i: i + 32 for i in range(65, 91)})
        tokens = [f"host {w}" for name in re.split(r"[\W\d_]+", host) if name for w in cut(name)]
        tokens += [f"path {x}" for x in re.split(r"(?:[^\w]|[1-9_])+", re.sub("[0-9]+", "0", path.lower())) if x]
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return tokens, max(fits, key=lambda r: len(r.text)) if fits else None

    split = {i: parts(u) for i, u in pages}
    seen = sorted({t for tokens, _ in split.values() for t in tokens})
    bucket = {r["t"]: r["b"] for r in spark.createDataFrame([(t,) for t in seen], "t string").select("t", url_filter._bucket(F.col("t")).alias("b")).collect()}
    share = {}
    for action in ("allow", "block"):
        mine = Counter(bucket[t] for tokens, rule in split.values() if rule and rule.action == action for t in tokens)
        share[action] = lambda b, mine=mine, n=sum(mine.values()): (mine[b] / n if n else 1 / url_filter.BUCKETS) + url_filter.LEAST_SHARE
    decided = Counter(rule.action for _, rule in split.values() if rule)
    prior = math.log(decided["block"] + 1) - math.log(decided["allow"] + 1)
    frame = spark.createDataFrame(pages, "page_id long, url string").repartition(3)
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(frame, URL_RULES, url_filter.word_counts(tables.pages, "html")).collect()}
    assert len(got) == len(pages)
    seeds = {f"{place} {w}" for place in ("host", "path") for w in url_filter.SEED_WORDS}
    n_blocked = 0
    for i, (tokens, rule) in split.items():
        odds = prior + sum(math.log(share["block"](bucket[t]) / share["allow"](bucket[t])) + url_filter.SEED_ODDS * (t in seeds) for t in tokens)
        if abs(odds - url_filter.SURE) > 1e-6:
            assert got[i] == (rule.action if rule else "block" if odds > url_filter.SURE else "allow"), (i, tokens, odds)
        n_blocked += rule is None and got[i] == "block"
    assert n_blocked > 5


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_unwanted_hosts_are_blocked_at_every_size(spark, folder):
    tables = Tables(spark, folder)
    free = QUERIES["op3_url_filter"](tables).where("rule IS NULL").select("host", "verdict").collect()
    unwanted = [r["verdict"] for r in free if re.search("casino|bets|adult|pill|track", r["host"])]
    assert unwanted and unwanted.count("block") == len(unwanted)
    assert sum(r["verdict"] == "allow" for r in free) > 0.8 * len(free)
    n, right = url_filter.held_out_accuracy(tables.pages, URL_RULES, url_filter.word_counts(tables.pages, "html"))
    assert n >= 20 and right > 0.7


def test_preferences(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "why"),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, None, None), (7, None, "assistant", "x" * 100_000), (None, 0, "user", "lost"),
    ]
    frame = spark.createDataFrame([(*t, "p") for t in turns], "conv_id long, turn long, role string, text string, prompt string")
    rows = {r["pair_id"]: r for r in chat.preferences(chat.neighbours(frame)).collect()}
    assert set(rows) == {0, 1, 2, 3}
    first = rows[0]
    assert first["n_prompt_turns"] == 1 and first["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert first["chosen"] == "<|im_start|>assistant\nyes<|im_end|>\n"
    runs = lambda text, mask: [text[sum(m["n_chars"] for m in mask[:i]):][: m["n_chars"]] for i, m in enumerate(mask) if m["train"]]
    assert runs(first["chosen"], first["chosen_mask"]) == ["yes<|im_end|>\n"]
    assert runs(first["rejected"], first["rejected_mask"]) == ["no<|im_end|>\n"]
    assert sum(m["n_chars"] for m in first["rejected_mask"]) == len(first["rejected"])
    assert (rows[1]["n_prompt_turns"], rows[1]["chosen"], rows[1]["rejected"]) == (1, "", "")
    assert rows[2]["rejected"] == "" and rows[2]["chosen"] == "<|im_start|>user\n<|im_end|>\n"
    assert rows[3]["chosen_id"] is None and len(rows[3]["rejected"]) > 100_000
    assert chat.preferences(chat.neighbours(frame.limit(0))).count() == 0


def test_rules_hold_on_labelled_rows(spark):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
        kept = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, kept FROM ({quality_rules.oracle_sql()}) WHERE n_words >= 50").fetchall()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    right = [kept[i] == bool(q) for i, q in labels.items() if i in kept]
    assert sum(right) / len(right) > 0.97
