"""Trie join, edit join, components and search against brute force; the pipeline as a whole."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessella.llm import line_dedup, simhash, topk_search
from tessella.llm.components import components


def find(up, x):
    while up[x] != x:
        x = up[x]
    return x


def classes(items, links):
    up = {x: x for x in items}
    for a, b in links:
        a, b = sorted((find(up, a), find(up, b)))
        up[b] = a
    return {x: find(up, x) for x in items}


def plain_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("depth, parts", [(0, 1), (4, 1), (4, 3)])
def test_trie_links(depth, parts):
    rng = np.random.default_rng(depth + parts)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for c in centres]))
    expected = {(int(a), int(b)) for i, a in enumerate(values) for b in values[i + 1:][np.bitwise_count(values[i + 1:] ^ a) <= 3]}
    got = set()
    prefix = values >> np.uint64(64 - depth) if depth else np.zeros(len(values), np.uint64)
    groups = {(int(p), s): values[(prefix == p) & (np.arange(len(values)) % parts == s)] for p in np.unique(prefix) for s in range(parts)}
    keys = sorted(groups)
    for i, x in enumerate(keys):
        for y in keys[i:]:
            for a, b in simhash.trie_links(groups[x], None if x == y else groups[y], 3, depth):
                got |= {(min(p, q), max(p, q)) for p, q in zip(a.tolist(), b.tolist())}
    assert got == expected


@pytest.mark.parametrize("part_rows", [50, 1 << 17])
def test_near_duplicates(spark, messy, part_rows, monkeypatch):
    monkeypatch.setattr(simhash, "PART_ROWS", part_rows)
    random.seed(1)
    base = [random.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(i % 97) for i in range(400)]
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    for i in range(150):
        words = list(base)
        for _ in range(i % 6):
            words[random.randrange(400)] = "changed"
        rows.append((100 + i, " ".join(words)))
    rows += [(300 + i, " ".join(random.choice(base) for _ in range(40))) for i in range(40)]
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    up = classes(range(len(rows)), links)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[up[i]] = min(doc, smallest.get(up[i], doc))
    frame = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, fingerprint int").repartition(5)
    got = sorted(((r["doc_id"], r["fingerprint"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(frame).collect()), key=str)
    assert got == sorted(((d, prints[i], smallest.get(up[i])) for i, (d, _) in enumerate(rows)), key=str)
    stay = simhash.first_of_each(frame).collect()
    assert len(stay) == len(set(up.values())) and stay[0].__fields__ == frame.columns
    assert sorted(r["doc_id"] for r in stay if r["doc_id"] is not None) == sorted(smallest.values())


def test_near_duplicate_stage(spark, messy):
    import corpus_pipeline

    random.seed(8)
    clash = messy.selectExpr("doc_id", "text", "1 AS _id", "2 AS _row", "3 AS node", "4 AS first", "5 AS label", "6 AS fingerprint")
    stay = corpus_pipeline.near_duplicates(spark, clash, "").collect()
    prints = [plain_fingerprint(r["text"]) for r in messy.collect()]
    up = classes(range(len(prints)), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    assert len(stay) == len(set(up.values())) and stay[0].__fields__ == clash.columns
    assert corpus_pipeline.near_duplicates(spark, clash.limit(0), "").count() == 0


def test_no_rows(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.first_of_each(empty).count() == 0
    assert line_dedup.dedup(empty).count() == 0


def test_components(spark):
    random.seed(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1001 + i) for i in range(200)] + [(random.randrange(2000, 2400), random.randrange(2000, 2400)) for _ in range(180)]
    expected = classes({x for p in links for x in p}, links)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: c for x, c in expected.items() if any(x in p and p[0] != p[1] for p in links)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(words, n):
    out = list(words)
    for _ in range(n):
        i, kind = random.randrange(len(out)), random.randrange(3)
        if kind == 0:
            out.insert(i, random.choice("abcd"))
        elif kind == 1:
            del out[i]
        else:
            out[i] = random.choice("abcd")
    return out


def near_words(a, b):
    limit = line_dedup.limit_of(min(len(a), len(b)))
    return limit > 0 and abs(len(a) - len(b)) <= limit and distance(a, b) <= limit


@pytest.mark.parametrize("least, most", [(10, 19), (20, 29), (30, 60)])
def test_banded_distance_and_segments(least, most):
    random.seed(least)
    pairs = []
    for _ in range(700):
        line = [random.choice("abcd") for _ in range(random.randint(least, most))]
        pairs.append((line, edited(line, random.randint(0, 5))))
    near = [near_words(a, b) for a, b in pairs]
    assert 100 < sum(near) < 650
    assert line_dedup.within([([ord(x) for x in a], [ord(x) for x in b]) for a, b in pairs]).tolist() == near
    for (a, b), ok in zip(pairs, near):
        if ok:
            long, short = (a, b) if len(a) >= len(b) else (b, a)
            keys = {(tuple(long[x:y]), seed) for x, y, seed in line_dedup.probes(len(long))[0]}
            every, own = line_dedup.probes(len(short))
            assert any((tuple(short[x:y]), seed) in keys for (x, y, seed), mine in zip(every, own) if mine)
            assert sum(own) == line_dedup.limit_of(len(short)) + 1


@pytest.mark.parametrize("few", [0, 10**9])
def test_few_pairs_and_many_are_judged_alike(few, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW", few)
    if few:
        monkeypatch.setattr(line_dedup, "_banded", None)  # a walk over columns costs the same for one pair as for many
    random.seed(12)
    lines = [[random.choice("abc") for _ in range(random.randint(10, 45))] for _ in range(400)]
    pairs = [(a, edited(a, random.randint(0, 4))) for a in lines]
    near = [near_words(a, b) for a, b in pairs]
    assert 100 < sum(near) < 390
    assert line_dedup.within([([ord(x) for x in a], [ord(x) for x in b]) for a, b in pairs]).tolist() == near


def test_hashes_of_runs_travel_in_rows_of_many(monkeypatch):
    random.seed(13)
    lines = sorted({" ".join(random.choice("abcdefgh") for _ in range(random.randint(9, 42))) for _ in range(3000)})
    batch = pa.record_batch([pa.array([*lines, *lines, None])], ["text"])
    expected = sum(len(line_dedup.probes(len(x.split()))[0]) for x in lines if len(x.split()) >= 10)
    monkeypatch.setattr(line_dedup, "BUCKET_BITS", 8)
    for held, letters in ((1, 1 << 20), (1 << 20, 1 << 20), (1 << 20, 100)):
        monkeypatch.setattr(line_dedup, "HELD", held)
        monkeypatch.setattr(line_dedup, "LETTERS", letters)
        found = pa.Table.from_batches(line_dedup._runs(line_dedup.MOST_EDITS)(iter([batch])))
        rows = [(b, np.frombuffer(k, np.uint64), len(i), len(o)) for b, k, i, o in zip(*(c.to_pylist() for c in found.columns))]
        assert len(rows) <= 256 * (25 if held == 1 else 1)
        assert sum(len(k) for _, k, _, _ in rows) == expected
        assert all((k >> np.uint64(56) == b).all() and i == 8 * len(k) and o == len(k) for b, k, i, o in rows)


def test_runs_of_the_same_words_have_one_hash():
    random.seed(14)
    lines = [[random.choice(["a", "b", "ab", "é"]).encode() for _ in range(random.randint(10, 40))] for _ in range(300)]
    seen = {}
    for few in (lines[:1], lines[1:], lines[::-1]):  # wherever they stand, in whatever company
        keys, counts, own = line_dedup._RunHashes(3).of([b" ".join(x) for x in few], list(map(len, few)))
        every = [(tuple(x[a:b]), seed) for x in few for a, b, seed in line_dedup.probes(len(x))[0]]
        assert len(every) == len(keys) == len(own) == counts.sum()
        assert all(seen.setdefault(run, k) == k for run, k in zip(every, keys.tolist()))
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("part_lines", [3, 1024])
def test_line_dedup(spark, messy, monkeypatch, part_lines):
    monkeypatch.setattr(line_dedup, "PART_LINES", part_lines)  # a segment that many lines share is dealt into parts
    random.seed(9)
    lines = [[random.choice("abcdefgh") for _ in range(random.randint(9, 42))] for _ in range(40)]
    lines += [lines[30][:8] + [random.choice("abcdefgh") for _ in range(20)] for _ in range(12)]
    rows = [(r["doc_id"], r["text"]) for r in messy.collect() if len(r["text"] or "") < 10_000]
    for i in range(120):
        own = [" ".join(edited(random.choice(lines), random.choice([0, 0, 1, 2, 3]))) for _ in range(4)]
        rows.append((100 + i, "\n".join([*own, "", "short"])))
    frame = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, n_lines int, _gone int").repartition(4)
    texts = sorted({x for _, t in rows for x in line_dedup._lines(t or "")})
    near = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1:] if near_words(a.split(), b.split())]
    assert len(near) > 100
    up = classes(texts, near)
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    first, expected, seen = {}, [], {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))):
        if (doc, text) in seen:
            expected.append(seen[doc, text])
            continue
        exact = close = n = 0
        docs, kept = set(), []
        for line in (text or "").split("\n"):
            raw = line.encode()
            if raw in up:
                n += 1
                if up[raw] in first:
                    where, what = first[up[raw]]
                    exact, close = exact + (what == raw), close + (what != raw)
                    docs |= {where} - {None}
                    continue
                first[up[raw]] = (doc, raw)
            kept.append(line)
        seen[doc, text] = (doc, None if text is None else "\n".join(kept), n, exact, close, sorted(docs))
        expected.append(seen[doc, text])
    result = line_dedup.dedup(frame)
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_exact"], r["n_near"], r["first_docs"]) for r in result.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert "_gone" in result.columns


def test_lines_with_one_word_changed(spark):
    random.seed(10)
    words = [f"word{i}" for i in range(400)]
    lines = [[random.choice(words) for _ in range(random.randint(12, 40))] for _ in range(60)]
    changed = [[*x[:5], "other" + str(i), *x[6:]] for i, x in enumerate(lines)]
    rows = [(i, " ".join(x)) for i, x in enumerate(lines)] + [(1000 + i, " ".join(x)) for i, x in enumerate(changed)]
    got = {r["doc_id"]: (r["n_near"], r["text"]) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (0, " ".join(x)) for i, x in enumerate(lines)) and all(got[1000 + i] == (1, "") for i in range(60))


def test_repeated_row_that_loses_lines(spark):
    import corpus_pipeline

    said = [f"line {i} that is said before" for i in range(5)]
    own = [f"words {chr(97 + i) * 30} of its own" for i in range(5)]
    rows = [(1, "\n".join(said)), *[(2, "\n".join(said + own))] * 3, *[(None, "\n".join(said[:2] + ["one more"]))] * 2]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_exact"], r["n_near"]) for r in line_dedup.dedup(frame).collect()]
    expected = [(1, rows[0][1], 5, 0, 0), *[(2, "\n".join(own), 10, 5, 0)] * 3, *[(None, "one more", 3, 2, 0)] * 2]
    assert sorted(got, key=str) == sorted(expected, key=str)
    kept = [(r["doc_id"], r["text"], r["n_chars"]) for r in corpus_pipeline.lines(spark, frame, "").collect()]
    assert sorted(kept, key=str) == sorted([(i, t, len(t)) for i, t, *_ in expected], key=str)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(60)]
    rows += [(500, None), (520, [1.0, None]), (540, [float("nan")] * 8), (560, [float("inf")] * 8), (None, [1.0] * 8), (580, []), (600, [0.5]), (620, [1e9] * 8), (20, rows[20][1])]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got = {}
    for r in topk_search.top_k(frame, (frame["vec_id"] % 20 == 0), k=20, pivots=6, query_rows=7, candidate_rows=90).collect():
        got.setdefault((r["query_id"], r["copy"]), []).append((r["rank"], r["vec_id"], r["score"]))
    lists = []
    for n, (i, q) in enumerate(good):
        if i % 20 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(good) if m != n)[:20]
            lists.append((i, [(k + 1, j, -s) for k, (s, j) in enumerate(ranked)]))
    assert sorted(lists) == sorted((key[0], sorted(found)) for key, found in got.items())
    assert topk_search.top_k(frame.limit(0), frame["vec_id"] % 20 == 0).count() == 0


def test_large_components(spark):
    rows = [(20, [1.0, 1.0]), (1, [1e18, 0.0]), (2, [1e19, 0.0]), (3, [1e20, 0.0]), (4, [-1e20, 0.0]), (5, [3e38, 1.0]), (6, [0.5, 0.25])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk_search.top_k(frame, frame["vec_id"] % 20 == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [5, 3, 2, 1, 6, 4]
    exact = {i: sum(int(np.floor(64 * a)) * int(np.floor(64 * b)) for a, b in zip(v, rows[0][1])) for i, v in rows[1:]}
    assert all(r["score"] == min(max(exact[r["vec_id"]], -2**63), 2**63 - 1) for r in found)


def test_products_are_counted_whole():
    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(size=(3000, 64)) * 64)  # bounds say nothing here
    _, _, evaluated = topk_search.search_block(rows[:5], rows, np.arange(3000), np.arange(5), 10, 8)
    assert evaluated >= 5 * 2999


def test_few_products_are_evaluated():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 6)) * 400
    rows = np.floor(np.repeat(centres, 200, 0) + rng.normal(size=(6000, 6)) * 5)
    _, _, evaluated = topk_search.search_block(rows[:40], rows, np.arange(6000), np.arange(40), 10, 24)
    assert evaluated < 40 * 6000 / 4


@pytest.mark.parametrize("rows", ["random", "clustered", "tied"])
def test_search_block_equals_brute_force(rows):
    rng = np.random.default_rng(15)
    centres = np.repeat(rng.normal(size=(40, 8)) * 400, 100, 0)
    x = {"random": rng.normal(size=(4000, 24)) * 20, "clustered": centres + rng.normal(size=(4000, 8)) * 5, "tied": rng.integers(0, 2, size=(4000, 5))}[rows]
    x, ids = np.floor(x.astype(float)), rng.permutation(4000)
    own = np.where(np.arange(300) % 3 == 0, -1, np.arange(300))
    best, scores, _ = topk_search.search_block(x[:300], x, ids, own, 20, 32)
    for i in range(300):
        order = [j for j in np.lexsort((ids, -(x @ x[i]))) if j != own[i]][:20]
        assert best[i].tolist() == order and scores[i].tolist() == (x[order] @ x[i]).astype(int).tolist()


def test_queries_without_use_of_bounds_do_not_compute_them_for_every_row():
    rng = np.random.default_rng(16)
    x = np.floor(rng.normal(size=(16384, 64)) * 10)
    table = np.sqrt((x[:, :32] ** 2).copy())
    began = time.process_time()
    for i in range(300):
        bound = np.zeros(len(x))
        for p in range(32):
            np.maximum(bound, np.abs(table[:, p] - table[i, p]), out=bound)
    bounds = time.process_time() - began
    began = time.process_time()
    topk_search.search_block(x[:300], x, np.arange(len(x)), np.arange(300), 20, 32)
    assert time.process_time() - began < bounds


def test_pipeline(spark, messy):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(9000, None, None, None, None), (None, "", "en", None, 0), (9001, docs.first()["text"], None, "s", 5)], docs.schema)
    kept = docs.unionByName(odd)
    counts = [kept.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, kept, folder), f"test-{name}")
        assert after.columns == docs.columns, name
        counts.append(after.count())
        assert after.select("doc_id").exceptAll(kept.select("doc_id")).count() == 0
        kept = after
    assert counts == sorted(counts, reverse=True) and counts[-1] > 50
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, folder)
    assert packed.select("doc_id").distinct().count() == kept.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
