"""The queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.catalog.base import Tables
from tessella.llm import chat, line_dedup, packing, periodic, quality_classifier, quality_rules, sentencepiece_codec, simhash, token_files, tokens, topk_search, trie, url_filter, warc
from tessella.llm.common import WORD, new_folder, written

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def model_text(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@query
def op1_sentencepiece(t: Tables) -> DataFrame:
    """Ids of every document by the merge-type model, decoded again."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(t.documents.select("doc_id", "text"), path), path)
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op6_token_files(t: Tables) -> DataFrame:
    """Ids of every document written as directly addressable codes and read back."""
    model, path = t.spark.sparkContext.broadcast(model_text("word_bpe_49k.json")), new_folder(t.spark, "token-files")
    token_files.write(t.documents, path, lambda: tokens.word_encoder("word_bpe_49k", model.value), end_id=2)
    return token_files.documents(t.spark.read.parquet(path), "ids_crc32 long", lambda ids: [zlib.crc32(ids.tobytes())])


@query
def op9_packing(t: Tables) -> DataFrame:
    """Every document's pieces with their place in sequences of 2048 tokens."""
    return packed(t.documents)


def packed(docs: DataFrame, size: int = 2048) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(model_text("byte_bpe_50k.json"))
    cut = packing.pieces(docs, lambda: tokens.byte_encoder("byte_bpe_50k", model.value), end_id=1, size=size)
    return packing.assign(written(cut, "pieces"), size).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query
def op4_quality_rules(t: Tables) -> DataFrame:
    """Measures and verdict of every document."""
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    judged = quality_rules.judge(t.documents.select("doc_id", "text"))
    return judged.select("doc_id", *columns, *[c for c in quality_rules.MEASURES if c not in columns])


ORACLES["op4_quality_rules"] = quality_rules.oracle_sql()


@query
def op2_simhash(t: Tables) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(t.documents)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality_classifier.Model:
    """Learnt from the labels of all rows but the held-out ones."""
    return quality_classifier.fit(docs, labels.where(~held_out()), "quality")


@query
def op8_quality_classifier(t: Tables) -> DataFrame:
    """Quality score of every document."""
    docs = t.documents.select("doc_id", "text")
    scored = quality_classifier.score(docs, quality_model(docs, t.labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op5_line_dedup(t: Tables) -> DataFrame:
    """Every document without the lines that are there already, and where those lines stay."""
    return line_dedup.dedup(t.documents.select("doc_id", "text")).select("doc_id", "n_lines", "n_exact", "n_near", "first_docs", "text")


@query
def op10_topk_search(t: Tables) -> DataFrame:
    """The 20 highest inner products for every twentieth vector."""
    return topk_search.top_k(t.embeddings, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score")


ORACLES["op10_topk_search"] = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (
        SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e)::bigint AS score
        FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0
    )
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank, vec_id, score
    FROM s QUALIFY rank <= 20
"""


@query
def op7_chat_preferences(t: Tables) -> DataFrame:
    """Prompt and masked completions of every pair of neighbouring conversations."""
    runs = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws(":", r["n_chars"], r["train"].cast("int"))), " ").alias(c)
    pairs = chat.preferences(chat.neighbours(t.conversations))
    return pairs.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", "prompt", "chosen", "rejected", runs("chosen_mask"), runs("rejected_mask"))


ORACLES["op7_chat_preferences"] = """
    WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    n AS (SELECT *, conv_id >> 1 AS pair_id, conv_id % 2 AS side, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
    c AS (
        SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.k, b.k) AS k, a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
        FROM (SELECT * FROM n WHERE side = 0) a FULL JOIN (SELECT * FROM n WHERE side <> 0) b ON a.pair_id = b.pair_id AND a.k = b.k
    ),
    l AS (SELECT pair_id, coalesce(min(k) FILTER (NOT same) - 1, max(k)) AS lcp FROM c GROUP BY pair_id),
    r AS (
        SELECT n.*, lcp, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown,
            (length(role) + 13) || ':0 ' || (length(text) + 11) || ':' || (role = 'assistant')::int AS runs
        FROM n JOIN l USING (pair_id)
    )
    SELECT pair_id, max(conv_id) FILTER (side = 0) AS chosen_id, max(conv_id) FILTER (side <> 0) AS rejected_id, max(lcp)::bigint AS n_prompt_turns,
        coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 0 AND k <= lcp), '') AS prompt,
        coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 0 AND k > lcp), '') AS chosen,
        coalesce(string_agg(shown, '' ORDER BY k) FILTER (side <> 0 AND k > lcp), '') AS rejected,
        coalesce(string_agg(runs, ' ' ORDER BY k) FILTER (side = 0 AND k > lcp), '') AS chosen_mask,
        coalesce(string_agg(runs, ' ' ORDER BY k) FILTER (side <> 0 AND k > lcp), '') AS rejected_mask
    FROM r GROUP BY pair_id
"""


URL_RULES = [url_filter.rule(*r) for r in (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)]


@query
def op3_url_filter(t: Tables) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    words = url_filter.word_counts(t.pages, "html")
    return url_filter.judge(t.pages.select("page_id", "url"), URL_RULES, words).select("page_id", "host", "path", "rule", "verdict")


def with_repeats(doc_id: str, text: str) -> tuple[Column, Column, Column]:
    """Hash of the id, the words of the text, and those of ``_words`` as one text, repeated from one place on."""
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    n = F.size("_words")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    word = lambda i: F.get("_words", F.when(i < a, i).otherwise(a + (i - a) % p))
    return h, words, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")


@query
def op13_periodic_runs(t: Tables) -> DataFrame:
    """Periodic runs of every document, and the document without what they repeat."""
    h, words, repeated = with_repeats("doc_id", "text")
    docs = t.documents.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_words"))
    docs = docs.select("doc_id", F.when(F.size("_words") > 0, repeated).otherwise(F.col("text")).alias("text"))
    found = periodic.collapse(docs)
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length, r.start, r.period)))")
    listed = F.array_join(F.expr("transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n')"), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("l"), listed.alias("_listed"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", F.col("l.start").alias("start"), (-F.col("l.col1")).alias("length"), F.col("l.period").alias("period"),
        F.floor(1000 * -F.col("l.col1") / F.col("l.period")).alias("exponent_milli"),
        F.sha2(F.col("_listed").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op11_warc(t: Tables) -> DataFrame:
    """Every page's record, written to a content-addressed archive and read back."""
    path = new_folder(t.spark, "archive")
    warc.write(t.pages, path)
    found = warc.parsed(warc.records(t.spark, path))
    return found.select(
        warc.page_of("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", warc.page_of("refers_to").alias("refers_to"), "target_uri",
    )


ORACLES["op11_warc"] = """
    WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, url, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to,
        replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS target_uri
    FROM f
"""


def borrowed() -> Column:
    """How many turns a conversation takes from the first one of its twenty."""
    return F.crc32(F.col("conv_id").cast("string")) % 4


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations, each with the first turns of another one before its own."""
    sizes = written(placed.groupBy("conv_id").agg((F.max("pos") + 1).alias("n")), "sizes")
    lent = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    base = F.col("conv_id") - F.col("conv_id") % 20
    shape = sizes.withColumns({"h": borrowed(), "base": base}).join(lent, "base", "left")
    shape = written(shape.withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0)))).select("conv_id", "base", "h", "m", "n"), "shape")
    heads = placed.where((F.col("pos") < 3) & (F.col("conv_id") % 20 == 0)).withColumnRenamed("conv_id", "base")
    taken = shape.select("conv_id", "base", "m").join(heads, "base").where("pos < m").select("conv_id", "pos", "h1", "h2", "words")
    moves = shape.select("conv_id", (F.col("m") - F.col("h")).alias("by"))
    own = placed.where(F.col("pos") >= borrowed()).join(moves, "conv_id").select("conv_id", (F.col("pos") + F.col("by")).alias("pos"), "h1", "h2", "words")
    convs = shape.select("conv_id", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    return written(taken.unionByName(own), "rebuilt"), convs


@query
def op12_prefix_trie(t: Tables) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    return trie.nodes(*rebuilt(trie.turns(t.conversations)))


ORACLES["op12_prefix_trie"] = """
    WITH own AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ),
    n AS (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id),
    b AS (
        SELECT conv_id, n, xor(4294967295, list_reduce(
            list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
            lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda r, z: xor(r >> 1, (r & 1) * 3988292384))
        )) % 4 AS h FROM n
    ),
    h AS (SELECT b.*, least(h, coalesce(n.n, 0)) AS m FROM b LEFT JOIN n ON n.conv_id = b.conv_id - b.conv_id % 20),
    r AS (
        SELECT h.conv_id, pos + 1 AS d, role, text FROM h JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 20 AND pos < m
        UNION ALL SELECT conv_id, pos - h + m + 1, role, text FROM own JOIN h USING (conv_id) WHERE pos >= h
    ),
    k AS (
        SELECT conv_id, d, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key,
            len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
        FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM h
    ),
    e AS (SELECT conv_id, max(d) AS ended FROM k GROUP BY conv_id),
    g AS (
        SELECT d, key, min(conv_id) AS rep, count(*) AS n, (count(*) - 1) * max(words) AS worth, string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (d = ended) AS ends
        FROM k JOIN e USING (conv_id) GROUP BY d, key
    ),
    j AS (SELECT conv_id, d, key, rep FROM k JOIN g USING (d, key)),
    p AS (SELECT g.*, j.rep AS parent, j.key AS parent_key FROM g LEFT JOIN j ON j.conv_id = g.rep AND j.d = g.d - 1),
    c AS (SELECT d - 1 AS d, parent_key AS key, count(*) AS n_children FROM p WHERE d > 0 GROUP BY ALL),
    v AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN c USING (d, key)),
    s AS (SELECT j.d, j.key, count(*) FILTER (n_children = 0) AS n_leaves, sum(worth) AS saved FROM j JOIN v ON v.rep = j.conv_id AND v.d >= j.d GROUP BY j.d, j.key)
    SELECT rep AS conv_id, d::bigint AS depth, parent AS parent_conv_id, n::bigint AS n_convs, n_children::bigint AS n_children, n_leaves::bigint AS n_leaves,
        saved::bigint AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
    FROM v JOIN s USING (d, key)
"""
