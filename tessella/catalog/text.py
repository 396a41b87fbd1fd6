"""Text: cleaning, sentences, n-gram words per source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.catalog.base import Tables, query, rounded
from tessella.functions import columns as C
from tessella.operators import boundaries, words
from tessella.session import cut

STOP_WORDS = ("the", "of", "and", "to", "in", "for", "der", "die", "und", "le", "la", "les", "de", "el", "que")
# DuckDB and Spark count the ASCII white space below as white space
SPACE = r"[ \t\n\f\r\x0B]"


@query(rf"""
    SELECT doc_id, array_to_string(list_filter(
        list_transform(string_split_regex(text, '{SPACE}+'), lambda x: lower(regexp_replace(x, '[^\w\s]|http\S+|\d+|[A-Z][a-z]+', '', 'g'))),
        lambda x: x <> '' AND NOT list_contains({list(STOP_WORDS)}, x)), ' ') AS clean
    FROM documents""")
def text_clean(t: Tables) -> DataFrame:
    return words.clean_text(t.documents.select("doc_id", "text"), "text", stop_words=STOP_WORDS).drop("text")


@query(rf"""
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_no, array_to_string(list_filter(
        list_transform(string_split_regex(s, '{SPACE}+'), lambda x: lower(regexp_replace(x, '[^\w\s]|http\S+|\d+|[A-Z][a-z]+', '', 'g'))),
        lambda x: x <> '' AND NOT list_contains({list(STOP_WORDS)}, x)), ' ') AS sentence
    FROM (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (
        SELECT doc_id, string_split(regexp_replace(text, '([.!?]){SPACE}+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents))""")
def sentences(t: Tables) -> DataFrame:
    return words.clean_sentences(t.documents, "text", ["doc_id"], stop_words=STOP_WORDS)


@query("SELECT doc_id, regexp_replace(text, '[0-9]+', '', 'g') AS text FROM documents")
def remove_pattern(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", C.remove_pattern("text", "[0-9]+").alias("text"))


def _grams(n: int, source: str, group: str) -> str:
    following = " || ' ' || ".join(["w", *[f"lead(w, {i}) OVER o" for i in range(1, n)]])
    return rf"""
    SELECT {group}, ngram FROM (
        SELECT {group}, {following} AS ngram FROM (
            SELECT {group}, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (
                SELECT {group}, string_split_regex(lower(string_agg(text, ' ' ORDER BY doc_id)), '{SPACE}') AS w FROM {source} GROUP BY {group}))
        WINDOW o AS (PARTITION BY {group} ORDER BY i))
    WHERE ngram IS NOT NULL"""


def _top_words(n: int, group: str) -> str:
    return rf"""
    WITH counts AS (SELECT {group}, ngram, count(*) AS tf FROM ({_grams(n, 'documents', group)}) GROUP BY ALL),
    m AS (SELECT count(DISTINCT {group}) AS m FROM documents WHERE text IS NOT NULL),
    terms AS (SELECT ngram, count(*) AS df, sum(tf) AS total FROM counts GROUP BY ngram
              HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT m FROM m) ORDER BY total DESC, ngram LIMIT 10000),
    scored AS (SELECT {group}, ngram, tf * ln((m + 1.0) / (df + 1.0)) AS tfidf FROM counts JOIN terms USING (ngram), m)
    SELECT {group}, CAST(rank AS INTEGER) AS rank, ngram, round(tfidf, 6) AS tfidf FROM (
        SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY round(tfidf, 9) DESC, ngram) AS rank FROM scored) WHERE rank <= 10"""


@query(_top_words(3, "source"))
def ngram_tfidf_topn(t: Tables) -> DataFrame:
    """The ten word triples that stand out in each source, texts of a source read in order of their id."""
    return rounded(words.top_words(t.documents, "source", ["doc_id"], "text", n=3), ["tfidf"], 6)


@query(_top_words(4, "lang"))
def ngram_tfidf_four(t: Tables) -> DataFrame:
    return rounded(words.top_words(t.documents, "lang", ["doc_id"], "text", n=4), ["tfidf"], 6)


@query(rf"""
    SELECT lang, ngram, count(*) AS tf FROM ({_grams(2, 'documents', 'lang')}) GROUP BY ALL""")
def ngram_counts(t: Tables) -> DataFrame:
    return words.group_ngrams(t.documents, "lang", ["doc_id"], "text", n=2)


@query(rf"""
    SELECT lang, ngram, count(*) AS tf FROM ({_grams(2, 'documents', 'lang').replace('ORDER BY doc_id', "ORDER BY 'case-' || lpad(doc_id::VARCHAR, 12, '0')")}) GROUP BY ALL""")
def ngram_counts_text_key(t: Tables) -> DataFrame:
    """Word pairs of each language, texts read in order of a key that is text."""
    rows = t.documents.withColumn("case", F.concat(F.lit("case-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")))
    return words.group_ngrams(rows, "lang", ["case"], "text", n=2)


@query("""
    SELECT conv_id, turn, word AS sentence, n AS embedding FROM (
        SELECT conv_id, turn, unnest(w) AS word, unnest(list_transform(w, lambda x: len(x))) AS n
        FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations))""")
def zip_explode(t: Tables) -> DataFrame:
    """Two arrays of one row side by side, one row per position."""
    rows = t.conversations.select("conv_id", "turn", F.split("text", " ").alias("w"))
    rows = rows.withColumn("n", F.transform("w", lambda x: F.length(x).cast("long")))
    return words.zip_explode(rows, ["conv_id", "turn"], "w", "n")


def _bare(x: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({x}, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}.]+$', ''))"


def _has_dot(w: str) -> str:
    return f"({w} LIKE '%.' AND {w} NOT LIKE '%..')"


def _stem(w: str) -> str:
    return f"(CASE WHEN {_has_dot(w)} THEN left({w}, -1) ELSE {w} END)"


WORDS_SQL = rf"""
    toks AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
        SELECT doc_id, {_bare('x')} AS w, i FROM (
            SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '{SPACE}+') AS p FROM documents))) WHERE w <> ''),
    counts AS (SELECT {_stem('w')} AS word, count(*) FILTER ({_has_dot('w')}) AS n_dotted, count(*) FILTER (NOT {_has_dot('w')}) AS n_plain FROM toks GROUP BY 1),
    whole AS (SELECT sum(n_dotted + n_plain)::DOUBLE AS n, sum(n_dotted)::DOUBLE AS dots FROM counts),
    abbr AS (SELECT word, n_dotted, n_plain, score FROM (
        SELECT word, n_dotted, n_plain,
            2 * (n_dotted * ln(0.99 / (dots / n)) + n_plain * ln(0.01 / (1 - dots / n)))
            * exp(-(length(word) - periods)) * (periods + 1) * pow((length(word) - periods)::DOUBLE, -n_plain::DOUBLE) AS score
        FROM (SELECT *, length(word) - length(replace(word, '.', '')) AS periods FROM counts, whole WHERE n_dotted > 0 AND regexp_matches(word, '\p{{L}}'))) WHERE score >= 0.3)"""
COLLOCATIONS_SQL = rf"""
    pairs AS (SELECT {_stem('w')} AS word, {_stem('f')} AS following, count(*)::DOUBLE AS k FROM (
        SELECT w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS f FROM toks) WHERE f IS NOT NULL AND regexp_full_match(w, '(\p{{L}}|\p{{N}}+)\.') GROUP BY 1, 2),
    sized AS (SELECT pairs.*, (a.n_dotted + a.n_plain)::DOUBLE AS c1, (b.n_dotted + b.n_plain)::DOUBLE AS c2, n FROM pairs
        JOIN counts a ON a.word = pairs.word JOIN counts b ON b.word = pairs.following, whole WHERE k > 1),
    coll AS (SELECT word, following, k::BIGINT AS n, score FROM (SELECT *, 2 * (
            k * ln(k / c1) + CASE WHEN c1 > k THEN (c1 - k) * ln(1 - k / c1) ELSE 0 END
            + CASE WHEN c2 > k THEN (c2 - k) * ln((c2 - k) / (n - c1)) ELSE 0 END
            + CASE WHEN n - c1 > c2 - k THEN (n - c1 - c2 + k) * ln(1 - (c2 - k) / (n - c1)) ELSE 0 END
            - k * ln(c2 / n) - (c1 - k) * ln(1 - c2 / n)
            - (c2 - k) * ln(c2 / n) - (n - c1 - c2 + k) * ln(1 - c2 / n)) AS score
        FROM sized WHERE n > c1 AND k * n > c1 * c2) WHERE score >= 7.88)"""


@query(f"WITH {WORDS_SQL} SELECT word, n_dotted, n_plain, round(score, 6) AS score FROM abbr")
def abbreviations(t: Tables) -> DataFrame:
    """Words of the documents whose period is their own, with the figures that say so."""
    return rounded(boundaries.abbreviations(cut(boundaries.word_counts(t.documents, "text"))), ["score"], 6)


@query(f"WITH {WORDS_SQL}, {COLLOCATIONS_SQL} SELECT word, following, n, round(score, 4) AS score FROM coll")
def collocations(t: Tables) -> DataFrame:
    """Words that belong to the number or initial with a period in front of them."""
    return rounded(boundaries.collocations(t.documents, "text", cut(boundaries.word_counts(t.documents, "text"))), ["score"], 4)


@query(rf"""
    WITH {WORDS_SQL}, {COLLOCATIONS_SQL},
    pieces AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (
        SELECT doc_id, string_split(regexp_replace(text, '([.!?])({SPACE})', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM documents)),
    ends AS (SELECT *, {_bare(f"string_split_regex(x, '{SPACE}+')[-1]")} AS last, {_bare(f"coalesce(string_split_regex(x, '{SPACE}+')[2], '')")} AS first FROM pieces),
    seen AS (SELECT *, lag(last) OVER d AS before, lag(x) OVER d AS left_x FROM ends WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    cuts AS (SELECT *, i > 1 AND left_x LIKE '%.' AND {_has_dot('before')} AND (
        {_stem('before')} IN (SELECT word FROM abbr) OR {_stem('before')} || ' ' || {_stem('first')} IN (SELECT word || ' ' || following FROM coll)) AS held FROM seen),
    numbered AS (SELECT *, sum(CASE WHEN held THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM cuts)
    SELECT doc_id, CAST(s - 1 AS INTEGER) AS sentence_no, regexp_replace(string_agg(x, '' ORDER BY i), '^{SPACE}+', '') AS sentence FROM numbered GROUP BY doc_id, s""")
def sentences_by_statistics(t: Tables) -> DataFrame:
    """Whole sentences of the documents, cut where the documents' own statistics see no abbreviation."""
    return boundaries.split_sentences(t.documents, "text", ["doc_id"])
