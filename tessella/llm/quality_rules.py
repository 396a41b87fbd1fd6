"""Quality rules: one table of thresholds, compiled to one projection of built-in functions.

A rule bounds the ratio of two measures of a text. Ratios are compared in thousandths of whole
numbers, so Spark and any SQL engine agree to the last digit. The measures are built-in functions
too; windows of three words are sorted within the row, so no text leaves its task.

Defined results: a null text is an empty one; a text without words fails the base rule and no ratio
is asked of it. Rows are independent, so ties and repeated rows need no rule, and an empty table gives
an empty table. Other columns stay; columns named like a measure or verdict are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import plain_name

# fixed values: frequent function words of English, French, German and Spanish
STOP_WORDS = (
    "the of and to in a is that for it with as was on be by this are or from at "
    "le la les de des du un une et en est que qui dans pour par sur au avec ce "
    "der die das und den dem von zu mit ist ein eine für auf im nicht sich des "
    "el los las del y una con por para se su lo como"
).split()
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
SPACES = r"\x20\x09-\x0D"


class Rule(NamedTuple):
    """``low <= 1000 * part / whole <= high``; a bound that is None is not asked."""

    name: str
    part: str
    whole: str
    low: int | None
    high: int | None

    def sql(self) -> str:
        """The rule as SQL over the measures; it holds where the whole is 0."""
        tests = [f"1000 * {self.part} >= {self.low} * {self.whole}"] if self.low is not None else []
        tests += [f"1000 * {self.part} <= {self.high} * {self.whole}"] if self.high is not None else []
        return "(" + " AND ".join(tests) + ")"


RULES = (
    Rule("word length", "word_chars", "n_words", 2_000, 12_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("stop words", "n_stop_words", "n_words", 15, None),
    Rule("capitals", "n_capitals", "word_chars", None, 300),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 400),
    Rule("open-ended lines", "n_open_lines", "n_lines", None, 300),
    Rule("bullet lines", "n_bullet_lines", "n_lines", None, 900),
)
BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_capitals", "n_lines", "n_open_lines", "n_bullet_lines")


def verdict_sql(rules: tuple[Rule, ...] = RULES, base_failed: str = BASE_FAILED) -> str:
    return f"(NOT {base_failed} AND " + " AND ".join(r.sql() for r in rules) + ")"


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of column ``text``."""
    t, w, lines, grams, order, twice = (plain_name(df, n) for n in ("_t", "_w", "_lines", "_grams", "_order", "_twice"))
    out = df.withColumn(t, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    out = out.withColumn(w, F.split(F.expr(f"trim(BOTH ' \\t\\n\\u000B\\f\\r' FROM `{t}`)"), f"[{SPACES}]+"))
    out = out.withColumn(w, F.when(F.col(w)[0] == "", F.array().cast("array<string>")).otherwise(F.col(w)))
    out = out.withColumns({
        lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACES}]")),
        grams: F.expr(f"""CASE WHEN size(`{w}`) < 3 THEN CAST(array() AS array<string>)
            ELSE transform(sequence(0, size(`{w}`) - 3), i -> concat_ws(' ', `{w}`[i], `{w}`[i + 1], `{w}`[i + 2])) END"""),
    })
    # places of the windows in order of their words, where some window is there twice: a window's words
    # hold no space, so equal windows stand side by side however their places sort
    out = out.withColumn(order, F.expr(f"""CASE WHEN size(array_distinct(`{grams}`)) = size(`{grams}`) THEN CAST(array() AS array<int>)
        ELSE transform(array_sort(transform(`{grams}`, (g, i) -> concat(g, ' ', lpad(CAST(i AS string), 10, '0')))),
            s -> CAST(substring(s, -10) AS int)) END"""))
    # always true, but not for the optimizer: it would else paste these steps into each other below a
    # filter on the verdict and evaluate them again for every element
    once = F.monotonically_increasing_id() >= 0
    out = out.withColumn(twice, F.when(once, F.expr(f"""array_sort(filter(`{order}`, (p, k) ->
        (k > 0 AND `{grams}`[p] = `{grams}`[`{order}`[greatest(k - 1, 0)]])
        OR (k + 1 < size(`{order}`) AND `{grams}`[p] = `{grams}`[`{order}`[least(k + 1, size(`{order}`) - 1)]])))""")))
    return out.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": _count(F.col(t), SYMBOLS),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.expr(f"""aggregate(transform(`{twice}`, (p, k) -> least(3, coalesce(get(`{twice}`, k + 1) - p, 3))),
            CAST(0 AS bigint), (a, x) -> a + x)"""),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long"),
        "n_capitals": _count(F.col(t), CAPITALS),
        "n_lines": F.size(lines).cast("long"),
        "n_open_lines": F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))).cast("long"),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("• "))).cast("long"),
    }).drop(t, w, lines, grams, order, twice)


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base_failed: str = BASE_FAILED) -> DataFrame:
    """Add the measures, ``base_failed`` and ``kept``."""
    return measures(df, text).withColumns({"base_failed": F.expr(base_failed), "kept": F.expr(verdict_sql(rules, base_failed))})


def oracle_sql(table: str = "documents") -> str:
    """The same measures and verdicts in DuckDB's SQL, by ``doc_id``."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM {table}),
    p AS (
        SELECT doc_id, text, regexp_extract_all(text, '[^{SPACES}]+') AS w,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACES}]')) AS l
        FROM t
    ),
    g AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM p WHERE len(w) >= 3),
    s AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM g),
    d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM s) WHERE n > 1),
    c AS (
        SELECT doc_id, sum(least(3, coalesce(nxt - i, 3)))::bigint AS n_repeat_words
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d) GROUP BY doc_id
    ),
    m AS (
        SELECT p.doc_id, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars,
            (length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')))::bigint AS n_symbols,
            (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines, coalesce(n_repeat_words, 0)::bigint AS n_repeat_words,
            len(list_filter(w, lambda x: x IN ({stops})))::bigint AS n_stop_words,
            (length(text) - length(regexp_replace(text, '[{CAPITALS}]', '', 'g')))::bigint AS n_capitals,
            len(l)::bigint AS n_lines,
            len(list_filter(l, lambda x: suffix(x, '...') OR suffix(x, '…')))::bigint AS n_open_lines,
            len(list_filter(l, lambda x: starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, '• ')))::bigint AS n_bullet_lines
        FROM p LEFT JOIN c ON p.doc_id IS NOT DISTINCT FROM c.doc_id
    )
    SELECT *, {BASE_FAILED} AS base_failed, {verdict_sql()} AS kept FROM m
    """
