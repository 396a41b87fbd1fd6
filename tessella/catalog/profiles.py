"""Profiles, quantiles, histograms and correlation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.catalog.base import Tables, query, rounded
from tessella.operators import profile, rollup, vectors, words
from tessella.operators.explain import stratified_split as split_by_class
from tessella.operators.forecast import regression_metrics as errors
from tessella.operators.vectors import standardize as scale

LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY ALL")
def count_by_sorted(t: Tables) -> DataFrame:
    return rollup.count_by(t.lineitem, ["l_returnflag", "l_linestatus"])


@query("""
    WITH cells AS (SELECT unnest(['p_name', 'p_brand', 'p_type']) AS "column", unnest([p_name, p_brand, p_type]) AS value FROM part),
         counts AS (SELECT "column", value, count(*) AS count FROM cells WHERE value IS NOT NULL GROUP BY ALL)
    SELECT "column", value, count, CAST(rank AS INTEGER) AS rank, distinct_values FROM (
        SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank,
               count(*) OVER (PARTITION BY "column") AS distinct_values FROM counts)
    WHERE (distinct_values <= 10 AND rank <= 10) OR rank <= 5""")
def value_counts_topk(t: Tables) -> DataFrame:
    return profile.value_counts(t.part.select("p_name", "p_brand", "p_type"))


@query("""
    SELECT 'c_name' AS "column", count(DISTINCT c_name) AS distinct_values, count(DISTINCT c_name) = count(*) AS is_unique_key FROM customer
    UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), count(DISTINCT c_mktsegment) = count(*) FROM customer""")
def distinct_profile(t: Tables) -> DataFrame:
    return profile.distinct_profile(t.customer)


@query("SELECT DISTINCT o_orderpriority FROM orders")
def distinct_values(t: Tables) -> DataFrame:
    return rollup.distinct_values(t.orders, "o_orderpriority")


MISSING = "SELECT documents.doc_id, lang, quality, toxic FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id"


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing, round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS share FROM ({MISSING})"
    for c in ("doc_id", "lang", "quality", "toxic")))
def missing_profile(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return rounded(profile.missing_profile(rows), ["share"], 6)


def _describe_sql(column: str, extra: str = "", group: str = "") -> str:
    return f"""
    SELECT {extra} '{column}' AS "column", count({column}) AS count, round(avg({column}), 4) AS mean, round(stddev_samp({column}), 4) AS std,
           min({column}) AS min, round(quantile_cont({column}, 0.25), 4) AS p25, round(quantile_cont({column}, 0.5), 4) AS p50,
           round(quantile_cont({column}, 0.75), 4) AS p75, max({column}) AS max FROM lineitem {group}"""


@query(" UNION ALL ".join(_describe_sql(c) for c in LINE_NUMBERS))
def describe_numeric(t: Tables) -> DataFrame:
    return rounded(profile.describe(t.lineitem, LINE_NUMBERS), ["mean", "std", "p25", "p50", "p75"])


@query(_describe_sql("l_extendedprice", "l_returnflag,", "GROUP BY l_returnflag"))
def describe_by_class(t: Tables) -> DataFrame:
    return rounded(profile.describe(t.lineitem, ["l_extendedprice"], by="l_returnflag"), ["mean", "std", "p25", "p50", "p75"])


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS distinct_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def multi_value_keys(t: Tables) -> DataFrame:
    return profile.multi_value_keys(t.orders, "o_custkey", "o_orderpriority")


@query("""
    SELECT *, distinct_keys = distinct_with_others AS is_key FROM (
        SELECT count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_keys,
               count(DISTINCT (l_orderkey, l_linenumber, l_partkey)) AS distinct_with_others FROM lineitem)""")
def key_check(t: Tables) -> DataFrame:
    return profile.key_check(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_partkey"])


PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


@query(" UNION ALL ".join(
    f"SELECT '{LINE_NUMBERS[i]}' AS \"left\", '{LINE_NUMBERS[j]}' AS \"right\", {i} AS i, {j} AS j, round(corr({LINE_NUMBERS[i]}, {LINE_NUMBERS[j]}), 6) AS r FROM lineitem"
    for i, j in PAIRS))
def correlation_pairs(t: Tables) -> DataFrame:
    return rounded(profile.correlation_pairs(t.lineitem, LINE_NUMBERS), ["r"], 6)


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS \"row\", '{b}' AS \"column\", round(corr({a}, {b}), 6) AS r FROM lineitem" for a in LINE_NUMBERS for b in LINE_NUMBERS))
def correlation_matrix(t: Tables) -> DataFrame:
    return rounded(profile.correlation_matrix(t.lineitem, LINE_NUMBERS), ["r"], 6)


@query("""
    SELECT "column", position FROM (
        SELECT 'p_retailprice' AS "column", 2 AS position, greatest(abs(corr(p_partkey, p_retailprice)), abs(corr(p_size, p_retailprice))) AS r FROM part
        UNION ALL SELECT 'p_size', 1, abs(corr(p_partkey, p_size)) FROM part)
    WHERE r > 0.4""")
def high_correlation(t: Tables) -> DataFrame:
    return profile.high_correlation(t.part, ["p_partkey", "p_size", "p_retailprice"], 0.4)


@query("""
    SELECT l_returnflag, unnest([0.05, 0.5, 0.95])::DOUBLE AS prob,
           round(unnest(quantile_cont(l_extendedprice, [0.05, 0.5, 0.95])), 4) AS quantile FROM lineitem GROUP BY l_returnflag""")
def quantiles(t: Tables) -> DataFrame:
    return rounded(profile.quantiles(t.lineitem, "l_extendedprice", [0.05, 0.5, 0.95], by=["l_returnflag"]), ["quantile"])


@query("""
    SELECT l_returnflag, l_linestatus, bucket, count(*) AS count FROM (
        SELECT l_returnflag, l_linestatus, CASE WHEN l_extendedprice < a THEN 0 WHEN l_extendedprice < b THEN 1 ELSE 2 END AS bucket
        FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.75) AS a, quantile_cont(l_extendedprice, 0.95) AS b FROM lineitem)
        WHERE l_discount >= 0.05)
    GROUP BY ALL""")
def quantile_buckets(t: Tables) -> DataFrame:
    marked = profile.quantile_buckets(t.lineitem.where("l_discount >= 0.05"), "l_extendedprice", source=t.lineitem)
    return profile.pattern_count(marked, ["l_returnflag", "l_linestatus", "bucket"])


HISTOGRAM = """
    SELECT l_returnflag, bin, round(low + bin * (high - low) / 10, 4) AS low_edge, round(low + (bin + 1) * (high - low) / 10, 4) AS high_edge,
           coalesce(count, 0) AS count
    FROM (SELECT l_returnflag, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1)
    CROSS JOIN (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin)
    LEFT JOIN (SELECT l_returnflag, CAST(least(floor((l_extendedprice - low) * 10 / (high - low)), 9) AS INTEGER) AS bin, count(*) AS count
               FROM lineitem JOIN (SELECT l_returnflag, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1)
               USING (l_returnflag) GROUP BY 1, 2) USING (l_returnflag, bin)"""


@query(HISTOGRAM)
def class_histogram(t: Tables) -> DataFrame:
    return rounded(profile.class_histogram(t.lineitem, "l_extendedprice", "l_returnflag"), ["low_edge", "high_edge"])


@query(f"""
    SELECT l_returnflag, bin, count, round(1e6 * count / (sum(count) OVER (PARTITION BY l_returnflag) * (high_edge - low_edge)), 4) AS density
    FROM ({HISTOGRAM.replace("round(low + bin * (high - low) / 10, 4)", "low + bin * ((high - low) / 10)").replace("round(low + (bin + 1) * (high - low) / 10, 4)", "low + (bin + 1) * ((high - low) / 10)")})""")
def class_distribution(t: Tables) -> DataFrame:
    found = profile.class_distribution(t.lineitem, "l_extendedprice", "l_returnflag")
    return rounded(found.select("l_returnflag", "bin", "count", (1e6 * F.col("density")).alias("density")), ["density"])


@query("""
    WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS med, quantile_cont(o_totalprice, 0.75) AS q3
               FROM orders GROUP BY 1)
    SELECT o_orderpriority, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3,
           min(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
           max(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
           count(*) FILTER (NOT o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
    FROM orders JOIN q USING (o_orderpriority) GROUP BY o_orderpriority, q1, med, q3""")
def boxplot_stats(t: Tables) -> DataFrame:
    return rounded(profile.boxplot_stats(t.orders, "o_totalprice", "o_orderpriority"), ["q1", "median", "q3"])


@query("SELECT round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median FROM lineitem WHERE l_quantity < 10")
def mean_median(t: Tables) -> DataFrame:
    return rounded(rollup.mean_median(t.lineitem.where("l_quantity < 10"), "l_extendedprice"), ["mean", "median"])


@query("""
    SELECT min(l_shipdate) AS min_l_shipdate, max(l_shipdate) AS max_l_shipdate, min(l_quantity) AS min_l_quantity,
           max(l_quantity) AS max_l_quantity FROM lineitem""")
def span(t: Tables) -> DataFrame:
    return rollup.span(t.lineitem, ["l_shipdate", "l_quantity"])


@query("SELECT * FROM (SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)")
def last_rows(t: Tables) -> DataFrame:
    return rollup.last_rows(t.orders.select("o_orderkey", "o_orderdate", "o_totalprice"), ["o_orderdate", "o_orderkey"], 20)


@query("""
    SELECT c_nationkey, c_custkey, c_acctbal, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3""")
def top_n_per_group(t: Tables) -> DataFrame:
    top = rollup.top_n_per_group(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)
    return top.select("c_nationkey", "c_custkey", "c_acctbal", "rank")


@query("""
    SELECT o_orderkey AS key, 'order' AS kind, o_orderpriority AS priority, NULL AS flag FROM orders
    UNION ALL SELECT l_orderkey, 'line', NULL, l_returnflag FROM lineitem""")
def union_all(t: Tables) -> DataFrame:
    orders = t.orders.select(F.col("o_orderkey").alias("key"), F.lit("order").alias("kind"), F.col("o_orderpriority").alias("priority"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("key"), F.lit("line").alias("kind"), F.col("l_returnflag").alias("flag"))
    return rollup.union_all(orders, lines)


@query("""
    WITH s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS d0, avg(p_size) AS n, stddev_pop(p_size) AS e0 FROM part)
    SELECT p_partkey, round((p_retailprice - m) / d0, 6) AS p_retailprice, round((p_size - n) / e0, 6) AS p_size FROM part, s""")
def standardize(t: Tables) -> DataFrame:
    return rounded(scale(t.part.select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"]), ["p_retailprice", "p_size"], 6)


@query("""
    SELECT o_orderstatus, split, CASE split WHEN 'train' THEN k ELSE n - k END AS rows
    FROM (SELECT o_orderstatus, count(*) AS n, CAST(round(count(*) * 0.7) AS BIGINT) AS k FROM orders GROUP BY 1),
         (SELECT unnest(['train', 'test']) AS split)""")
def stratified_split(t: Tables) -> DataFrame:
    marked = split_by_class(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])
    return marked.groupBy("o_orderstatus", "split").agg(F.count("*").alias("rows"))


@query("""
    WITH c AS (SELECT CAST(quality AS VARCHAR) AS l, CAST(toxic AS VARCHAR) AS p, count(*) AS n FROM labels GROUP BY ALL),
    s AS (SELECT k AS class, coalesce(sum(n) FILTER (l = k AND p = k), 0) AS hits, coalesce(sum(n) FILTER (l = k), 0) AS support,
                 coalesce(sum(n) FILTER (p = k), 0) AS predicted
          FROM c, (SELECT l AS k FROM c UNION SELECT p FROM c) GROUP BY k),
    m AS (SELECT class, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision,
                 CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
                 CASE WHEN predicted + support > 0 THEN 2 * hits / (predicted + support) ELSE 0 END AS f1, support, hits FROM s)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (
        SELECT class, precision, recall, f1, support FROM m
        UNION ALL SELECT 'accuracy', NULL, NULL, sum(hits) / sum(support), sum(support) FROM m
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                         sum(f1 * support) / sum(support), sum(support) FROM m)""")
def classification_report(t: Tables) -> DataFrame:
    return rounded(profile.classification_report(t.labels, "quality", "toxic"), ["precision", "recall", "f1"], 6)


@query("""
    SELECT l_returnflag, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(e * e) / 1e6, 4) AS mse, round(avg(abs(e)), 4) AS mae, count(e) AS rows
    FROM (SELECT l_returnflag, l_extendedprice - 2000 * l_quantity AS e FROM lineitem) GROUP BY 1""")
def regression_metrics(t: Tables) -> DataFrame:
    guess = t.lineitem.withColumn("guess", 2000 * F.col("l_quantity"))
    found = errors(guess, "l_extendedprice", "guess", ["l_returnflag"])
    return rounded(found.withColumn("mse", F.col("mse") / 1e6), ["rmse", "mse", "mae"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50")
def first_rows(t: Tables) -> DataFrame:
    """The fifty cheapest orders."""
    return rollup.first_rows(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 50)


@query("SELECT l_orderkey, l_linenumber, l_quantity AS f0, l_discount AS f1, l_tax AS f2 FROM lineitem")
def assembled_vectors(t: Tables) -> DataFrame:
    rows = vectors.assemble(t.lineitem, ["l_quantity", "l_discount", "l_tax"])
    values = vector_to_array("features")
    return rows.select("l_orderkey", "l_linenumber", *[values[i].alias(f"f{i}") for i in range(3)])


@query("SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e_{i}" for i in range(64)) + " FROM embeddings")
def spread_embeddings(t: Tables) -> DataFrame:
    """Every component of the embeddings as a column."""
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return words.spread(rows, "embedding", 64, "e")
