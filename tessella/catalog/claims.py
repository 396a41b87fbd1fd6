"""Claims: line items with their order, part and supplier stand in for workshop claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.catalog.base import Tables, longs, query, rounded
from tessella.functions import columns as C
from tessella.operators import clean, joins, profile, reshape, rollup
from tessella.plans import claims as plan
from tessella.session import cut

TYPES = ("1-URGENT", "2-HIGH", "3-MEDIUM")
PARTS = ("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5")
AFTER = "1996-06-30"
KEYS = ("id_claim", "cd_dealer", "failure_date", "vin")
CATEGORIES = ("claim_status", "claim_type", "part_number_des", "item_type")
NUMBERS = ("work_hours", "amount")

CLAIMS = """
    SELECT l_orderkey AS id_claim, l_suppkey AS cd_dealer, CAST(l_shipdate AS DATE) AS failure_date,
           o_custkey AS vin, l_linestatus AS claim_status, o_orderpriority AS claim_type,
           p_brand AS part_number_des, l_returnflag AS item_type, p_type AS product_division,
           r_name AS region, n_name AS country, l_quantity AS work_hours, l_extendedprice AS amount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey"""
SELECTED = f"""
    SELECT DISTINCT * FROM ({CLAIMS}) WHERE region = 'EUROPE' AND failure_date > DATE '{AFTER}'
    AND claim_type IN {TYPES} AND part_number_des IN {PARTS}"""


def claims(t: Tables) -> DataFrame:
    """The joins that filters on region and part can thin out come before the large one with the orders."""
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    dealers = t.supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    return (
        t.lineitem.join(dealers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("id_claim"), F.col("l_suppkey").alias("cd_dealer"),
            F.col("l_shipdate").cast("date").alias("failure_date"), F.col("o_custkey").alias("vin"),
            F.col("l_linestatus").alias("claim_status"), F.col("o_orderpriority").alias("claim_type"),
            F.col("p_brand").alias("part_number_des"), F.col("l_returnflag").alias("item_type"),
            F.col("p_type").alias("product_division"), F.col("r_name").alias("region"), F.col("n_name").alias("country"),
            F.col("l_quantity").alias("work_hours"), F.col("l_extendedprice").alias("amount"),
        )
    )


def selected(t: Tables) -> DataFrame:
    return plan.selected_claims(claims(t), "EUROPE", AFTER, TYPES, PARTS)


def category_lists(t: Tables, narrowed: bool = True) -> dict[str, list]:
    """The filters name two of the lists, for all claims the tables do; the other two come from one scan of two columns."""
    found = reshape.category_values(t.lineitem, ["l_linestatus", "l_returnflag"])
    lists = {"claim_status": found["l_linestatus"], "item_type": found["l_returnflag"]}
    if narrowed:
        return lists | {"claim_type": list(TYPES), "part_number_des": list(PARTS)}
    types, brands = reshape.category_values(t.orders, ["o_orderpriority"]), reshape.category_values(t.part, ["p_brand"])
    return lists | {"claim_type": types["o_orderpriority"], "part_number_des": brands["p_brand"]}


def claim_features(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    """Features of the selected claims, or of ``rows``, which may hold every type and part there is."""
    return plan.claim_features(rows if rows is not None else selected(t), CATEGORIES, KEYS, NUMBERS, category_lists(t, rows is None))


def _max_flags(column: str, values: tuple[str, ...]) -> str:
    return ", ".join(f"max(CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END) AS \"{column}_{v}\"" for v in values)


ROLLUP = f"""
    SELECT id_claim, cd_dealer, failure_date, vin,
           {_max_flags("claim_status", ("F", "O"))}, {_max_flags("claim_type", TYPES)},
           {_max_flags("part_number_des", PARTS)}, {_max_flags("item_type", ("A", "N", "R"))},
           round(sum(work_hours), 4) AS total_work_hours, round(sum(amount), 4) AS total_amount,
           round(avg(work_hours), 4) AS mean_work_hours, round(avg(amount), 4) AS mean_amount
    FROM ({SELECTED}) GROUP BY id_claim, cd_dealer, failure_date, vin"""


@query(SELECTED)
def claim_filter_distinct(t: Tables) -> DataFrame:
    return selected(t)


@query(ROLLUP)
def claim_rollup(t: Tables) -> DataFrame:
    return rounded(claim_features(t), ["total_work_hours", "total_amount", "mean_work_hours", "mean_amount"])


@query("""
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS "l_returnflag_A",
           CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS "l_returnflag_N",
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS "l_returnflag_R",
           CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS "l_linestatus_F",
           CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS "l_linestatus_O"
    FROM lineitem""")
def one_hot(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return reshape.one_hot(rows, ["l_returnflag", "l_linestatus"])


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, round(o_totalprice, 0) AS price FROM orders")
def cast_columns(t: Tables) -> DataFrame:
    """Text columns back to types, one by a non-strict date pattern."""
    text = t.orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.round("o_totalprice", 0).cast("string").alias("price"),
    )
    return clean.ensure_date(clean.cast_by_schema(text, {"o_orderkey": "bigint", "price": "double"}), "day")


@query("""
    SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_rows,
           count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem""")
def duplicate_report(t: Tables) -> DataFrame:
    return clean.duplicate_report(t.lineitem.select("l_orderkey", "l_linenumber"))


@query("""
    SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def distinct_on_first(t: Tables) -> DataFrame:
    first = clean.distinct_on(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return first.select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")


@query("""
    SELECT l_orderkey || '/' || l_linenumber AS "ID", l_shipdate, l_quantity FROM lineitem
    WHERE l_returnflag IS DISTINCT FROM 'N' AND l_quantity BETWEEN 10 AND 20""")
def composite_key_range(t: Tables) -> DataFrame:
    rows = clean.keep_between(clean.drop_equal(t.lineitem, "l_returnflag", "N"), "l_quantity", 10, 20)
    rows = rows.withColumn("slash", F.lit("/"))
    return clean.with_composite_id(rows, ["l_orderkey", "slash", "l_linenumber"]).select("ID", "l_shipdate", "l_quantity")


@query("""
    SELECT l_partkey, round(a / (a + n + r), 6) AS "a PERC", round(n / (a + n + r), 6) AS "n PERC",
           round(r / (a + n + r), 6) AS "r PERC"
    FROM (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a,
                 sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS n,
                 sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r
          FROM lineitem GROUP BY l_partkey)
    WHERE a + n + r > 0 AND a / (a + n + r) >= 0.4""")
def residential_share_filter(t: Tables) -> DataFrame:
    parts = ("a", "n", "r")
    sums = t.lineitem.groupBy("l_partkey").agg(
        *[F.sum(F.when(F.col("l_returnflag") == c.upper(), F.col("l_quantity")).otherwise(0.0)).alias(c) for c in parts]
    )
    kept = clean.keep_major_share(clean.with_shares(sums, parts), "a", parts, 0.4).drop(*parts)
    return rounded(kept, [f"{c} PERC" for c in parts], 6)


@query("""
    SELECT l_orderkey, l_linenumber, l_quantity,
           CASE WHEN 100 * l_tax < l_quantity THEN 1 ELSE 0 END AS over_yellow,
           CASE WHEN 500 * l_tax < l_quantity THEN 1 ELSE 0 END AS over_red FROM lineitem""")
def threshold_flags(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", (100 * F.col("l_tax")).alias("yellow"), (500 * F.col("l_tax")).alias("red"))
    return clean.with_threshold_flags(rows, "l_quantity", {"over_yellow": "yellow", "over_red": "red"}).drop("yellow", "red")


@query("""
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' ELSE o_orderstatus END AS status,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent,
           coalesce(quality, 0) AS quality, coalesce(lang, '0') AS lang
    FROM orders LEFT JOIN documents ON o_orderkey = documents.doc_id LEFT JOIN labels ON o_orderkey = labels.doc_id""")
def recode_and_fill(t: Tables) -> DataFrame:
    rows = t.orders.join(t.documents.select("doc_id", "lang"), F.col("o_orderkey") == F.col("doc_id"), "left").drop("doc_id")
    rows = rows.join(t.labels.select("doc_id", "quality"), F.col("o_orderkey") == F.col("doc_id"), "left")
    rows = rows.select("o_orderkey", C.recode("o_orderstatus", {"F": "0", "O": "1"}).alias("status"), "o_orderpriority", "quality", "lang")
    rows = clean.binary_target(rows, "o_orderpriority", "1-URGENT", "urgent").drop("o_orderpriority")
    return clean.fill_constant(rows, 0)


@query("""
    SELECT p_partkey, column_name AS variable, value FROM (
        SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, p_brand, p_type FROM part)
    UNPIVOT (value FOR column_name IN (p_size, p_brand, p_type))""")
def melt(t: Tables) -> DataFrame:
    return reshape.melt(t.part, ["p_partkey"], ["p_size", "p_brand", "p_type"])


@query("""
    WITH codes AS (SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS DOUBLE) AS code
                   FROM orders GROUP BY o_orderpriority)
    SELECT o_orderkey, o_orderpriority, code AS o_orderpriority_encoded FROM orders JOIN codes USING (o_orderpriority)""")
def string_index(t: Tables) -> DataFrame:
    return reshape.string_index(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@query("""
    SELECT o_orderpriority, CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS day
    FROM orders GROUP BY o_orderpriority""")
def date_range(t: Tables) -> DataFrame:
    ends = t.orders.groupBy("o_orderpriority").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return reshape.date_range(ends, "a", "b").drop("a", "b")


@query("""
    SELECT s_suppkey, s_nationkey, n_name, r_name FROM supplier LEFT JOIN
    (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')
    ON s_nationkey = n_nationkey""")
def left_enrich(t: Tables) -> DataFrame:
    dimension = joins.inner_on(
        t.nation.withColumnRenamed("n_regionkey", "r_regionkey"), t.region, ["r_regionkey"]
    ).where("r_name <> 'ASIA'").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "r_name")
    return joins.left_enrich(t.supplier.select("s_suppkey", "s_nationkey"), dimension, ["s_nationkey"])


@query("""
    SELECT coalesce(a.day, b.day, c.day) AS day, coalesce(a.lines, 0) AS lines, coalesce(b.orders, 0) AS orders,
           coalesce(c.urgent, 0) AS urgent
    FROM (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS lines FROM lineitem GROUP BY 1) a
    FULL JOIN (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders GROUP BY 1) b ON a.day = b.day
    FULL JOIN (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS urgent FROM orders
               WHERE o_orderpriority = '1-URGENT' GROUP BY 1) c ON c.day = coalesce(a.day, b.day)""")
def full_outer_counts(t: Tables) -> DataFrame:
    by_day = lambda df, c, n: df.groupBy(F.col(c).cast("date").alias("day")).agg(F.count("*").alias(n))
    urgent = t.orders.where("o_orderpriority = '1-URGENT'")
    frames = [by_day(t.lineitem, "l_shipdate", "lines"), by_day(t.orders, "o_orderdate", "orders"), by_day(urgent, "o_orderdate", "urgent")]
    return joins.full_outer(frames, ["day"], fill=0)


RANKINGS = """
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS start_date,
           CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS end_date, o_orderpriority AS team,
           row_number() OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY count(*) DESC, o_orderpriority) AS position
    FROM orders GROUP BY date_trunc('month', o_orderdate), o_orderpriority"""


def rankings(t: Tables) -> DataFrame:
    """Priorities ranked per month; an interval ends on the first day of the next one, so two overlap there."""
    from pyspark.sql.window import Window

    month = F.trunc("o_orderdate", "month")
    counted = t.orders.groupBy(month.alias("start_date"), F.col("o_orderpriority").alias("team")).agg(F.count("*").alias("n"))
    place = Window.partitionBy("start_date").orderBy(F.desc("n"), "team")  # one row per priority
    return counted.select(
        "start_date", F.add_months("start_date", 1).alias("end_date"), "team", F.row_number().over(place).cast("long").alias("position")
    )


@query(f"""
    SELECT o_orderkey, o_orderpriority AS team, position, round((21 - position) / 20, 4) AS weight
    FROM orders LEFT JOIN ({RANKINGS}) r ON r.team = o_orderpriority AND CAST(o_orderdate AS DATE) BETWEEN start_date AND end_date
    QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY start_date, end_date) = 1""")
def interval_lookup(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("team"))
    found = joins.interval_lookup(rows, "o_orderdate", rankings(t), "start_date", "end_date", ["team"], ["position"])
    return rounded(found.drop("o_orderdate").withColumn("weight", joins.rank_weight("position")), ["weight"])


@query("""
    SELECT c_mktsegment AS segment, mode_code AS priority_encoded, o_orderpriority AS priority, round(price, 4) AS price
    FROM (SELECT c_mktsegment, code AS mode_code FROM (
              SELECT c_mktsegment, code, row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, code) AS rn
              FROM orders JOIN customer ON o_custkey = c_custkey JOIN (
                  SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS DOUBLE) AS code
                  FROM orders GROUP BY o_orderpriority) USING (o_orderpriority)
              GROUP BY c_mktsegment, code) WHERE rn = 1)
    JOIN (SELECT c_mktsegment, median(o_totalprice) AS price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
         USING (c_mktsegment)
    JOIN (SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS DOUBLE) AS mode_code
          FROM orders GROUP BY o_orderpriority) USING (mode_code)""")
def centroids(t: Tables) -> DataFrame:
    """Mode of a coded and median of a number column per segment, codes turned back to labels."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price")
    )
    coded = reshape.string_index(rows, ["priority"])
    found = rollup.centroids(coded, "segment", ["priority_encoded", "price"])
    return rounded(joins.dictionary_rejoin(found, coded, {"priority_encoded": "priority"}), ["price"])


def funnel_steps() -> dict[str, Column]:
    return {"returned": F.col("l_returnflag") == "R", "large": F.col("l_quantity") >= 25, "discounted": F.col("l_discount") > 0.05}


@query(f"""
    WITH lines AS (SELECT l_orderkey AS id, l_returnflag = 'R' AS a, l_quantity >= 25 AS b, l_discount > 0.05 AS c FROM lineitem)
    SELECT 0 AS step, 'all' AS name, count(*) AS rows, count(DISTINCT id) AS ids FROM lines
    UNION ALL SELECT 1, 'returned', count(*), count(DISTINCT id) FROM lines WHERE a
    UNION ALL SELECT 2, 'large', count(*), count(DISTINCT id) FROM lines WHERE a AND b
    UNION ALL SELECT 3, 'discounted', count(*), count(DISTINCT id) FROM lines WHERE a AND b AND c""")
def filter_funnel(t: Tables) -> DataFrame:
    return rollup.filter_funnel(t.lineitem, funnel_steps(), "l_orderkey")


@query("""
    WITH lines AS (SELECT l_returnflag = 'R' AS a, l_quantity >= 25 AS b, l_discount > 0.05 AS c FROM lineitem)
    SELECT 0 AS step, 'all' AS name, count(*) AS rows FROM lines UNION ALL SELECT 1, 'returned', count(*) FROM lines WHERE a
    UNION ALL SELECT 2, 'large', count(*) FROM lines WHERE a AND b UNION ALL SELECT 3, 'discounted', count(*) FROM lines WHERE a AND b AND c""")
def observed_funnel(t: Tables) -> DataFrame:
    """Rows left after each filter, as counted by the job that writes the filtered lines."""
    left, counts = rollup.observed_funnel(t.lineitem, funnel_steps())
    left.write.parquet(t.new_folder("discounted-lines"))
    return t.spark.createDataFrame(counts(), "step int, name string, rows long")


@query("""
    SELECT claim_status_F, item_type_R, "claim_type_1-URGENT", bucket, count(*) AS count FROM (
        SELECT *, CASE WHEN total_work_hours < p75 THEN 0 WHEN total_work_hours < p95 THEN 1 ELSE 2 END AS bucket
        FROM (%s) f, (SELECT quantile_cont(total_work_hours, 0.75) AS p75, quantile_cont(total_work_hours, 0.95) AS p95 FROM (%s))
        WHERE mean_amount > 50000)
    GROUP BY ALL""" % (ROLLUP, ROLLUP))
def outlier_patterns(t: Tables) -> DataFrame:
    """Patterns among marked claims; here the mark is a rule, so that SQL can check it."""
    features = cut(claim_features(t))
    marked = features.withColumn("anomaly", F.when(F.round("mean_amount", 4) > 50000, -1).otherwise(1))
    return plan.outlier_patterns(marked, ["claim_status_F", "item_type_R", "claim_type_1-URGENT"])


@query("""
    SELECT count(*) FILTER (l_discount >= 0.1) AS anomalies, count(*) AS rows,
           round(count(*) FILTER (l_discount >= 0.1) / count(*) * 100, 2) AS percent FROM lineitem""")
def anomaly_rate(t: Tables) -> DataFrame:
    return profile.anomaly_rate(t.lineitem.withColumn("anomaly", F.when(F.col("l_discount") >= 0.1, -1).otherwise(1)))
