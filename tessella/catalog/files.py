"""Queries that write a table in a file layout and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.catalog import traffic
from tessella.catalog.base import Tables, query
from tessella.functions import columns as C
from tessella.operators import clean, reshape
from tessella.plans import traffic as plan
from tessella.sources import files, sinks


@query("SELECT o_orderkey, o_orderpriority, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def csv_round_trip(t: Tables) -> DataFrame:
    """Written as CSV with a header, read with given types."""
    path = t.new_folder("orders-csv")
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    sinks.write_csv(rows, path)
    return files.read_typed_csv(t.spark, path, "o_orderkey bigint, o_orderpriority string, o_totalprice double, o_orderdate date")


@query(f"""SELECT user_id || '' AS "APPARATO", event_type AS "PROVINCIA", day AS "DATA", CAST(value AS VARCHAR) AS "MAX_DS",
           clock AS "INTERVALLO_MAX_DS", day_type AS "TIPO_GIORNO_DS" FROM ({traffic.LONG})""")
def tilde_round_trip(t: Tables) -> DataFrame:
    """Device weeks written as ``~``-separated text with ``_`` for nulls, read as a folder, gathered to days."""
    path = t.new_folder("weeks-tilde")
    sinks.write_csv(traffic.device_weeks_raw(t), path, sep="~", null="_")
    long = reshape.wide_days_to_long(files.read_tilde_folder(t.spark, path), ["APPARATO", "PROVINCIA"], plan.DOWN)
    return long.withColumn("MAX_DS", C.decimal_comma("MAX_DS").cast("string"))


@query("""
    SELECT strftime(ts, '%Y-%m') AS month, event_id, printf('%.3f', value) AS value FROM events""")
def monthly_append(t: Tables) -> DataFrame:
    """Months written to one dataset; a month written twice is there once."""
    path = t.new_folder("events-months")
    rows = sinks.fixed_decimals(t.events.select("event_id", "value", F.date_format("ts", "yyyy-MM").alias("month")))
    sinks.write_months(rows, path)
    first = rows.agg(F.min("month")).first()[0]
    sinks.write_month(rows.where(F.col("month") == first).drop("month"), path, first)
    return t.spark.read.option("inferSchema", False).schema("event_id bigint, value string, month string").parquet(path)


@query("SELECT o_orderpriority, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1")
def json_report(t: Tables) -> DataFrame:
    path = t.new_folder("report-json")
    sinks.write_json_report(t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top")), path)
    return t.spark.read.schema("o_orderpriority string, n bigint, top double").json(path)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_header_scan(t: Tables) -> DataFrame:
    """Written as CSV with a header, read as text."""
    path = t.new_folder("customer-csv")
    sinks.write_csv(t.customer.select("c_custkey", "c_name", "c_mktsegment"), path)
    return files.read_header_csv(t.spark, path)


@query("SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, s_acctbal FROM supplier")
def csv_inferred_scan(t: Tables) -> DataFrame:
    """Written as CSV with a header, types taken from the data."""
    path = t.new_folder("supplier-csv")
    sinks.write_csv(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path)
    return files.read_inferred_csv(t.spark, path)


LATIN_WORD = "^[A-Za-zÀ-ÖØ-öø-ÿ]+"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(regexp_extract(text, '{LATIN_WORD}'), '') AS word FROM documents")
def latin1_scan(t: Tables) -> DataFrame:
    """First words of the documents written with semicolons in ISO-8859-1 and read again."""
    path = t.new_folder("words-latin1")
    rows = t.documents.select("doc_id", F.regexp_extract("text", LATIN_WORD, 0).alias("word"))
    rows = rows.withColumn("word", F.when(F.col("word") != "", F.col("word")))
    rows.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").option("nullValue", "_").csv(path)
    return files.read_latin1_semicolon(t.spark, path)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, o_orderstatus AS month FROM orders")
def months_union(t: Tables) -> DataFrame:
    """One ``~`` folder for each order status, read together with the status beside each row."""
    paths = {status: t.new_folder(f"orders-{status}") for status in ("F", "O", "P")}
    for status, path in paths.items():
        sinks.write_csv(t.orders.where(F.col("o_orderstatus") == status).select("o_orderkey", "o_orderpriority"), path, sep="~", null="_")
    return files.read_months(t.spark, paths)


@query("SELECT l_orderkey, l_linenumber, l_discount, l_tax, l_quantity / 100 AS ratio FROM lineitem")
def columns_by_pattern(t: Tables) -> DataFrame:
    """Keys, columns whose name fits a pattern and a percentage as a ratio, side by side."""
    found = clean.columns_like(t.lineitem, "^l_(disc|tax)")
    return clean.side_by_side(t.lineitem, ["l_orderkey", "l_linenumber"], found, [C.percent_to_ratio("l_quantity").alias("ratio")])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority AS note FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0")
def tilde_long_lines(t: Tables) -> DataFrame:
    """Lines with one empty field too many, or several, are left out of a ``~`` folder."""
    path = t.new_folder("orders-long")
    key = F.col("o_orderkey")
    note = F.when(key % 7 == 0, F.concat("o_orderpriority", F.lit("~"))).when(key % 5 == 0, F.lit("a~b~_~")).otherwise(F.col("o_orderpriority"))
    t.orders.select("o_orderkey", note.alias("note")).write.option("header", True).option("sep", "~").option("quote", "\u0000").csv(path)
    return files.read_tilde_folder(t.spark, path)
