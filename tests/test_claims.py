"""The claim queries over tables built here."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella import session
from tessella.catalog import claims, models
from tessella.catalog.base import Tables
from tessella.operators import isolation
from tessella.plans import claims as claims_plan

LINES = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp"
)


def given(spark, folder, n: int = 400) -> Tables:
    """``n`` orders of five priorities and seven brands; the line of order 0 comes twice."""
    day = dt.datetime(1997, 1, 1)
    lines = [(i, i % 21, i % 3, 1, float(i % 50 + 1), 100.0 + i * 37 % 1001, "ANR"[i % 3], "FO"[i // 2 % 2], day + dt.timedelta(days=i % 90)) for i in range(n)]
    types = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    tables = {
        "region": ([(0, "EUROPE"), (1, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(0, "FRANCE", 0), (1, "JAPAN", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(i, i % 2) for i in range(3)], "s_suppkey long, s_nationkey int"),
        "part": ([(i, f"Brand#{i % 7 + 1}", "STEEL") for i in range(21)], "p_partkey long, p_brand string, p_type string"),
        "orders": ([(i, i % 40, types[i * 7 // 4 % 5]) for i in range(n)], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "lineitem": ([*lines, lines[0]], LINES),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return Tables(spark, str(folder))


@pytest.fixture
def tables(spark, tmp_path):
    return given(spark, tmp_path)


def test_marked_claims_know_every_type_and_part_and_count_a_row_once(tables):
    rows, numbers = models.marked_claims(tables)
    flags = claims.claim_features(tables, claims.claims(tables)).columns
    assert {f"part_number_des_Brand#{i}" for i in range(1, 8)} | {"claim_type_4-NOT SPECIFIED", "claim_type_5-LOW"} <= set(flags)
    assert {"part_number_des_Brand#7", "claim_type_5-LOW"} <= set(numbers)
    assert rows.count() == 400 and rows.where("score IS NULL OR anomaly IS NULL").count() == 0
    assert [r["total_work_hours"] for r in rows.where("id_claim = 0").collect()] == [1.0]  # 2.0 with the duplicate row
    assert {r["feature"] for r in models.rf_importance(tables).collect()} == set(numbers)


def test_selected_claims_keep_the_lists_of_the_filters(tables):
    lists = claims.category_lists(tables)
    assert lists["claim_type"] == list(claims.TYPES) and lists["part_number_des"] == list(claims.PARTS)


def size(folder: str) -> int:
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_stored_in_parts_has_every_row_and_odd_names(spark, tables):
    rows = tables.lineitem.join(tables.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("l_orderkey", F.col("l_quantity").alias("a b.c,(1)"), F.col("l_shipdate").alias("A"), F.when(F.col("l_quantity") > 9, 1).alias("a"))
    rows = rows.union(rows.where("l_orderkey < 3").withColumn("l_orderkey", F.lit(None).cast("long")))
    sizes = session.bytes_read(rows)
    parts = session.stored(rows, "l_orderkey", part_bytes=sizes // 3)
    assert parts.schema.simpleString() == rows.schema.simpleString() and len({r[0] for r in parts.select(F.input_file_name()).collect()}) >= 4
    assert sorted(map(str, parts.collect())) == sorted(map(str, rows.collect()))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    empty = session.stored(rows.where("l_orderkey < -1"), "l_orderkey")
    assert empty.count() == 0 and empty.columns == rows.columns


def test_claim_outliers_store_a_fraction_of_what_they_compute(spark):
    rng, n = np.random.default_rng(4), 20_000
    flags = {f"flag_{i}": (rng.random(n) < 0.1).astype("int32") for i in range(30)}
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), **flags, "total": rng.random(n).round(2)}))
    before = size(session.shared_dir(spark))
    found = claims_plan.claim_outliers(rows, ["id"], k=25, trees=2).rows
    assert found.where("score IS NOT NULL").count() == n
    assert size(session.shared_dir(spark)) - before < 100 * n  # 700 when rows and their components were checkpointed


def test_features_in_one_array_are_scored_as_columns(spark):
    rng = np.random.default_rng(5)
    rows = pd.DataFrame(rng.normal(size=(300, 2)), columns=["x", "y"]).assign(id=np.arange(300))
    rows.loc[[3, 4], "y"] = np.nan
    df = spark.createDataFrame(rows).withColumn("both", F.when(F.col("id") != 5, F.array("x", "y")))
    one = isolation.isolation_forest(df.where("id <> 5"), ["x", "y"], ["id"], 0.1, trees=10, sample=16, keep=["id"])
    other = isolation.isolation_forest(df, "both", ["id"], 0.1, trees=10, sample=16, keep=["id"])
    other = {r["id"]: r for r in other.collect()}
    assert other.pop(5)["anomaly"] is None
    assert other == {r["id"]: r for r in one.collect()} and other[3]["score"] is None and other[3]["anomaly"] is None
