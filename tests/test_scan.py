"""Values carried along keys that lie in several parts, against windows over whole keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import scan, series


@pytest.fixture(scope="module")
def rows(spark):
    dice = random.Random(2)
    data = [(dice.choice([7, 7, 7, 7, 1, 2, None]), i, dice.choice([None, None, float(i)]), dice.choice("ab")) for i in range(3000)]
    return spark.createDataFrame(data, "k long, t long, v double, _part_name string").repartition(6).cache()


@pytest.fixture(scope="module", autouse=True)
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def same(a, b):
    return a.exceptAll(b.select(a.columns)).count() == 0 and b.count() == a.count()


def test_the_hot_key_lies_in_several_parts(rows):
    seen = {}

    def keep(df):
        seen["rows"] = df.cache()
        return seen["rows"]

    scan.numbered(rows, ["k"], ["t"], keep=keep).count()
    assert seen["rows"].where("k = 7").select("_part").distinct().count() > 3


def test_carried(rows):
    whole = Window.partitionBy("k").orderBy("t")
    expected = rows.select(
        "k", "t", "_part_name", F.last("v", True).over(whole.rowsBetween(Window.unboundedPreceding, 0)).alias("v"),
        F.lead(F.struct("t", "v")).over(whole).alias("next"), (F.row_number().over(whole) - 1).cast("long").alias("position"),
    )
    found = scan.carried(rows, ["k"], ["t"], scan.last_known(["v"]), scan.next_row(["t", "v"]), scan.position())
    assert same(found, expected)


def test_lags(rows, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 16)
    whole = Window.partitionBy("k").orderBy("t")
    expected = rows.select("*", *[F.coalesce(F.lag("v", i).over(whole), F.lit(0.0)).alias(f"lag_{i}") for i in range(1, 9)])
    assert same(series.lag_features(rows, "v", ["k"], "t"), expected)


def test_equal_rows_are_all_numbered(spark):
    equal = spark.createDataFrame([(1, 5, "x")] * 500 + [(None, None, "y")] * 300, "k long, t long, s string").repartition(7)
    found = scan.numbered(equal, ["k"], ["t"], "n")
    assert [r["n"] for r in found.where("k = 1").orderBy("n").collect()] == list(range(500))
    assert [r["n"] for r in found.where("k IS NULL").orderBy("n").collect()] == list(range(300))


def test_no_rows(rows):
    none = rows.limit(0)
    assert scan.carried(none, ["k"], ["t"], scan.last_known(["v"]), scan.next_row(["v"]), scan.position()).count() == 0
    assert series.lag_features(none, "v", ["k"], "t").count() == 0
    assert series.min_max_scale(none, ["v"], ["k"]).count() == 0


def test_scaled_by_series(rows):
    whole = Window.partitionBy("k")
    low, high = F.min("v").over(whole), F.max("v").over(whole)
    expected = rows.withColumn("v", (F.col("v") - low) / (high - low))
    assert same(series.min_max_scale(rows, ["v"], ["k"]), expected)
