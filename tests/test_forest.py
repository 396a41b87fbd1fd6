"""The forest over counted rows against plain trees and MLlib's forest."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella import session
from tessella.operators import explain, forest


def frame(spark, n: int = 3_000, seed: int = 3):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"a": rng.integers(0, 2, n), "b": rng.integers(0, 40, n) * 1.0, "c": rng.random(n), "d": rng.integers(0, 3, n)})
    rows["y"] = np.where((rows["b"] > 30) & (rows["a"] == 1) | (rng.random(n) < 0.05), -1, 1)
    return spark.createDataFrame(rows.assign(id=np.arange(n)))


def test_bins_hold_rare_values_missing_and_endless_ones(spark):
    rows = [(float(i), 0.0, None, 1) for i in range(1_000)] + [(float("nan"), 7.0, float("inf"), 1), (float("inf"), 0.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d int")
    a, b, c, d = forest.thresholds(df, list("abcd"), 32)
    assert b.tolist() == [3.5] and c.tolist() == [1.0, np.inf] and len(d) == 0  # the missing ones are above all
    assert 30 <= len(a) <= 32 and a[-1] == np.inf
    columns = [np.array([0.0, 999.0, np.inf, np.nan]), np.array([0.0, 7.0, 0.0, 0.0]), np.array([np.nan, np.inf, 1.0, 1.0]), np.ones(4)]
    codes = forest._codes(columns, [a, b, c, d])
    assert codes[:, 1].tolist() == [0, 1, 0, 0] and codes[:, 2].tolist() == [2, 1, 0, 0] and codes[3, 0] > codes[2, 0] > codes[0, 0]


def test_draws_are_poisson(spark):
    spots = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    for mean in (1, 7, 5_000):
        found = forest.draws(spots, np.full(len(spots), mean), range(4))
        assert found.mean() == pytest.approx(mean, rel=0.02) and found.var() == pytest.approx(mean, rel=0.05)
        assert abs(np.corrcoef(found)[0, 1]) < 0.03


def test_a_single_tree_splits_as_all_splits_compared(spark):
    df = frame(spark)
    found = forest.fit_forest(df, list("abcd"), "y", trees=1, depth=2)
    rows = df.toPandas()
    y = (rows["y"] == 1).to_numpy()

    def best(here):
        gini = lambda s: 0.0 if not s.any() else 2 * y[s].mean() * (1 - y[s].mean())
        tries = [(gini(here) - sum((here & s).sum() / here.sum() * gini(here & s) for s in (side, ~side)), f, k)
                 for f, name in enumerate("abcd") for k, t in enumerate(found.bounds[f]) for side in [rows[name].to_numpy() <= t]]
        return max(tries, key=lambda x: x[0])

    gain, f, k = best(np.ones(len(y), bool))
    assert (found.feature[0, 1], found.split[0, 1]) == (f, k) and found.gain[0, 1] == pytest.approx(gain)
    left = rows["abcd"[f]].to_numpy() <= found.bounds[f][k]
    for node, here in ((2, left), (3, ~left)):
        assert found.counts[0, node].tolist() == [(here & ~y).sum(), (here & y).sum()]
        assert found.gain[0, node] == pytest.approx(best(here)[0])


def test_same_forest_for_any_order_and_close_to_mllib(spark):
    df = frame(spark)
    one = forest.fit_forest(df, list("abcd"), "y", trees=60)
    assert one.importances() == forest.fit_forest(df.repartition(7), list("abcd"), "y", trees=60).importances()
    theirs = dict(explain.importances(explain.forest_pipeline("y", list("abcd"), 60).fit(df), list("abcd")))
    assert {f: v for f, v in one.importances()} == pytest.approx(theirs, abs=0.08)
    said = one.predict(df)
    assert said.where(F.col("y").cast("string") == F.col("predicted")).count() > 0.93 * df.count()
    assert said.columns == [*df.columns, "predicted"]


def test_a_forest_takes_the_disk_of_its_cells_only(spark):
    df = frame(spark, 2_000).select("a", "d", "y", "id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(50))))
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(session.shared_dir(spark)) for f in files)
    before = size()
    table, _ = explain.random_forest_importance(df, ["a", "d"], "y", ["id", "copy"], trees=5)
    assert table.count() == 2 and size() - before < 100_000
    assert "BaggedPoint" not in str([x.name() for x in spark.sparkContext._jsc.getPersistentRDDs().values()])
    cells = forest._cells(df, ["a", "d"], "y", ["-1", "1"], forest.thresholds(df, ["a", "d"], 32))
    assert cells.count() <= 12 and cells.agg(F.sum("n")).first()[0] == 100_000
