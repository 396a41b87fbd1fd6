"""DBSCAN in many dimensions against brute force, with many pivots and parts of few points."""

import numpy as np
import pytest
from test_operators import brute_dbscan

from tessella.operators import balls, density


@pytest.mark.parametrize("d, eps, least, part_rows, pivots", [(5, 1.2, 4, 4096, 4096), (25, 4.0, 5, 40, 4096), (25, 4.6, 5, 30, 3), (8, 1.5, 3, 16, 7)])
def test_dbscan_in_many_dimensions(spark, monkeypatch, d, eps, least, part_rows, pivots):
    rng = np.random.default_rng(d + pivots)
    x = np.concatenate([rng.normal(0, 1, (120, d)), rng.normal(4, 0.5, (120, d)), rng.uniform(-4, 8, (60, d)), np.tile(rng.normal(1, 1, (1, d)), (90, 1)), np.zeros((5, d)), -np.zeros((5, d))])
    x[:40] *= 0.5
    core, cluster = brute_dbscan(x, eps, least)
    assert 0 < core.sum() < len(x) and (cluster == -1).any()
    monkeypatch.setattr(balls, "dbscan_points", lambda p, d, e, m, run=balls.dbscan_points: run(p, d, e, m, part_rows, pivots))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, " + ", ".join(f"a{i} double" for i in range(d)))
    got = {r["id"]: (r["kind"], r["cluster"]) for r in density.dbscan(df, [f"a{i}" for i in range(d)], "id", eps, least).collect()}
    assert len(got) == len(x)
    assert all((got[i][0] == "core") == core[i] and got[i][1] == cluster[i] for i in range(len(x)))


def test_far_balls_are_not_met(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c * 50, 1, (200, 6)) for c in range(5)])
    points = spark.createDataFrame([(i, 1, p.tolist()) for i, p in enumerate(x)], "node long, weight long, x array<double>")
    assert balls.shown(points, 0.2, 6, part_rows=50).count() < 3 * len(x)


def test_odd_rows(spark):
    wide = [f"a{i}" for i in range(4)]
    rows = [(i, 0.0, 0.0, 0.0, float(i % 2)) for i in range(8)] + [(10, None, 0.0, 0.0, 0.0), (11, float("nan"), 0.0, 0.0, 0.0), (12, 9.0, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "id long, a0 double, a1 double, a2 double, a3 double")
    got = {r["id"]: (r["kind"], r["cluster"]) for r in density.dbscan(df, wide, "id", 0.5, 4).collect()}
    assert got[0] == ("core", 0) and got[7] == ("core", 1) and got[10] == got[11] == (None, None) and got[12] == ("noise", -1)
    assert density.dbscan(df.limit(0), wide, "id", 0.5, 4).count() == 0


@pytest.mark.parametrize("large", [1 << 12, 32 << 20])
def test_points_without_structure_move_few_times(spark, monkeypatch, large):
    monkeypatch.setattr(balls, "LARGE_BYTES", large)
    monkeypatch.setattr(balls, "BLOCK", 1 << 10)
    x = np.random.default_rng(3).normal(0, 1, (900, 16))
    points = spark.createDataFrame([(i, 1, p.tolist()) for i, p in enumerate(x)], "node long, weight long, x array<double>")
    eps = 3.6
    core, cluster = brute_dbscan(x, eps, 5)
    assert 0 < core.sum() < len(x)
    rows, part_rows = balls._shown(points, eps, 16, 10, 4096)
    left, right = balls._grouped(rows, [], part_rows)
    parts = max(8, 900 * 16 * 8 // large)
    assert left.count() + right.count() <= 2.2 * len(x) * (parts + 1)  # before: more than 160 times as many as points
    got = {r["node"]: r["cluster"] for r in balls.dbscan_points(points, 16, eps, 5, 10).collect()}
    assert all(got[i] == cluster[i] for i in range(len(x)))
