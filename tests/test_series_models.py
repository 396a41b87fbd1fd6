"""Models for each key against least squares on the rows of that key."""

import numpy as np

from tessella.operators import forecast


def test_models_and_predictions(spark):
    rng = np.random.default_rng(4)
    rows = []
    for key, n in ((1, 400), (2, 30), (None, 25), (3, 2)):
        x = rng.normal(5, 3, (n, 3))
        x[:, 2] = x[:, 0] * 2 if key == 2 else x[:, 2]  # columns that depend on each other
        y = x @ [1.0, -2.0, 0.5] + 7 + rng.normal(0, 0.1, n)
        rows += [(key, *map(float, p), float(q)) for p, q in zip(x, y)]
    rows += [(1, None, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0, None), (4, None, 1.0, 1.0, 1.0), (1, float("nan"), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y double").repartition(4)
    models = forecast.series_models(df, ["a", "b", "c"], "y", ["k"])
    found = {r["k"]: (r["rows"], r["coefficients"]) for r in models.collect()}
    assert set(found) == {1, 2, 3, None} and [found[k][0] for k in (1, 2, None, 3)] == [400, 30, 25, 2]
    for key in (1, None):
        mine = np.array([r[1:] for r in rows if r[0] == key and None not in r[1:] and not np.isnan(r[1:]).any()])
        expected = np.linalg.lstsq(np.column_stack([np.ones(len(mine)), mine[:, :3]]), mine[:, 3], rcond=None)[0]
        assert np.allclose(found[key][1], expected, rtol=1e-6)
    said = forecast.series_predictions(df, models, ["a", "b", "c"], ["k"]).collect()
    assert len(said) == len(rows)
    errors = [abs(r["predicted"] - r["y"]) for r in said if r["predicted"] is not None and r["y"] is not None and not np.isnan(r["predicted"])]
    assert len(errors) == 457 and np.mean(errors) < 0.2
    assert forecast.series_models(df.limit(0), ["a"], "y", ["k"]).count() == 0
