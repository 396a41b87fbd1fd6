"""The two-target network: gradients against finite differences, training on several tasks."""

import numpy as np
import pytest

from tessella.operators import joint


@pytest.mark.parametrize("hidden", [(4,), (5, 3)])
def test_gradients(hidden):
    rng = np.random.default_rng(0)
    weights = joint.initial(3, hidden, 7)
    x, kind, level = rng.normal(size=(20, 3)), rng.integers(0, 2, 20).astype(float), rng.normal(size=20)
    grads = joint._flat(joint.losses_and_gradients(weights, x, kind, level)[2])
    flat = joint._flat(weights)
    for i in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        both = [sum(joint.losses_and_gradients(joint._shaped(f, weights), x, kind, level)[:2]) for f in (up, down)]
        assert (both[0] - both[1]) / 2e-6 == pytest.approx(grads[i], abs=1e-4)


def test_training(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(3, 2, (1200, 4))
    kind, level = (x[:, 0] * x[:, 1] > 9).astype(int), 2 * x[:, 2] - x[:, 3] + 5
    rows = [(i, *map(float, p), int(k), float(q), "train" if i % 4 else "test") for i, (p, k, q) in enumerate(zip(x, kind, level))]
    rows += [(5000, None, 1.0, 1.0, 1.0, 1, 1.0, "test"), (5001, None, 1.0, 1.0, 1.0, 1, 1.0, "train"), (5002, 1.0, 1.0, 1.0, 1.0, None, None, "train")]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, kind int, level double, split string")
    found, history = joint.joint_model(df.repartition(6), list("abcd"), "kind", "level", rounds=40)
    again, same = joint.joint_model(df.repartition(3), list("abcd"), "kind", "level", rounds=40)
    assert np.allclose(history, same, rtol=1e-6)
    assert history[-1][0] < 0.6 * history[0][0] and history[-1][1] < 0.3 * history[0][1]
    said = {r["id"]: r for r in found.collect()}
    assert len(said) == 301 and said[5000]["predicted_kind"] is None and said[5000]["predicted_level"] is None
    fine = [r for i, r in said.items() if i != 5000]
    assert np.mean([r["predicted_kind"] == r["kind"] for r in fine]) > 0.85
    assert np.sqrt(np.mean([(r["predicted_level"] - r["level"]) ** 2 for r in fine])) < 2.5
