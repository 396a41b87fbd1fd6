"""A network with shared layers and two targets, trained on all tasks at once.

In each round the weights are sent to the tasks, every task adds up the gradients of both losses over its
rows, and the sums, as many numbers as there are weights, are added up exactly (as decimals, so the order of tasks
does not matter) and change the weights. No task holds more rows than it reads at a time, and the driver
holds weights and sums only. Equal data and seed give equal weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import drop_missing
from tessella.operators.vectors import standardize
from tessella.session import cut

DIGITS = "decimal(38,12)"
BATCH = 4096


def initial(width: int, hidden: Sequence[int], seed: int) -> list[np.ndarray]:
    """Weights and biases of the shared layers, then of the binary and of the number target."""
    random, out, size = np.random.default_rng(seed), [], width
    for n in hidden:
        out += [random.normal(0, size ** -0.5, (size, n)), np.zeros(n)]
        size = n
    for _ in range(2):
        out += [random.normal(0, size ** -0.5, (size, 1)), np.zeros(1)]
    return out


def _layers(weights: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    shared = [x]
    for w, b in zip(weights[:-4:2], weights[1:-4:2]):
        shared.append(np.tanh(shared[-1] @ w + b))
    return shared


def predict(weights: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the binary target and value of the number target."""
    top = _layers(weights, x)[-1]
    w1, b1, w2, b2 = weights[-4:]
    return 1 / (1 + np.exp(-np.clip(top @ w1 + b1, -500, 500)[:, 0])), (top @ w2 + b2)[:, 0]


def losses_and_gradients(weights: list[np.ndarray], x: np.ndarray, kind: np.ndarray, level: np.ndarray) -> tuple[float, float, list[np.ndarray]]:
    """Sums over the rows of cross-entropy, of half the squared error, and of the gradients of both together."""
    shared = _layers(weights, x)
    p, q = predict(weights, x)
    safe = np.clip(p, 1e-15, 1 - 1e-15)
    entropy = float(-(kind * np.log(safe) + (1 - kind) * np.log(1 - safe)).sum())
    error = float(((q - level) ** 2).sum() / 2)
    d1, d2 = (p - kind)[:, None], (q - level)[:, None]
    out = [shared[-1].T @ d1, d1.sum(0), shared[-1].T @ d2, d2.sum(0)]
    back = d1 @ weights[-4].T + d2 @ weights[-2].T
    for k in range(len(shared) - 1, 0, -1):
        back = back * (1 - shared[k] ** 2)
        out = [shared[k - 1].T @ back, back.sum(0), *out]
        back = back @ weights[2 * k - 2].T
    return entropy, error, out


def _flat(arrays: Sequence[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays])


def _shaped(flat: np.ndarray, like: Sequence[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([a.size for a in like])
    return [part.reshape(a.shape) for part, a in zip(np.split(flat, ends[:-1]), like)]


def _sums(rows: DataFrame, weights: list[np.ndarray]) -> np.ndarray:
    """Number of rows, both losses and all gradients, added up over the table ``x, kind, level``."""
    shared = rows.sparkSession.sparkContext.broadcast([w.tolist() for w in weights])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, total = [np.array(w) for w in shared.value], None
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                few = batch.slice(i, BATCH)
                x = few.column(0).flatten().to_numpy(zero_copy_only=False).reshape(few.num_rows, -1)
                entropy, error, grads = losses_and_gradients(net, x, few.column(1).to_numpy(), few.column(2).to_numpy())
                found = np.concatenate([[few.num_rows, entropy, error], _flat(grads)])
                total = found if total is None else total + found
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "value"])

    parts = rows.mapInArrow(add, "at int, value double")
    found = parts.groupBy("at").agg(F.sum(F.col("value").cast(DIGITS)).cast("double").alias("value")).collect()  # a row for each weight
    out = np.zeros(3 + sum(w.size for w in weights))
    for r in found:
        out[r["at"]] = r["value"]
    shared.destroy()
    return out


def joint_model(df: DataFrame, features: Sequence[str], binary: str, number: str, split: str = "split", hidden: Sequence[int] = (16,),
                rounds: int = 60, rate: float = 0.05, seed: int = 1) -> tuple[DataFrame, list[tuple[float, float]]]:
    """Rows outside ``train`` with ``predicted_<binary>`` (0 or 1) and ``predicted_<number>``, and both mean losses on
    the training rows before each round.

    Features are scaled by the statistics of the training rows, the number target to its range there. Rows
    with a missing feature have no prediction and are not learnt from; nor are those without a target.
    """
    df = cut(df)
    learn = df.where(F.col(split) == "train")
    scaled = standardize(df, features, ddof=1, train=learn)
    mean, spread = learn.agg(F.coalesce(F.avg(number), F.lit(0.0)), F.coalesce(F.stddev_samp(number), F.lit(1.0))).first()
    spread = spread or 1.0
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    rows = drop_missing(scaled.where(F.col(split) == "train"), [*features, binary, number])
    rows = cut(rows.select(x.alias("x"), F.col(binary).cast("double").alias("kind"), ((F.col(number) - mean) / spread).cast("double").alias("level")))
    weights = initial(len(features), hidden, seed)
    flat, m, v, history = _flat(weights), 0.0, 0.0, []
    for k in range(1, rounds + 1):
        sums = _sums(rows, _shaped(flat, weights))
        n = max(sums[0], 1)
        history.append((sums[1] / n, sums[2] / n))
        g = sums[3:] / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    final = [w.tolist() for w in _shaped(flat, weights)]

    @F.pandas_udf("struct<kind: double, level: double>")
    def say(values: pd.Series) -> pd.DataFrame:
        fine = np.array([v is not None and not any(a is None or np.isnan(a) for a in v) for v in values], bool)
        out = np.full((len(values), 2), np.nan)
        if fine.any():
            p, q = predict([np.array(w) for w in final], np.array([list(v) for v in values[fine]], float))
            out[fine] = np.column_stack([p > 0.5, q * spread + mean])
        return pd.DataFrame(out, columns=["kind", "level"])

    rest = scaled.where(F.col(split) != "train").withColumn("_said", say(x))
    value = lambda c: F.when(~F.isnan(F.col(f"_said.{c}")), F.col(f"_said.{c}"))
    return rest.withColumns({f"predicted_{binary}": value("kind"), f"predicted_{number}": value("level")}).drop("_said"), history
