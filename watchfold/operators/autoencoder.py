"""Autoencoder 9-32-16-8-16-32-9 with ReLU, trained by mini-batch Adam on gradient sums.

A hash of the key deals all rows to batches of at least 256, at most ``steps`` of them, so batches grow with the
table and the number of steps does not. Every step is a job of one stage: its tasks read the files of the batch, in
constant memory, and return 1,969 gradient sums each; Adam moves the weights on the driver. Repeats agree up to the
rounding of sums.

With ``one_stage`` an epoch is a barrier stage whose tasks exchange their sums after each batch; the weights are the
same. There Spark wakes waiting tasks once a second only, so an exchange takes about a second however small a batch is.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES
from ..session import shared_dir

LAYERS = [9, 32, 16, 8, 16, 32, 9]
LINEAR = {2, 5}  # the bottleneck and the output have no ReLU
EPOCHS, BATCH, RATE, SEED = 5, 256, 0.001, 42
STEPS = 40  # of an epoch, at most
TASKS = 64  # of the barrier stage, at most: every task receives the sums of all


def shapes() -> list[tuple[int, int]]:
    return list(zip(LAYERS[:-1], LAYERS[1:], strict=True))


def initial_weights(seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for fan_in, fan_out in shapes():
        bound = 1 / math.sqrt(fan_in)
        parts += [rng.uniform(-bound, bound, fan_in * fan_out), rng.uniform(-bound, bound, fan_out)]
    return np.concatenate(parts)


def unpack(flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for fan_in, fan_out in shapes():
        w = flat[at:at + fan_in * fan_out].reshape(fan_in, fan_out)
        at += fan_in * fan_out
        out.append((w, flat[at:at + fan_out]))
        at += fan_out
    return out


def forward(x: np.ndarray, layers) -> list[np.ndarray]:
    """Activations of every layer, the input first."""
    acts = [x]
    for i, (w, b) in enumerate(layers):
        z = acts[-1] @ w + b
        acts.append(z if i in LINEAR else np.maximum(z, 0.0))
    return acts


def gradient(x: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Gradient of the mean squared reconstruction error."""
    layers = unpack(flat)
    acts = forward(x, layers)
    delta = 2.0 * (acts[-1] - x) / x.size
    parts: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        if i not in LINEAR:
            delta = delta * (acts[i + 1] > 0)
        parts = [(acts[i].T @ delta).ravel(), delta.sum(axis=0), *parts]
        if i:
            delta = delta @ layers[i][0].T
    return np.concatenate(parts)


def adam(g: np.ndarray, state: dict, rate: float) -> None:
    state["t"] += 1
    state["m"] = 0.9 * state["m"] + 0.1 * g
    state["v"] = 0.999 * state["v"] + 0.001 * g * g
    m = state["m"] / (1 - 0.9 ** state["t"])
    v = state["v"] / (1 - 0.999 ** state["t"])
    state["w"] = state["w"] - rate * m / (np.sqrt(v) + 1e-8)


def squared_errors(x: np.ndarray, flat: np.ndarray) -> np.ndarray:
    return (forward(x, unpack(flat))[-1] - x) ** 2


def train_autoencoder(features: DataFrame, key: str = "id", epochs: int = EPOCHS, batch: int = BATCH,
                      rate: float = RATE, seed: int = SEED, steps: int = STEPS, one_stage: bool = False) -> np.ndarray:
    """Weights after training on all rows of ``features`` (scaled, benign). Dynamic allocation rules ``one_stage`` out."""
    spark, path = features.sparkSession, shared_dir(features.sparkSession, "batches")
    count = max(1, min(steps, math.ceil(features.count() / batch)))
    number = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(count)).cast("int")
    features.select(*[F.col(c).cast("double").alias(c) for c in FEATURES], number.alias("_b"),
                    F.xxhash64(F.col(key), F.lit(seed + 1)).alias("_h")).write.partitionBy("_b").parquet(path)
    rows = spark.read.schema(", ".join(f"{c} double" for c in FEATURES) + ", _h long, _b int").parquet(path)
    state = {"w": initial_weights(seed), "t": 0}
    state.update(m=np.zeros_like(state["w"]), v=np.zeros_like(state["w"]))
    for epoch in range(epochs):
        order = np.random.default_rng([seed, epoch]).permutation(count)
        if one_stage:
            state = _epoch_in_one_stage(rows, order, state, rate)
            continue
        for b in order.tolist():
            g = mean_gradient(rows.filter(F.col("_b") == b).select(*FEATURES), state["w"])
            if g is not None:
                adam(g, state, rate)
    return state["w"]


def _epoch_in_one_stage(rows: DataFrame, order: np.ndarray, state: dict, rate: float) -> dict:
    """The state after one pass over all batches in the given order."""
    tasks = max(1, min(TASKS, rows.sparkSession.sparkContext.defaultParallelism))
    place = np.argsort(order)
    placed = rows.select(*FEATURES, "_h", F.get(F.array(*[F.lit(int(p)) for p in place]), F.col("_b")).alias("_p"))
    dealt = placed.repartition(tasks, "_h").sortWithinPartitions("_p").select(*FEATURES, "_p")
    start = {k: (v if k == "t" else v.copy()) for k, v in state.items()}

    def run(batches):
        context, now, at = BarrierTaskContext.get(), start, 0
        total = np.zeros(len(now["w"]) + 1)

        def finish() -> None:
            """The batch is over in this task: exchange sums, move the weights."""
            told = context.allGather(base64.b64encode(total.tobytes()).decode())
            sums = np.sum([np.frombuffer(base64.b64decode(t)) for t in told], axis=0)
            if sums[-1]:
                adam(sums[:-1] / sums[-1], now, rate)
            total[:] = 0

        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]])
            p = batch.column(len(FEATURES)).to_numpy(zero_copy_only=False)
            for here in np.unique(p).tolist():
                while at < here:
                    finish()
                    at += 1
                some = x[p == here]
                total[:-1] += gradient(some, now["w"]) * len(some)
                total[-1] += len(some)
        while at < len(order):
            finish()
            at += 1
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(now["w"]))), *[pa.array(now[k]) for k in "wmv"],
                                              pa.array(np.full(len(now["w"]), now["t"]))], ["i", "w", "m", "v", "t"])

    after = dealt.mapInArrow(run, "i long, w double, m double, v double, t long", barrier=True).toPandas().sort_values("i")
    return {"t": int(after["t"].iloc[0]), **{k: after[k].to_numpy() for k in "wmv"}}


def mean_gradient(rows: DataFrame, weights: np.ndarray) -> np.ndarray | None:
    """Gradient of the mean error over all ``rows`` (the features), summed in the tasks; None without rows."""

    def run(batches):
        total, seen = np.zeros(len(weights) + 1), 0
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if len(x):
                total[:-1] += gradient(x, weights) * len(x)
                seen += len(x)
        total[-1] = seen
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    # One small row per task: summing them in tasks would cost a shuffle at every step.
    flat = sum((np.frombuffer(r["sums"]) for r in rows.mapInArrow(run, "sums binary").collect()), np.zeros(len(weights) + 1))
    return flat[:-1] / flat[-1] if flat[-1] else None
