"""Scores of a given forest and autoencoder as joins and array expressions, without Python.

The same values as `scoring.score` from the model's own tables: every row meets every tree once and goes down one
level per join with the node table, which is broadcast (trees x (2 x sample - 1) nodes at most, whatever the data);
layers of the autoencoder are array expressions over the row's nine values. One shuffle, by row, brings the
paths of a row together; most of them meet before it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FEATURES
from . import attribution
from .autoencoder import LINEAR, shapes, unpack
from .forest import NODES, average_path, forest_arrays
from .scoring import Model

GIVEN_TREES, GIVEN_DEPTH = 20, 4
# What the features of the given model are divided by.
GIVEN_MAXIMA = [8.0, 40.0, 400.0, 1.0, 20.0, 20.0, 9e9, 4.0, 4e7]


def given_nodes() -> pd.DataFrame:
    """The node table of a small forest of complete trees, built by rule."""
    rows = []
    for tree in range(GIVEN_TREES):
        for node in range(2 ** (GIVEN_DEPTH + 1) - 1):
            depth = int(np.log2(node + 1))
            inner = depth < GIVEN_DEPTH
            rows.append((tree, node, (tree * 5 + node * 3) % 9 if inner else -1, (((tree * 7 + node * 11) % 17 + 1) / 18) ** 2 if inner else 0.0,
                         2 * node + 1 if inner else -1, 2 * node + 2 if inner else -1, 256 if node == 0 else 1 + (tree + node) % 40, depth))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])


def given_weights() -> np.ndarray:
    """Weights of the autoencoder, built by rule."""
    parts = []
    for layer, (fan_in, fan_out) in enumerate(shapes()):
        i, j = np.meshgrid(np.arange(fan_in), np.arange(fan_out), indexing="ij")
        parts += [(((i * 7 + j * 13 + layer * 5) % 11 - 5) / 20.0).ravel(), ((np.arange(fan_out) * 3 + layer) % 7 - 3) / 50.0]
    return np.concatenate(parts)


def given_model(spark: SparkSession) -> Model:
    """The given model as `scoring.score` takes it."""
    return Model(forest_arrays(spark.createDataFrame(given_nodes(), NODES)), given_weights(), dict(zip(FEATURES, GIVEN_MAXIMA)))


def _scaled(maxima: dict[str, float]) -> Column:
    return F.array(*[F.col(c).cast("double") / F.lit(float(maxima.get(c) or 0.0) or 1.0) for c in FEATURES])


def forest_raw(features: DataFrame, nodes: DataFrame, maxima: dict[str, float], key: str = "id") -> DataFrame:
    """(key, forest_raw): 2^(-mean path / c) of every row of ``features``, whose ``key`` is unique."""
    facts = nodes.agg(F.max("depth").alias("depth"), F.countDistinct("tree").alias("trees"),
                      F.max(F.when(F.col("node") == 0, F.col("size"))).alias("size")).first()
    norm = max(float(average_path(np.array([facts["size"]]))[0]), 1e-12)
    size = F.col("size").cast("double")
    rest = F.when(size > 2, 2 * (F.ln(size - 1) + float(np.euler_gamma)) - 2 * (size - 1) / size).when(size == 2, 1.0).otherwise(0.0)
    steps = F.broadcast(nodes.filter("feature >= 0").select("tree", "node", "feature", "threshold", "left", "right"))
    ends = F.broadcast(nodes.filter("feature < 0").select("tree", "node", (F.col("depth") + rest).alias("path")))
    at = features.select(key, _scaled(maxima).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(facts["trees"] - 1))).alias("tree"), F.lit(0).alias("node"))
    for _ in range(facts["depth"]):
        down = F.when(F.get("x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = at.join(steps, ["tree", "node"], "left").select(
            key, "x", "tree", F.when(F.col("feature").isNull(), F.col("node")).otherwise(down).alias("node"))
    paths = at.join(ends, ["tree", "node"]).groupBy(key).agg(F.sum("path").alias("path"))
    return paths.select(key, F.pow(F.lit(2.0), -(F.col("path") / facts["trees"]) / norm).alias("forest_raw"))


def reconstruct(features: DataFrame, weights: np.ndarray, maxima: dict[str, float]) -> DataFrame:
    """``features`` with recon_errors and recon_error, layer by layer, so that each is computed once per row.

    A unit is a column of its own and a sum of products in its generated code: array functions with lambdas are
    interpreted, which took most of the time.
    """
    # HotSpot does not compile methods above this size; Spark then cuts the code into small ones.
    features.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    rows = features.withColumn("_x", _scaled(maxima))
    units = [f"_u0_{i}" for i in range(len(FEATURES))]
    rows = rows.select("*", *[F.get("_x", F.lit(i)).alias(u) for i, u in enumerate(units)])
    for layer, (w, b) in enumerate(unpack(weights)):
        outputs = [f"_u{layer + 1}_{j}" for j in range(w.shape[1])]
        sums = [" + ".join([f"({float(b[j])!r}D)", *[f"({float(v)!r}D) * {u}" for v, u in zip(w[:, j], units)]]) for j in range(w.shape[1])]
        z = [F.expr(s if layer in LINEAR else f"greatest({s}, 0.0D)").alias(u) for s, u in zip(sums, outputs)]
        # Units are used more than once, so Catalyst does not repeat a layer inside every use of it.
        rows = rows.select(*[c for c in rows.columns if c not in units], *z)
        units = outputs
    errors = F.zip_with(F.array(*units), "_x", lambda a, v: (a - v) * (a - v))
    total = F.aggregate("recon_errors", F.lit(0.0), lambda a, e: a + e)
    return rows.withColumn("recon_errors", errors).drop(*units, "_x").withColumn("recon_error", total / len(FEATURES))


def score_relationally(features: DataFrame, nodes: DataFrame, weights: np.ndarray, maxima: dict[str, float], key: str = "id") -> DataFrame:
    """`scoring.score` of a given model: forest_raw, recon_errors, recon_error, anomaly_score and top_features."""
    both = reconstruct(features, weights, maxima).join(forest_raw(features, nodes, maxima, key), key)
    return both.withColumns({
        "anomaly_score": attribution.blend(attribution.forest_score(F.col("forest_raw")), attribution.reconstruction_score(F.col("recon_error"))),
        "top_features": attribution.top_features(F.col("recon_errors"))})
