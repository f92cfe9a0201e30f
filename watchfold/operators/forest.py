"""Isolation forest: every tree grows in its own group from at most 256 sampled rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import FEATURES

TREES, SAMPLE, SEED = 200, 256, 42
BLOCK = 256
NODES = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"


def average_path(n):
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2 * (np.log(n[big] - 1) + np.euler_gamma) - 2 * (n[big] - 1) / n[big]
    return out


def tree_samples(features: DataFrame, key: str = "id", trees: int = TREES, sample: int = SAMPLE,
                 seed: int = SEED) -> DataFrame:
    """(tree, features) with ``sample`` rows per tree, without replacement, fixed by the seed.

    A hash of the key first thins the data to a few times what all trees need; only those rows
    meet the trees. The last step takes exactly the smallest hashes per tree.
    """
    n = features.count()
    keep = min(1.0, 4.0 * trees * sample / max(n, 1))
    draw = min(1.0, 1.5 * sample / max(n * keep, 1) + 64.0 / max(n * keep, 1))

    def chance(*cols):
        return (F.xxhash64(*cols) / F.lit(2.0 ** 64)) + 0.5

    thinned = features.select(key, *FEATURES).filter(chance(F.col(key), F.lit(seed)) <= keep)
    pairs = thinned.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn(
        "_h", F.xxhash64(F.col(key), F.col("tree"), F.lit(seed + 1))).filter((F.col("_h") / F.lit(2.0 ** 64)) + 0.5 <= draw)
    rank = F.row_number().over(W.partitionBy("tree").orderBy("_h", key))
    return pairs.withColumn("_r", rank).filter(F.col("_r") <= sample).select("tree", "_r", *FEATURES)


def grow_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree: (node, feature, threshold, left, right, size, depth); leaves have -1."""
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, None, None)]
    while stack:
        rows, depth, parent, side = stack.pop()
        here = len(nodes)
        nodes.append([here, -1, 0.0, -1, -1, len(rows), depth])
        if parent is not None:
            nodes[parent][side] = here
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        if threshold >= high[feature]:  # low and high are neighbouring doubles
            threshold = float(low[feature])
        left = part[:, feature] <= threshold
        nodes[here][1], nodes[here][2] = feature, threshold
        stack.append((rows[~left], depth + 1, here, 4))
        stack.append((rows[left], depth + 1, here, 3))
    return [tuple(n) for n in nodes]


def train_forest(features: DataFrame, key: str = "id", trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Node table of the forest."""
    limit = math.ceil(math.log2(max(sample, 2)))
    names = list(FEATURES)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("_r")
        nodes = grow_tree(pdf[names].to_numpy(dtype=float), np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
        out.insert(0, "tree", tree)
        return out

    return tree_samples(features, key, trees, sample, seed).groupBy("tree").applyInPandas(grow, NODES)


def forest_arrays(nodes: DataFrame) -> dict[str, np.ndarray]:
    """The forest as flat arrays. At most trees x (2 x sample - 1) nodes, whatever the data."""
    pdf = nodes.orderBy("tree", "node").toPandas()
    sizes = pdf.groupby("tree").size()
    start = sizes.cumsum() - sizes
    offset = pdf["tree"].map(start).to_numpy()
    leaf = pdf["feature"].to_numpy() < 0
    own = offset + pdf["node"].to_numpy()
    return {
        "roots": start.to_numpy(),
        "feature": np.where(leaf, 0, pdf["feature"]).astype(np.int64),
        "threshold": pdf["threshold"].to_numpy(dtype=float),
        "left": np.where(leaf, own, offset + pdf["left"].to_numpy()),
        "right": np.where(leaf, own, offset + pdf["right"].to_numpy()),
        "path": np.where(leaf, pdf["depth"] + average_path(pdf["size"]), 0.0),
        "depth": np.array(int(pdf["depth"].max())),
        "norm": average_path(np.array([pdf.loc[pdf["node"] == 0, "size"].max()])),
    }


def anomaly(x: np.ndarray, forest: dict[str, np.ndarray]) -> np.ndarray:
    """2^(-mean path / c): near 1 for rows that are isolated early.

    All trees are walked for ``BLOCK`` rows at a time, so that what a level reads stays in the processor's cache.
    """
    down = np.column_stack([forest["right"], forest["left"]]).ravel()
    mean = np.empty(len(x))
    for a in range(0, len(x), BLOCK):
        block = x[a:a + BLOCK]
        values, first = block.ravel(), np.arange(len(block))[:, None] * x.shape[1]
        at = np.broadcast_to(forest["roots"], (len(block), len(forest["roots"])))
        for _ in range(int(forest["depth"])):
            goes_left = values.take(first + forest["feature"].take(at)) <= forest["threshold"].take(at)
            at = down.take(2 * at + goes_left)
        mean[a:a + BLOCK] = forest["path"].take(at).mean(axis=1)
    return np.power(2.0, -mean / max(float(forest["norm"][0]), 1e-12))
