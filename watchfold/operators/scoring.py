"""Model storage and ensemble scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FEATURES
from ..session import reliable
from . import attribution
from .autoencoder import squared_errors, train_autoencoder
from .forest import anomaly, forest_arrays, train_forest
from .training import column_maxima, scale_by

PARTS = ["forest", "autoencoder", "scaling"]


@dataclass
class Model:
    forest: dict[str, np.ndarray]
    weights: np.ndarray
    maxima: dict[str, float]


def train(features: DataFrame, path: str, key: str = "id", scale: bool = True) -> None:
    """Train both models on benign feature rows and store them below ``path``."""
    spark = features.sparkSession
    rows = reliable(features.select(key, *FEATURES), "training")
    maxima = column_maxima(rows).first().asDict() if scale else dict.fromkeys(FEATURES, 1.0)
    scaled = scale_by(rows, maxima)
    train_forest(scaled, key).write.mode("overwrite").parquet(f"{path}/forest")
    weights = train_autoencoder(scaled, key)
    spark.createDataFrame(pd.DataFrame({"i": np.arange(len(weights)), "value": weights})).coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/autoencoder")
    spark.createDataFrame([(c, float(maxima[c] or 0.0)) for c in FEATURES], "feature string, maximum double").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/scaling")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def load(spark: SparkSession, path: str) -> Model:
    """The stored model; a missing part is an error before any work is planned."""
    missing = [p for p in PARTS if not _exists(spark, f"{path}/{p}")]
    if missing:
        raise FileNotFoundError(f"Model parts {missing} not found in {path}")
    weights = spark.read.parquet(f"{path}/autoencoder").orderBy("i").toPandas()["value"].to_numpy()
    maxima = {r["feature"]: r["maximum"] for r in spark.read.parquet(f"{path}/scaling").collect()}
    return Model(forest_arrays(spark.read.parquet(f"{path}/forest")), weights, maxima)


def score(features: DataFrame, model: Model, scale: bool = True) -> DataFrame:
    """Add forest_raw, recon_errors, anomaly_score and top_features.

    Both models run in one Arrow pass; everything after it is native. The broadcast model has a
    fixed size: 200 trees of at most 511 nodes, and 1,969 weights.
    """
    shared = features.sparkSession.sparkContext.broadcast((model.forest, model.weights))
    divisor = np.array([model.maxima.get(c) or 0.0 for c in FEATURES])
    divisor = np.where(divisor > 0, divisor, 1.0) if scale else np.ones(len(FEATURES))

    @F.pandas_udf("forest double, errors array<double>")
    def both(*cols: pd.Series) -> pd.DataFrame:
        forest, weights = shared.value
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols]) / divisor
        return pd.DataFrame({"forest": anomaly(x, forest), "errors": list(squared_errors(x, weights))})

    scored = features.withColumn("_m", both(*FEATURES)).withColumns({
        "forest_raw": F.col("_m.forest"), "recon_errors": F.col("_m.errors")}).drop("_m")
    total = F.aggregate("recon_errors", F.lit(0.0), lambda a, e: a + e)
    return scored.withColumn("recon_error", total / len(FEATURES)).withColumns({
        "anomaly_score": attribution.blend(attribution.forest_score(F.col("forest_raw")),
                                           attribution.reconstruction_score(F.col("recon_error"))),
        "top_features": attribution.top_features(F.col("recon_errors"))})


def contamination_threshold(scored: DataFrame, contamination: float = 0.01) -> float:
    """Forest score above which the given share of the training rows lies."""
    return scored.agg(F.percentile_approx("forest_raw", 1 - contamination, 100000)).first()[0]


def with_outlier_flag(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("is_outlier", F.col("forest_raw") > threshold)


def benign_error_grid(scored: DataFrame, points: int = 100) -> list[float]:
    """Percentiles of the benign reconstruction error, one per point."""
    return scored.agg(F.percentile_approx("recon_error", [i / points for i in range(1, points + 1)], 10000)).first()[0]


def error_percentile(grid: list[float]):
    """Share of benign errors at or below a row's error, read off the grid."""
    at = F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: g <= F.col("recon_error"))
    return F.size(at) / F.lit(float(len(grid)))
