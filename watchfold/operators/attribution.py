"""Score blending and per-event feature attribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rounding import round_exact
from ..schema import FEATURES
from ..settings import AE_BENIGN_P95, AE_WEIGHT, IF_WEIGHT


def clip01(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def forest_score(raw: Column) -> Column:
    return clip01((raw + 0.5) / 1.5)


def reconstruction_score(mse: Column, benign_p95: float = AE_BENIGN_P95) -> Column:
    return clip01(mse / F.lit(benign_p95))


def blend(forest: Column, reconstruction: Column, forest_weight: float = IF_WEIGHT,
          reconstruction_weight: float = AE_WEIGHT) -> Column:
    return round_exact(forest * forest_weight + reconstruction * reconstruction_weight, 4)


def top_features(errors: Column | None = None, k: int = 3) -> Column:
    """The k features of highest importance (squared error + |value| / 10), best first.

    Equal importance keeps feature order. ``errors`` is an array in feature order.
    """
    rows = []
    for i, name in enumerate(FEATURES):
        value = F.col(name).cast("double")
        error = F.lit(0.0) if errors is None else F.get(errors, F.lit(i))
        rows.append(F.struct((-(error + F.abs(value) * 0.1)).alias("rank"), F.lit(i).alias("at"),
                             F.lit(name).alias("name"), F.round(value, 4).alias("value")))
    best = F.slice(F.array_sort(F.array(*rows)), 1, k)
    return F.transform(best, lambda r: F.struct(r["name"].alias("name"), r["value"].alias("value")))
