"""Training rows: seeded samples, flow-derived features, and scaling by column maxima."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES
from .normalize_flow import first_present, safe_double, trimmed_columns

SAMPLE_ROWS = 10_000


def seeded_sample(rows: DataFrame, n: int = SAMPLE_ROWS, key: str = "line_id", seed: int = 42) -> DataFrame:
    """n rows without replacement, fixed by key and seed: those of smallest hash, so a rerun picks the same rows.

    Only rows below a threshold some way above the n-th hash are ordered. It lies ten standard deviations
    off, so the table, not one task, thins itself at any size.
    """
    share = (F.lit(float(n)) + 10 * n ** 0.5 + 100) / F.greatest(rows.agg(F.count(F.lit(1))).scalar(), F.lit(1))
    h = F.xxhash64(F.col(key), F.lit(seed))
    near = rows.filter(h / F.lit(2.0 ** 64) + 0.5 <= share)
    return near.orderBy(h, key).limit(n)


def draws(seed: int, *keys: str):
    """Function from a draw's number to a value in [0, 1) that depends on the row's keys, the seed and the number
    alone, not on where the row lies."""
    def draw(i: int):
        h = F.xxhash64(*[F.col(f"`{k}`") for k in keys], F.lit(seed), F.lit(i))
        return F.shiftrightunsigned(h, 11) / F.lit(2.0 ** 53)
    return draw


def flow_features(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Nine features of labelled flow rows. What a flow cannot tell is a seeded draw by ``line_id``, or by all
    columns where there is none."""
    df = trimmed_columns(rows)
    draw = draws(seed, *(["line_id"] if "line_id" in df.columns else df.columns))

    def number(name: str, default: float):
        return safe_double(first_present(df, name)) if name in df.columns else F.lit(default)

    def uniform(low: float, high: float, i: int):
        return F.lit(low) + draw(i) * (high - low)

    def exponential(scale: float, i: int):
        return -F.log(1 - draw(i)) * scale

    fwd, bwd = number("Total Fwd Packets", 3.0), number("Total Backward Packets", 0.0)
    ratio = F.when(fwd > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (fwd - bwd) / (fwd + 1)))).otherwise(0.0)
    five = fwd * uniform(2.5, 4.8, 1) + exponential(1.5, 2)
    ports = F.greatest(F.lit(1.0), F.least(F.lit(100.0), F.pmod(number("Destination Port", 80.0), F.lit(10.0)) + 1))
    fanout = F.greatest(F.lit(1.0), F.least(F.lit(50.0), F.log1p(fwd) + uniform(0.5, 2.0, 5)))
    out = df.withColumns({
        "event_count_1m": fwd, "event_count_5m": five, "failed_auth_ratio": ratio,
        "distinct_dest_ports": ports, "dest_ip_fanout": fanout,
        "bytes_transferred": number("Flow Bytes/s", 100.0),
        "tod_zscore": F.sqrt(-2 * F.log(1 - draw(6))) * F.cos(2 * math.pi * draw(9)),
        "geo_velocity_kmh": F.when(draw(7) > 0.98, exponential(200.0, 8)).otherwise(0.0),
    })
    hour = F.col("event_count_5m") * uniform(6.0, 11.5, 3) + exponential(5.0, 4)
    return out.withColumn("event_count_1h", hour)


def column_maxima(features: DataFrame) -> DataFrame:
    """One row with the maximum of each feature."""
    return features.agg(*[F.max(c).alias(c) for c in FEATURES])


def scale_by(features: DataFrame, maxima: dict[str, float]) -> DataFrame:
    """Divide each feature by its maximum where that is positive."""
    return features.withColumns({c: F.col(c) / F.lit(float(maxima[c])) for c in FEATURES
                                 if maxima.get(c) is not None and maxima[c] > 0})


def training_features(rows: DataFrame, seed: int = 42) -> DataFrame:
    features = flow_features(rows, seed)
    return scale_by(features, column_maxima(features).first().asDict())


def benign_only(rows: DataFrame, label: str = "Label") -> DataFrame:
    """Benign rows, or all rows where there are none. One aggregate decides; rows stay put."""
    df = trimmed_columns(rows)
    benign = F.trim(F.col(label)) == "BENIGN"
    any_benign = df.agg(F.coalesce(F.bool_or(benign), F.lit(False))).scalar()
    return df.filter(F.coalesce(benign, F.lit(False)) | ~any_benign)
