"""Roll-ups of percentiles and distinct counts from sketches that merge to any longer window.

A slot of the finest grain holds a KLL sketch of the values, an HLL sketch of the keys and a row count. A longer
window merges the slots below it rung by rung, so one merge takes at most 60 sketches, whatever the rows behind
them; raw rows are read once. Sketches are combined before the shuffle, so a busy slot is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LADDER = ["minute", "hour", "day", "month", "year"]
KLL_ERROR = 0.02  # rank error of a quantile, for sketches of the default size
HLL_ERROR = 0.05  # relative error of a distinct count, some three standard errors at 12 bits


def slots(rows: DataFrame, time: str, value: str, key: str, grain: str = "minute") -> DataFrame:
    """(slot, n, values, keys) per ``grain``; rows without a time are left out, null values and keys are not sketched."""
    return rows.filter(F.col(time).isNotNull()).groupBy(F.date_trunc(grain, time).alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(F.col(value).cast("bigint")).alias("values"),
        F.hll_sketch_agg(F.col(key), 12).alias("keys"))


def merged(slot_rows: DataFrame, grain: str, window: str) -> DataFrame:
    """Slots of ``grain`` merged to slots of ``window``, a longer rung of ``LADDER``."""
    for rung in LADDER[LADDER.index(grain) + 1:LADDER.index(window) + 1]:
        fold = F.reduce(F.slice("parts", F.lit(2), F.size("parts")), F.element_at("parts", 1),
                        lambda a, b: F.kll_sketch_merge_bigint(a, b))
        slot_rows = slot_rows.groupBy(F.date_trunc(rung, "slot").alias("slot")).agg(
            F.sum("n").alias("n"), F.collect_list("values").alias("parts"), F.hll_union_agg("keys").alias("keys")).select(
            "slot", "n", fold.alias("values"), "keys")
    return slot_rows


def quantile(p: float) -> Column:
    """The value at rank ``p`` of a slot, to within ``KLL_ERROR`` of the rank; null for a slot without values."""
    return F.when(F.kll_sketch_get_n_bigint("values") > 0, F.kll_sketch_get_quantile_bigint("values", F.lit(p)))


def distinct() -> Column:
    """Distinct keys of a slot, to within ``HLL_ERROR``."""
    return F.hll_sketch_estimate("keys")


def rank_errors(rows: DataFrame, time: str, value: str, window: str, found: DataFrame, points: dict[str, float]) -> DataFrame:
    """(slot, n, one error per point): how far each estimated column of ``found`` (slot, ...) lies from its rank.

    A value that covers the ranks from ``low`` to ``high`` is off by the distance of the point from that range.
    """
    marked = rows.filter(F.col(time).isNotNull() & F.col(value).isNotNull()).select(
        F.date_trunc(window, time).alias("slot"), F.col(value).alias("_v")).join(found, "slot")
    counts = [F.count(F.lit(1)).alias("n")]
    for name in points:
        counts += [F.count_if(F.col("_v") < F.col(name)).alias(f"_low_{name}"), F.count_if(F.col("_v") <= F.col(name)).alias(f"_high_{name}")]
    return marked.groupBy("slot").agg(*counts).select("slot", "n", *[
        F.greatest(F.lit(0.0), F.col(f"_low_{c}") / F.col("n") - p, p - F.col(f"_high_{c}") / F.col("n")).alias(c) for c, p in points.items()])
