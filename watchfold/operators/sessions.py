"""Gap-based incident sessions and recent score history, by slots of one gap length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import epoch_bucket
from ..settings import CLUSTER_WINDOW, MICROS

KEYS = ["entity", "technique_id"]


def slot_sessions(events: DataFrame, gap: int = CLUSTER_WINDOW) -> DataFrame:
    """(entity, technique, slot) -> session start.

    Events in one slot are never more than the gap apart, so a slot belongs to one session and
    sessions can be formed over slots, whose number does not grow with the event rate.
    """
    slots = events.groupBy(*KEYS, epoch_bucket("us", gap).alias("slot")).agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    by_time = W.partitionBy(*KEYS).orderBy("slot")
    before = F.lag("last_us").over(by_time)
    starts = F.when(before.isNull() | (F.col("first_us") - before > gap * MICROS), F.col("first_us"))
    marked = slots.withColumn("_start", starts)
    return marked.select(*KEYS, "slot", F.last("_start", ignorenulls=True).over(
        by_time.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("session_start"))


def attach_sessions(events: DataFrame, gap: int = CLUSTER_WINDOW) -> DataFrame:
    """Each event with the start of its session: an event joins the open session of its entity
    and technique if that was touched within the gap, else it opens one."""
    slotted = events.withColumn("slot", epoch_bucket("us", gap))
    return slotted.join(slot_sessions(events, gap), [*KEYS, "slot"]).drop("slot")


def sessions(events: DataFrame, gap: int = CLUSTER_WINDOW) -> DataFrame:
    return attach_sessions(events, gap).groupBy(*KEYS, "session_start").agg(
        F.max("us").alias("session_end"), F.count(F.lit(1)).alias("alert_count"))


def score_history(events: DataFrame, length: int = 5, slot_seconds: int = CLUSTER_WINDOW) -> DataFrame:
    """Add ``score_history``: the last ``length`` scores of the entity up to each event.

    Inside a slot this is a row window. The few scores that reach back further come from a
    per-slot table of last scores, whose rows hold at most ``length`` - 1 values.
    """
    back = length - 1
    slotted = events.withColumn("slot", epoch_bucket("us", slot_seconds))
    group = W.partitionBy("entity", "slot")
    newest = F.row_number().over(group.orderBy(F.desc("us"), F.desc("tie")))
    tails = (slotted.select("entity", "slot", "us", "tie", "anomaly_score", newest.alias("_r")).filter(F.col("_r") <= back)
             .groupBy("entity", "slot").agg(F.sort_array(F.collect_list(F.struct("us", "tie", "anomaly_score"))).alias("_tail")))
    earlier = F.flatten(F.collect_list(F.transform("_tail", lambda s: s["anomaly_score"])).over(
        W.partitionBy("entity").orderBy("slot").rowsBetween(-back, -1)))
    carry = tails.select("entity", "slot", earlier.alias("_earlier"))
    own = F.collect_list("anomaly_score").over(group.orderBy("us", "tie").rowsBetween(-back, 0))
    joined = slotted.withColumn("_own", own).join(carry, ["entity", "slot"])
    whole = F.concat("_earlier", "_own")
    return joined.select(*events.columns, F.slice(whole, F.greatest(F.size(whole) - back, F.lit(1)), length).alias("score_history"))
