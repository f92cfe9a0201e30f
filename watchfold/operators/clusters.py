"""Alert clusters. Members stay in the event table and are reached by key, so that no cluster is
ever collected into one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import clock_bucket, epoch_bucket


def cluster_by_entity(scored: DataFrame, *payload: str, entity: str = "entity", score: str = "anomaly_score",
                      us: str = "us", tie: str = "tie") -> DataFrame:
    """One cluster per entity: size, max score, first event, and ``payload`` columns of the first
    event that reaches the maximum. All aggregates combine before the shuffle."""
    arrival = F.struct(us, tie)
    best = F.struct(F.coalesce(F.col(score), F.lit(0.0)), -F.col(us), -F.col(tie))
    return scored.groupBy(F.col(entity).alias("entity")).agg(
        F.count(F.lit(1)).alias("cluster_size"),
        F.max(F.coalesce(F.col(score), F.lit(0.0))).alias("max_score"),
        F.min_by("id", arrival).alias("first_event_id"),
        F.max_by(F.struct("id", *payload), best).alias("top"),
    ).select("entity", "cluster_size", "max_score", "first_event_id",
             F.col("top.id").alias("top_event_id"), *[F.col(f"top.{p}").alias(p) for p in payload])


def cluster_events(events: DataFrame, ignore_date: bool = False) -> DataFrame:
    """Clusters by (entity, technique, 5-minute bucket).

    ``events`` has entity, technique_id, us, tie. ``ignore_date`` buckets by clock time only, so
    that equal times of different days fall together.
    """
    if ignore_date:
        bucket = clock_bucket(F.date_format(F.timestamp_micros("us"), "HH:mm:ss"))
    else:
        bucket = epoch_bucket("us")
    return (events.withColumn("bucket", bucket)
            .groupBy("entity", "technique_id", "bucket")
            .agg(F.count(F.lit(1)).alias("cluster_size"),
                 F.min("us").alias("first_us"), F.max("us").alias("last_us"),
                 F.min(F.struct("us", "tie")).alias("_first")))


def largest_first(clusters: DataFrame) -> DataFrame:
    return clusters.orderBy(F.desc("cluster_size"), "_first").drop("_first")


def find_cluster(events: DataFrame, entity: str, technique_id: str, us: int) -> DataFrame:
    """The member events of one cluster."""
    bucket = us // 300_000_000
    return events.filter((F.col("entity") == entity) & (F.col("technique_id") == technique_id)
                         & (epoch_bucket("us") == bucket))
