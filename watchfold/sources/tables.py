"""Tables the engine keeps: event history, feature snapshots, incidents, alerts and ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

TABLES = {"incidents": schema.INCIDENTS, "alerts": schema.ALERTS, "ledger": schema.LEDGER}


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Event history by day. Rows go to tasks by (day, hash of id), so a busy day is still
    written by many tasks, and each task writes few files."""
    dated = events.withColumn("event_date", F.to_date("timestamp"))
    dated.repartition("event_date", F.pmod(F.xxhash64("id"), F.lit(64))).write.mode(mode) \
        .partitionBy("event_date").parquet(path)


def write_snapshots(features: DataFrame, path: str, mode: str = "append") -> None:
    """Feature snapshots by week of their window end."""
    week = F.to_date(F.date_trunc("week", F.timestamp_micros("us")))
    weekly = features.withColumn("week", week)
    weekly.repartition("week", F.pmod(F.xxhash64("id"), F.lit(64))).write.mode(mode) \
        .partitionBy("week").parquet(path)


def _columns(name: str) -> list[str]:
    return [f.split()[0] for f in TABLES[name].split(", ")]


def append_table(df: DataFrame, root: str, name: str, run: str) -> None:
    """Add the rows of a run to one of the three incident tables; columns as declared, in order.

    Each run overwrites its own directory, so a repeated run leaves one copy.
    """
    df.select(*_columns(name)).write.mode("overwrite").parquet(f"{root}/{name}/run={run}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}").select(*_columns(name))
