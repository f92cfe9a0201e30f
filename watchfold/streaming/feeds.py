"""Streaming sources, clean/dead-letter split, deduplicated feeds and windowed aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import entity_cluster
from ..functions.text import strip
from ..operators.dashboards import kpis
from ..operators.normalize_flow import normalize_cicids
from ..settings import CLUSTER_WINDOW
from ..sources.logs import get_normalizer, read_flows, read_lines, split_bad, union_events

WATERMARK = "10 minutes"


def raw_stream(spark: SparkSession, path: str, fmt: str = "text", **options) -> DataFrame:
    """Raw records as ``raw``: files below a path, or a Kafka topic where the connector is on
    the class path."""
    if fmt == "text":
        return read_lines(spark, path, stream=True, **options)
    stream = spark.readStream.format(fmt).options(**options).load()
    return stream.select(strip(F.col("value").cast("string")).alias("raw")).filter(F.length("raw") > 0)


def normalized_stream(spark: SparkSession, path: str, source_type: str, flow_schema=None, options: dict | None = None,
                      **normalizer_options) -> DataFrame:
    normalize = get_normalizer(source_type)
    if normalize is normalize_cicids:
        return normalize(read_flows(spark, path, stream_schema=flow_schema), **normalizer_options)
    return normalize(raw_stream(spark, path, **(options or {})), **normalizer_options)


def topics(spark: SparkSession, root: str, names: dict[str, str], **normalizer_options) -> DataFrame:
    """One stream from several raw topics, given as topic directory -> source type."""
    return union_events(*[normalized_stream(spark, f"{root}/{name}", kind, **normalizer_options)
                          for name, kind in names.items()])


def split_writer(source_type: str, normalize: Callable[[DataFrame], DataFrame], good_path: str, bad_path: str):
    """foreachBatch function: events to one table, dead letters with their time to another.

    Each micro-batch overwrites its own directory, so a retried batch leaves no duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_bad(batch, source_type)
        normalize(good).write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        bad.withColumn("ts", F.current_timestamp()).write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}")
    return write


def emit_once(alerts: DataFrame, time: str = "created_at", delay: str = WATERMARK) -> DataFrame:
    """Each alert id once; ids are forgotten when the watermark has passed them."""
    return alerts.withWatermark(time, delay).dropDuplicatesWithinWatermark(["id"])


def cluster_stream(events: DataFrame, technique, delay: str = WATERMARK) -> DataFrame:
    """Cluster sizes by (entity, technique, 5 minutes)."""
    keyed = events.select("timestamp", entity_cluster().alias("entity"), technique.alias("technique_id"))
    return keyed.withWatermark("timestamp", delay).groupBy(
        F.window("timestamp", "5 minutes").alias("w"), "entity", "technique_id").agg(
        F.count(F.lit(1)).alias("cluster_size")).select(
        "entity", "technique_id", F.col("w.start").alias("window_start"), "cluster_size")


def session_stream(events: DataFrame, technique, gap: int = CLUSTER_WINDOW, delay: str = WATERMARK) -> DataFrame:
    """Incident sessions per (entity, technique): a gap of more than ``gap`` seconds closes one, as in batch.

    Spark's session window takes a gap of its own length as closed, so it is one microsecond longer here;
    ``session_end`` is ``gap`` after the last event.
    """
    keyed = events.select("timestamp", entity_cluster().alias("entity"), technique.alias("technique_id"))
    return keyed.withWatermark("timestamp", delay).groupBy(
        F.session_window("timestamp", f"{gap} seconds 1 microsecond").alias("w"), "entity", "technique_id").agg(
        F.count(F.lit(1)).alias("alert_count")).select(
        "entity", "technique_id", F.col("w.start").alias("session_start"), _last_instant(F.col("w.end")).alias("session_end"), "alert_count")


def _last_instant(end: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(end) - 1)


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Sessions of `session_stream` that its state still holds open, read from the checkpoint of its stopped query.

    Together with what the stream has written they are the sessions of all input so far.
    """
    state = spark.read.format("statestore").option("path", checkpoint).load()
    return state.select(
        F.col("key.entity").alias("entity"), F.col("key.technique_id").alias("technique_id"),
        F.col("value.session_window.start").alias("session_start"), _last_instant(F.col("value.session_window.end")).alias("session_end"),
        F.col("value.count").alias("alert_count"))


def upsert_writer(path: str):
    """foreachBatch function for update mode: the windows that a micro-batch changed, open ones included."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The present row of every key of an `upsert_writer` table."""
    rows = spark.read.parquet(path)
    present = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "batch").alias("_row"))
    return present.select(*keys, "_row.*").drop("batch")


def kpi_writer(incidents: Callable[[], DataFrame], alerts: Callable[[], DataFrame], path: str):
    """foreachBatch function: the KPI row over the stored tables after each micro-batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        kpis(incidents(), alerts()).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}")
    return write


def run_available(stream: DataFrame, checkpoint: str, path: str | None = None, each_batch=None, mode: str = "append") -> None:
    """Process everything available now into a parquet table or a batch function."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.foreachBatch(each_batch) if each_batch else writer.format("parquet").option("path", path)).start()
    query.awaitTermination()
