"""Streaming queries replayed over the tables as far as available. Their check SQL is batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import epoch_bucket
from ..operators import scoring
from ..operators.normalize_cloud import normalize_cloudtrail
from ..operators.features import windowed_counts
from ..operators.relational_models import given_model
from ..schema import ALERTS, FEATURES
from ..session import reliable, shared_dir
from ..sources.logs import read_lines
from ..sources.tables import read_table
from ..streaming import feeds
from ..streaming.features import feature_stream
from .driver_tables import (activity, activity_columns, alert_table, as_security_events, incident_table, table)
from .feature_queries import ORACLES as FEATURE_ORACLES
from .incident_queries import AKPI, IA, KPI
from .model_queries import GIVEN
from .raw_lines import auth_lines, cloud_lines, syslog_lines
from .reference_sql import EV
from .source_queries import AUTH_ACTION, AUTH_OUTCOME, CLOUD_ACTION, INGEST, R


def event_stream(spark, sf):
    """The event table as a stream of its file."""
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return as_security_events(activity_columns(raw))


def replay(spark, stream, name, mode="append"):
    out = shared_dir(spark, name)
    feeds.run_available(stream, shared_dir(spark, name + "-checkpoint"), out, mode=mode)
    return spark.read.schema(stream.schema).parquet(out)


def normalized(spark, sf):
    """Two raw topics written as text, read as one normalized stream."""
    root = shared_dir(spark, "topics")
    acts = activity(spark, sf)
    auth_lines(acts).select("raw").write.text(f"{root}/raw.auth")
    syslog_lines(acts).select("raw").write.text(f"{root}/raw.syslog")
    stream = feeds.topics(spark, root, {"raw.auth": "auth", "raw.syslog": "syslog"}, year=2024, ingest_time=INGEST)
    events = replay(spark, stream.drop("id"), "normalized")
    return events.groupBy(F.col("log.source_type").alias("source_type"), F.col("event.action").alias("action")).agg(
        F.count(F.lit(1)).alias("n"))


def dead_letters(spark, sf):
    path, good, bad = (shared_dir(spark, n) for n in ("raw-cloud", "good", "dead"))
    cloud_lines(activity(spark, sf)).select("raw").write.text(path)
    write = feeds.split_writer("cloudtrail", lambda d: normalize_cloudtrail(d, INGEST), good, bad)
    feeds.run_available(read_lines(spark, path, stream=True), shared_dir(spark, "dead-checkpoint"), each_batch=write)
    return (spark.read.parquet(good).groupBy(F.col("event.action").alias("action")).agg(F.count(F.lit(1)).alias("n"))
            .unionByName(spark.read.parquet(bad).groupBy(F.lit("dead letter").alias("action")).agg(F.count(F.lit(1)).alias("n"))))


def upserted(spark, stream, name, keys):
    """The present state of a windowed aggregation, open windows included."""
    out = shared_dir(spark, name)
    feeds.run_available(stream, shared_dir(spark, name + "-checkpoint"), each_batch=feeds.upsert_writer(out), mode="update")
    return feeds.latest(spark, out, keys)


def windows(spark, sf):
    w = windowed_counts(event_stream(spark, sf), "5 minutes", "1 minute", watermark=feeds.WATERMARK)
    present = upserted(spark, w, "windows", ["entity", "window_start"])
    return present.select("entity", F.unix_micros("window_start").alias("start_us"), "events", "failures", "bytes")


def clusters(spark, sf):
    c = feeds.cluster_stream(event_stream(spark, sf), F.col("event.action"))
    present = upserted(spark, c, "clusters", ["entity", "technique_id", "window_start"])
    return present.select("entity", "technique_id", F.unix_micros("window_start").alias("start_us"), "cluster_size")


def sessions(spark, sf):
    """Closed sessions as the stream wrote them, and those its state holds open at the end of the input."""
    s = feeds.session_stream(event_stream(spark, sf), F.col("event.action"))
    out, checkpoint = shared_dir(spark, "sessions"), shared_dir(spark, "sessions-checkpoint")
    feeds.run_available(s, checkpoint, out)
    every = spark.read.schema(s.schema).parquet(out).unionByName(feeds.open_sessions(spark, checkpoint))
    return every.select("entity", "technique_id", F.unix_micros("session_start").alias("start_us"),
                        F.unix_micros("session_end").alias("end_us"), "alert_count")


def deduplicated(spark, sf):
    """An alert feed in which every alert arrives twice."""
    path = shared_dir(spark, "feed")
    alerts = alert_table(spark, sf).select("id", "incident_id", "created_at")
    alerts.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).write.parquet(path)
    stream = spark.readStream.schema("id string, incident_id string, created_at timestamp, copy int").parquet(path)
    return replay(spark, feeds.emit_once(stream), "once").select("id", "incident_id")


STEP_FILES = 8


def in_steps(spark, sf, of_stream, name, path=None, each_batch=None):
    """Replays the activity in time-ordered micro-batches of a third each."""
    source = shared_dir(spark, name + "-steps")
    events = table(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(us), F.max(us)).first()
    third = F.least(F.floor((us - low) * 3 / F.lit(max(high - low, 1))), F.lit(2))
    for step in range(3):
        events.filter(third == step).repartition(STEP_FILES).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", STEP_FILES).parquet(source)
    feeds.run_available(of_stream(as_security_events(activity_columns(stream))), shared_dir(spark, name + "-checkpoint"), path, each_batch=each_batch)


def stream_features(spark, sf):
    out = shared_dir(spark, "stream-features")
    in_steps(spark, sf, feature_stream, "stream-features", path=out)
    f = spark.read.parquet(out).filter(~F.col("late"))
    return f.select(F.col("id").cast("bigint").alias("event_id"), "entity", *[F.round(c, 4).alias(c) for c in FEATURES])


def late_events(spark, sf):
    """Every tenth event of the first half is held back until all others have arrived."""
    source, checkpoint, out = (shared_dir(spark, n) for n in ("late-steps", "late-checkpoint", "late-out"))
    events = table(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    middle = events.agg(((F.min(us) + F.max(us)) / 2).alias("m")).first()[0]
    held = (us <= F.lit(middle)) & (F.col("event_id") % 10 == 0)
    for part in (events.filter(~held), events.filter(held)):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        feeds.run_available(feature_stream(as_security_events(activity_columns(stream))), checkpoint, out)
    return spark.read.parquet(out).filter("late").select(F.col("id").cast("bigint").alias("event_id"), "entity")


def stream_alerts_given_model(spark, sf):
    """Stream features scored by the given model in every micro-batch; events above the threshold become alerts."""
    root = shared_dir(spark, "given-alerts")
    model = given_model(spark)

    def store(features, batch_id):
        hot = scoring.score(features.filter(~F.col("late")), model).filter("anomaly_score > 0.4")
        hot.select("id", "entity", "anomaly_score").write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    in_steps(spark, sf, feature_stream, "given-alerts", each_batch=store)
    return spark.read.parquet(root).select(F.col("id").cast("bigint").alias("event_id"), "entity", F.round("anomaly_score", 3).alias("anomaly_score"))


def stream_alerts(spark, sf):
    """Stream features scored by a stored model; events above the threshold become alerts."""
    from .feature_queries import all_features
    from .model_queries import trained_on_events
    base = reliable(all_features(spark, sf).withColumn("id", F.col("event_id").cast("string")), "train")
    model = trained_on_events(spark, base)
    root = shared_dir(spark, "alert-stream")

    def store(features, batch_id):
        hot = scoring.score(features.filter(~F.col("late")), model).filter("anomaly_score > 0.4")
        hot.select("id", "entity", "us", "anomaly_score", "top_features").write.mode("overwrite").parquet(f"{root}/alerts/batch={batch_id}")

    in_steps(spark, sf, feature_stream, "alert-stream", each_batch=store)
    return spark.read.parquet(f"{root}/alerts").select(F.col("id").cast("bigint").alias("event_id"), "entity", "anomaly_score")


def kpi_refresh(spark, sf):
    """Alerts arrive in two steps; the KPI row is recomputed from the stored tables after each."""
    store, out = shared_dir(spark, "kpi-store"), shared_dir(spark, "kpi")
    checkpoint = shared_dir(spark, "kpi-checkpoint")
    incidents = incident_table(spark, sf)
    alerts = alert_table(spark, sf).withColumn("entity", F.to_json("entity")).withColumn("source_type", F.lit("unknown"))
    columns = [f.split()[0] for f in ALERTS.split(", ")]
    write = feeds.kpi_writer(lambda: incidents, lambda: read_table(spark, store, "alerts"), out)
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    for step in (0, 1):
        alerts.filter(half == step).select(*columns).write.mode("append").parquet(f"{store}/alerts")
        feeds.run_available(spark.readStream.schema(ALERTS).parquet(f"{store}/alerts"), checkpoint, each_batch=write)
    k = spark.read.parquet(out).orderBy(F.desc("batch_id")).limit(1)
    return k.select("total_incidents", "critical_open", "resolved", F.round("avg_resolution_minutes", 4).alias("avg_resolution_minutes"),
                    "total_alerts", "new_alerts", F.round("avg_score", 6).alias("avg_score"))


QUERIES = {
    "stream_normalized_topics": normalized, "stream_dead_letters": dead_letters, "stream_windowed_counts": windows,
    "stream_clusters": clusters, "stream_sessions": sessions, "stream_alerts_once": deduplicated,
    "stream_feature_vector": stream_features, "stream_scored_alerts": stream_alerts,
    "stream_scored_given_model": stream_alerts_given_model, "stream_late_rows": late_events, "stream_kpi_refresh": kpi_refresh,
}

SYSLOG_ACTION = ("CASE event_type WHEN 'error' THEN 'ssh_login_failed' WHEN 'signup' THEN 'ssh_login_success' "
                 "WHEN 'view' THEN 'ssh_login_success' ELSE 'syslog_message' END")

ORACLES = {
    "stream_normalized_topics": f"""{R} SELECT 'auth_log' AS source_type, {AUTH_ACTION} AS action, count(*) AS n FROM r GROUP BY ALL
        UNION ALL SELECT 'syslog', {SYSLOG_ACTION}, count(*) FROM r GROUP BY ALL""",
    "stream_dead_letters": f"""{R} SELECT CASE WHEN broken THEN 'dead letter' ELSE {CLOUD_ACTION} END AS action, count(*) AS n
        FROM r GROUP BY ALL""",
    "stream_windowed_counts": f"""WITH {EV} SELECT entity, start_us, count(*) AS events, count(*) FILTER (outcome = 'failure') AS failures,
          CAST(sum(nbytes) AS BIGINT) AS bytes
        FROM (SELECT *, unnest(range(5)) AS i, (us // 60000000 - i) * 60000000 AS start_us FROM e) GROUP BY ALL""",
    "stream_clusters": f"""WITH {EV} SELECT entity2 AS entity, action AS technique_id, bucket * 300000000 AS start_us,
        count(*) AS cluster_size FROM e GROUP BY ALL""",
    "stream_sessions": f"""WITH {EV}, g AS (SELECT *, coalesce(us - lag(us) OVER w > 300000000, true) AS fresh FROM e
          WINDOW w AS (PARTITION BY entity2, action ORDER BY us, event_id)),
        s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY entity2, action ORDER BY us, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g)
        SELECT entity2 AS entity, action AS technique_id, min(us) AS start_us, max(us) + 300000000 AS end_us, count(*) AS alert_count
        FROM s GROUP BY entity2, action, sid""",
    "stream_alerts_once": f"{IA} SELECT id, incident_id FROM al",
    "stream_feature_vector": FEATURE_ORACLES["feature_vector"],
    "stream_scored_given_model": f"""{GIVEN} SELECT event_id, entity, round(CAST(printf('%.4f', blended) AS DOUBLE), 3) AS anomaly_score
        FROM scored JOIN e USING (event_id) WHERE CAST(printf('%.4f', blended) AS DOUBLE) > 0.4""",
    "stream_late_rows": f"""WITH {EV}, half AS (SELECT (min(raw_us) + max(raw_us)) / 2 AS middle FROM e),
        h AS (SELECT e.*, raw_us <= middle AND event_id % 10 = 0 AS held FROM e CROSS JOIN half)
        SELECT event_id, entity FROM h WHERE held AND (bucket + 1) * 300000 <= (SELECT max(us) // 1000 - 600000 FROM h WHERE NOT held)""",
    "stream_kpi_refresh": f"{IA} SELECT * FROM (SELECT {KPI} FROM inc) CROSS JOIN (SELECT {AKPI} FROM al)",
}
