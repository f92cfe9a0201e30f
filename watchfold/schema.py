"""The one event schema all sources are normalized to."""

from pyspark.sql import types as T

GEO = T.StructType([
    T.StructField("country_iso_code", T.StringType()),
    T.StructField("city_name", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("location", T.StructType([
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
    ])),
])

AUTONOMOUS_SYSTEM = T.StructType([
    T.StructField("number", T.IntegerType()),
    T.StructField("organization_name", T.StringType()),
])

EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("timestamp_unix", T.DoubleType()),
    T.StructField("event", T.StructType([
        T.StructField("kind", T.StringType()),
        T.StructField("category", T.ArrayType(T.StringType())),
        T.StructField("action", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("id", T.StringType()),
    ])),
    T.StructField("source", T.StructType([
        T.StructField("ip", T.StringType()),
        T.StructField("port", T.IntegerType()),
        T.StructField("geo", GEO),
        T.StructField("as", AUTONOMOUS_SYSTEM),
    ])),
    T.StructField("destination", T.StructType([
        T.StructField("ip", T.StringType()),
        T.StructField("port", T.IntegerType()),
        T.StructField("host", T.StringType()),
    ])),
    T.StructField("user", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("domain", T.StringType()),
    ])),
    T.StructField("host", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("os_family", T.StringType()),
        T.StructField("ip", T.StringType()),
    ])),
    T.StructField("log", T.StructType([
        T.StructField("source_type", T.StringType()),
        T.StructField("raw", T.StringType()),
    ])),
    T.StructField("related", T.StructType([T.StructField("hash", T.StringType())])),
    T.StructField("network", T.StructType([T.StructField("bytes", T.LongType())])),
    T.StructField("process", T.StructType([
        T.StructField("command_line", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("name", T.StringType()),
    ])),
    T.StructField("ts_fallback", T.BooleanType()),
])

FEATURES = [
    "event_count_1m", "event_count_5m", "event_count_1h",
    "failed_auth_ratio", "distinct_dest_ports", "dest_ip_fanout",
    "bytes_transferred", "tod_zscore", "geo_velocity_kmh",
]

INCIDENTS = ("id string, entity string, technique string, tactic string, severity string, "
             "status string, confidence double, rationale string, "
             "created_at timestamp, updated_at timestamp")
ALERTS = ("id string, incident_id string, entity string, anomaly_score double, status string, "
          "severity string, source_type string, created_at timestamp")
LEDGER = ("incident_id string, seq bigint, action string, actor string, "
          "previous_hash string, this_hash string, timestamp string")

# Allowed values, fixed.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
ALERT_STATUSES = ["new", "ack", "escalated", "closed"]
INCIDENT_STATUSES = ["open", "investigating", "resolved", "false_positive"]
ENTITY_ROLES = ["attacker", "victim", "pivot", "context"]
