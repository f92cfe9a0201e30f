"""Labelled network-flow rows (all columns text) to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import blank_to_null
from ..functions.text import strip
from .events import event_columns, filled_time, with_custody_hash
from .normalize_cloud import lookup
from .normalize_text import with_line_id

INTRUSION = ["network", "intrusion_detection"]
WEB = ["network", "web", "intrusion_detection"]
# Label -> action, outcome, categories, fixed values.
LABELS = {
    "BENIGN": ("network_flow", "success", ["network"]),
    "FTP-Patator": ("ftp_brute_force", "failure", INTRUSION),
    "SSH-Patator": ("ssh_brute_force", "failure", INTRUSION),
    "DoS slowloris": ("dos_slowloris", "failure", INTRUSION),
    "DoS Slowhttptest": ("dos_slowhttp", "failure", INTRUSION),
    "DoS Hulk": ("dos_hulk", "failure", INTRUSION),
    "DoS GoldenEye": ("dos_goldeneye", "failure", INTRUSION),
    "Heartbleed": ("heartbleed_exploit", "failure", INTRUSION),
    "Web Attack – Brute Force": ("web_brute_force", "failure", WEB),
    "Web Attack – XSS": ("web_xss", "failure", WEB),
    "Web Attack – Sql Injection": ("web_sqli", "failure", WEB),
    "Infiltration": ("infiltration", "failure", INTRUSION),
    "Bot": ("botnet_activity", "failure", INTRUSION),
    "PortScan": ("port_scan", "failure", INTRUSION),
    "DDoS": ("ddos", "failure", INTRUSION),
}
# Day-first, then ISO, then month-first; one letter accepts one or two digits. Fixed values.
TIME_FORMATS = ["d/M/yyyy H:m:s", "d/M/yyyy H:m", "yyyy-M-d H:m:s", "M/d/yyyy H:m"]


def trimmed_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def first_present(df: DataFrame, *names: str) -> Column:
    """The first of alternative column names this file has, else null."""
    for name in names:
        if name in df.columns:
            return F.col(f"`{name}`")
    return F.lit(None).cast("string")


def safe_double(c: Column) -> Column:
    value = strip(c).try_cast("double")
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.coalesce(F.when(finite, value), F.lit(0.0))


def safe_integer(c: Column, kind: str = "bigint") -> Column:
    """Text to integer through double, truncating; anything else is 0."""
    return F.coalesce(safe_double(c).try_cast(kind), F.lit(0).cast(kind))


def flow_time(text: Column) -> Column:
    text = strip(text)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS])


def normalize_cicids(rows: DataFrame, ingest_time=None) -> DataFrame:
    df = trimmed_columns(with_line_id(rows))

    def col(*names: str) -> Column:
        return first_present(df, *names)

    label = strip(F.coalesce(col("Label"), F.lit(""))) if "Label" in df.columns else F.lit("BENIGN")
    source_ip = blank_to_null(strip(col("Source IP", "Src IP")))
    dest_ip = blank_to_null(strip(col("Destination IP", "Dst IP")))
    source_port = safe_integer(col("Source Port", "Src Port"), "int")
    dest_port = safe_integer(col("Destination Port", "Dst Port"), "int")
    summary = F.to_json(F.struct(
        label.alias("label"),
        safe_double(col("Flow Duration")).alias("flow_duration"),
        safe_integer(col("Total Fwd Packets")).alias("total_fwd_packets"),
        safe_integer(col("Total Backward Packets", "Total Bwd Packets")).alias("total_bwd_packets"),
        safe_double(col("Flow Bytes/s")).alias("flow_bytes_per_s"),
        safe_double(col("Flow Packets/s")).alias("flow_packets_per_s"),
        safe_double(col("Fwd Packet Length Mean")).alias("fwd_packet_length_mean"),
        safe_double(col("Bwd Packet Length Mean")).alias("bwd_packet_length_mean"),
        safe_double(col("Flow IAT Mean")).alias("flow_iat_mean"),
    ))
    time, fallback = filled_time(flow_time(col("Timestamp", "Flow ID")), ingest_time)
    values = {
        "id": F.col("line_id"), "event.id": F.col("line_id"),
        "timestamp": time, "ts_fallback": fallback,
        "event.kind": F.lit("event"),
        "event.action": F.coalesce(lookup(LABELS, label, 0), F.replace(F.lower(label), F.lit(" "), F.lit("_"))),
        "event.outcome": F.coalesce(lookup(LABELS, label, 1), F.lit("unknown")),
        "event.category": F.coalesce(lookup(LABELS, label, 2), F.array(F.lit("network"))),
        "source.ip": source_ip, "source.port": F.when(source_port != 0, source_port),
        "destination.ip": dest_ip, "destination.host": dest_ip,
        "destination.port": F.when(dest_port != 0, dest_port),
        "host.name": F.coalesce(dest_ip, F.lit("unknown")),
        "log.source_type": F.lit("cicids"), "log.raw": summary,
    }
    return with_custody_hash(df.select(*event_columns(values)))
