"""Incident and alert tables: creation, status changes, current state, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ALERT_STATUSES, INCIDENT_STATUSES
from .ranks import salted_join, slotted_rank


def incident_key(*parts: Column) -> Column:
    """Deterministic id, so that a rerun of the same batch creates the same rows."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def new_incidents(triaged: DataFrame, run: str, now) -> DataFrame:
    at = F.lit(now).cast("timestamp")
    return triaged.select(
        incident_key(F.col("entity"), F.lit(run)).alias("id"), "entity",
        F.col("technique_id").alias("technique"), "tactic", "severity", F.lit("open").alias("status"),
        "confidence", "rationale", at.alias("created_at"), at.alias("updated_at"))


def new_alerts(anomalies: DataFrame, incidents: DataFrame, now) -> DataFrame:
    """One alert per anomalous event, with the severity of its incident."""
    owner = incidents.select("entity", F.col("id").alias("incident_id"), "severity")
    joined = salted_join(anomalies, owner, "entity", "inner")
    return joined.select(
        incident_key(F.col("incident_id"), F.col("id")).alias("id"), "incident_id", "entity",
        F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"), F.lit("new").alias("status"),
        "severity", F.coalesce("source_type", F.lit("unknown")).alias("source_type"),
        F.lit(now).cast("timestamp").alias("created_at"))


def creation_actions(incidents: DataFrame) -> DataFrame:
    return incidents.select(F.col("id").alias("incident_id"), F.lit("created").alias("action"),
                            F.lit("system").alias("actor"), iso_text("created_at").alias("timestamp"))


def iso_text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def split_changes(changes: DataFrame, known: DataFrame, allowed: list[str] = INCIDENT_STATUSES,
                  key: str = "incident_id") -> tuple[DataFrame, DataFrame]:
    """Changes (key, new_status, actor, ts) that may be applied, and the rest with the reason."""
    ids = known.select(F.col("id").alias(key), F.lit(True).alias("_known"))
    judged = changes.join(ids, key, "left").withColumn(
        "reason", F.when(~F.coalesce(F.col("new_status").isin(allowed), F.lit(False)), "invalid status")
        .when(F.col("_known").isNull(), "unknown id")).drop("_known")
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def status_actions(changes: DataFrame) -> DataFrame:
    """Ledger actions of status changes; (ts, seq) orders them."""
    return changes.select("incident_id", F.concat(F.lit("status_changed_to_"), "new_status").alias("action"),
                          "actor", iso_text("ts").alias("timestamp"), "ts", "seq")


def current_state(table: DataFrame, changes: DataFrame, key: str = "incident_id") -> DataFrame:
    """The table with the last change of each row applied."""
    last = changes.groupBy(F.col(key).alias("id")).agg(
        F.max_by(F.struct("new_status", "ts"), F.struct("ts", "seq")).alias("_c"))
    out = table.join(last, "id", "left")
    out = out.withColumn("status", F.coalesce("_c.new_status", "status"))
    if "updated_at" in table.columns:
        out = out.withColumn("updated_at", F.coalesce("_c.ts", "updated_at"))
    return out.select(*table.columns)


def alert_change_payloads(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Ledger payloads of the valid alert status changes in the order (ts, seq).

    The previous status is that of the alert's change before, or of the table for the first one. An alert
    without an incident goes to the orphan ledger; changes with an unknown status or alert are left out.
    """
    valid, _ = split_changes(changes, alerts.select("id"), ALERT_STATUSES, "alert_id")
    start = alerts.select(F.col("id").alias("alert_id"), "incident_id", F.col("status").alias("_start"))
    before = F.lag("new_status").over(Window.partitionBy("alert_id").orderBy("ts", "seq", "new_status", "actor"))
    owned = valid.join(start, "alert_id").withColumn("_old", F.coalesce(before, "_start"))
    payload = F.to_json(F.struct(F.lit("alert_status_updated").alias("action"), "alert_id",
                                 F.col("_old").alias("from"), F.col("new_status").alias("to"), "actor"))
    return owned.select(F.coalesce("incident_id", F.lit("inc_orphan")).alias("incident_id"),
                        payload.alias("payload"), iso_text("ts").alias("timestamp"), "ts", "seq")


def approval_payloads(approvals: DataFrame) -> DataFrame:
    payload = F.to_json(F.struct(F.lit("playbook_approved").alias("action"), "incident_id", "actor"))
    return approvals.select("incident_id", payload.alias("payload"), iso_text("ts").alias("timestamp"))


def bulk_changes(ids: DataFrame, new_status: str, actor: str, ts, key: str = "alert_id") -> DataFrame:
    """The same status change for every id of a frame."""
    if new_status not in ALERT_STATUSES + INCIDENT_STATUSES:
        raise ValueError(f"Invalid status '{new_status}'")
    return ids.select(F.col(key), F.lit(new_status).alias("new_status"), F.lit(actor).alias("actor"),
                      F.lit(ts).cast("timestamp").alias("ts"), F.lit(0).cast("bigint").alias("seq"))


def assign(alerts: DataFrame, ids: DataFrame, assignee: str) -> DataFrame:
    """Alerts with ``assignee`` set where their id is listed."""
    marked = ids.select("id", F.lit(assignee).alias("_a")).distinct()
    out = alerts.join(marked, "id", "left")
    old = F.col("assignee") if "assignee" in alerts.columns else F.lit(None).cast("string")
    return out.withColumn("assignee", F.coalesce("_a", old)).drop("_a")


def with_children(parents: DataFrame, children: DataFrame, key: str, slot: Column, order: list,
                  fields: list[str], page_size: int = 1000) -> DataFrame:
    """Parents with their ordered children nested in pages of bounded length.

    A parent without children has one empty page. All children are kept; a parent with many
    simply has many pages, so no row grows with the data.
    """
    ranked = slotted_rank(children, [key], slot, order, "_rank")
    page = F.call_function("div", F.col("_rank") - 1, F.lit(page_size))
    pages = ranked.withColumn("page", page).groupBy(key, "page").agg(
        F.sort_array(F.collect_list(F.struct("_rank", *fields))).alias("children"))
    return (parents.join(pages, parents["id"] == pages[key], "left").drop(pages[key])
            .withColumn("page", F.coalesce("page", F.lit(0))))


def incident_details(incidents: DataFrame, alerts: DataFrame, page_size: int = 1000) -> DataFrame:
    return with_children(incidents, alerts, "incident_id", F.to_date("created_at"), ["created_at", "alert_id"],
                         ["alert_id", "anomaly_score"], page_size)


def incident_counts(alerts: DataFrame) -> DataFrame:
    """alert_count and entity_count per incident."""
    return alerts.groupBy("incident_id").agg(F.count(F.lit(1)).alias("alert_count"),
                                             F.count_distinct("entity").alias("entity_count"))


def incident_timeline(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """The events behind each incident's alerts; (incident_id, event time) orders a timeline."""
    return alerts.select("incident_id", "event_id").join(events, "event_id")
