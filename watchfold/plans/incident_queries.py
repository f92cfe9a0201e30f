"""Incident, alert, ledger and dashboard queries, with their check SQL. ``orders`` stand in for
incidents, ``lineitem`` for alerts and ``conversations`` for ledger actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboards as D
from ..operators import incidents as I
from ..operators import ledger as L
from ..operators import rollups as R
from ..operators.evaluation import percentiles
from ..session import reliable, shared_dir
from ..sources.rules import load_rules
from ..sources.tables import append_table, read_table
from .detection import anomalies, contexts, triaged_clusters
from .detection_queries import BAND, TRIAGE, usable_rules
from .driver_tables import (TECHNIQUE_LIST, alert_table, call_log, chat_actions, incident_table, security_events)
from .reference_sql import EV

NOW = "2024-03-01 12:00:00"


def us(c: str, name: str | None = None):
    return F.unix_micros(c).alias(name or c)


def filtered_incidents(spark, sf):
    return D.filter_incidents(incident_table(spark, sf), status="open", severity="critical", owner="ignored").select(
        "id", "entity", "technique", us("created_at"))


def filtered_alerts(spark, sf):
    return D.filter_alerts(alert_table(spark, sf), severity="high", status="ack", entity_search="HOST-1").select(
        "id", "incident_id", "anomaly_score")


def alerts_csv_filter(spark, sf):
    return D.filter_alerts(alert_table(spark, sf), severity="critical, high", status="new,closed",
                           technique="T1046,T1021", since="1997-01-01", until="1998-06-30 12:00:00").select("id", us("created_at"))


def busiest_incident_alerts(spark, sf):
    """Alerts of one incident: the one with most alerts (ties: the lowest id)."""
    alerts = alert_table(spark, sf)
    top = I.incident_counts(alerts).orderBy(F.desc("alert_count"), "incident_id").limit(1).select("incident_id")
    return alerts.join(F.broadcast(top), "incident_id", "left_semi").select("id", "incident_id", "severity")


def technique_incidents(spark, sf):
    t = incident_table(spark, sf)
    return t.filter(D.of_technique(F.col("technique"), "T1021")).select("id", "technique")


def technique_first_20(spark, sf):
    t = incident_table(spark, sf)
    return D.newest(t.filter(D.of_technique(F.col("technique"), "T1110")), 20).select("id", "technique", us("created_at"))


def severity_tab(spark, sf):
    t = incident_table(spark, sf)
    return D.newest(t.filter(F.lower("severity") == "critical"), 50).select("id", "severity", us("created_at"))


def newest_incidents(spark, sf):
    return D.newest(incident_table(spark, sf), 20).select("id", "severity", "status", us("created_at"))


def newest_alerts(spark, sf):
    return D.newest(alert_table(spark, sf), 200).select("id", "incident_id", us("created_at"))


def alert_page(spark, sf):
    found = D.filter_alerts(alert_table(spark, sf), severity="critical")
    return D.page(found, number=3, size=50).select("id", us("created_at"), "total")


def feed(spark, sf):
    f = D.merged_feed(alert_table(spark, sf).drop("entity"), incident_table(spark, sf).drop("entity"))
    return f.orderBy(F.desc("created_at")).select("kind", "id", "severity", "anomaly_score", "confidence", us("created_at"))


def new_alerts(spark, sf):
    return D.new_only(alert_table(spark, sf)).select("id", "status")


def unseen_alerts(spark, sf):
    alerts = alert_table(spark, sf)
    return D.not_seen(alerts, alerts.filter("status in ('ack', 'closed')")).select("id")


def incident_details(spark, sf):
    alerts = alert_table(spark, sf).withColumnRenamed("id", "alert_id")
    pages = I.incident_details(incident_table(spark, sf), alerts, page_size=4)
    names = F.array_join(F.transform("children", lambda c: c["alert_id"]), ",")
    return pages.select("id", "page", F.coalesce(names, F.lit("")).alias("alerts"))


def incident_ledger(spark, sf):
    """Incidents with their ordered ledger nested in pages."""
    ledger = L.chain_entries(chat_actions(spark, sf), order=("turn",))
    incidents = ledger.select(F.col("incident_id").alias("id")).distinct()
    pages = I.with_children(incidents, ledger, "incident_id", F.lit(0), ["seq"], ["seq", "action"])
    return pages.select("id", "page", F.array_join(F.transform("children", lambda c: c["action"]), ",").alias("actions"))


def ledger_chain(spark, sf):
    return L.chain_entries(chat_actions(spark, sf), order=("turn",)).select(
        "incident_id", "seq", "action", "previous_hash", "this_hash")


def ledger_continued(spark, sf):
    """The chain built in two appends, the second continuing the stored ends of the first."""
    actions = chat_actions(spark, sf)
    first = reliable(L.chain_entries(actions.filter("turn < 2"), order=("turn",)), "ledger")
    second = L.chain_entries(actions.filter("turn >= 2"), L.last_entries(first), order=("turn",))
    return first.unionByName(second).select("incident_id", "seq", "action", "previous_hash", "this_hash")


def ledger_verified(spark, sf):
    """Every third actor is altered after the fact; verification finds each touched entry."""
    ledger = L.chain_entries(chat_actions(spark, sf), order=("turn",))
    touched = ledger.withColumn("actor", F.when(F.length("actor") % 2 == 0, F.lit("mallory")).otherwise(F.col("actor")))
    return L.verify_entries(touched).select("incident_id", "seq", "hash", F.col("valid").cast("int").alias("valid"))


def ledger_status(spark, sf):
    ledger = L.chain_entries(chat_actions(spark, sf), order=("turn",))
    touched = ledger.withColumn("action", F.when(F.col("seq") == 3, F.lit("edited")).otherwise(F.col("action")))
    s = L.chain_status(L.verify_entries(touched))
    return s.select("incident_id", F.col("valid").cast("int").alias("valid"), "entries")


def ledger_ends(spark, sf):
    return L.last_entries(L.chain_entries(chat_actions(spark, sf), order=("turn",)))


def payload_entries(spark, sf):
    p = chat_actions(spark, sf).select("incident_id", "timestamp", "turn", F.to_json(F.struct(
        F.col("turn").cast("int").alias("n"), F.col("incident_id"), F.col("actor"), F.col("action"))).alias("payload"))
    return L.chain_payloads(p, order=("turn",))


def payload_chain(spark, sf):
    return payload_entries(spark, sf).select("incident_id", "seq", "payload", "prev_hash", "hash")


def payload_verified(spark, sf):
    cut = payload_entries(spark, sf).withColumn(
        "prev_hash", F.when(F.col("seq") == 2, F.lit("x")).otherwise(F.col("prev_hash")))
    s = L.chain_status(L.verify_payloads(cut))
    return s.select("incident_id", F.col("valid").cast("int").alias("valid"), "entries")


def status_changes(spark, sf):
    """Change log derived from customers and orders: some statuses and some ids are invalid."""
    rows = incident_table(spark, sf).selectExpr(
        "case when cast(id as bigint) % 50 = 0 then concat('x', id) else id end as incident_id",
        "explode(array(0, 1)) as n", "id", "created_at")
    return rows.selectExpr(
        "incident_id", "case when n = 0 then 'investigating' when cast(id as bigint) % 20 = 1 then 'bogus' "
        "when cast(id as bigint) % 2 = 0 then 'resolved' else 'false_positive' end as new_status",
        "'analyst' as actor", "created_at + make_dt_interval(n) as ts", "cast(n as bigint) as seq")


def changes_split(spark, sf):
    good, bad = I.split_changes(status_changes(spark, sf), incident_table(spark, sf))
    parts = good.withColumn("reason", F.lit("applied")).unionByName(bad)
    return parts.groupBy("reason", "new_status").agg(F.count(F.lit(1)).alias("n"))


def current_status(spark, sf):
    incidents = incident_table(spark, sf)
    good, _ = I.split_changes(status_changes(spark, sf), incidents)
    return I.current_state(incidents, good).select("id", "status", us("updated_at"))


def status_ledger(spark, sf):
    good, _ = I.split_changes(status_changes(spark, sf), incident_table(spark, sf))
    actions = I.status_actions(good)
    return L.chain_entries(actions, order=("ts", "seq")).select("incident_id", "seq", "action", "this_hash")


def alert_payloads(spark, sf):
    """Three changes per alert, the second with an unknown status: what each ledger payload says."""
    alerts = alert_table(spark, sf)
    changes = alerts.selectExpr("id as alert_id", "explode(array(0, 1, 2)) as n", "created_at as ts").selectExpr(
        "alert_id", "element_at(array('ack', 'bogus', 'closed'), n + 1) as new_status", "'lee' as actor", "ts",
        "cast(n as bigint) as seq")
    said = F.from_json("payload", "alert_id string, `from` string, `to` string")
    return I.alert_change_payloads(alerts, changes).withColumn("p", said).select(
        "incident_id", "seq", "p.alert_id", F.col("p.from").alias("old_status"), F.col("p.to").alias("new_status"))


def acknowledged(spark, sf):
    """All new alerts acknowledged at once, with one ledger payload each."""
    alerts = alert_table(spark, sf)
    changes = I.bulk_changes(D.new_only(alerts).select(F.col("id").alias("alert_id")), "ack", "lee", NOW)
    state = I.current_state(alerts, changes, "alert_id")
    payloads = I.alert_change_payloads(alerts, changes)
    n = payloads.agg(F.count(F.lit(1))).scalar()
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("ledger_entries", n)


def assigned(spark, sf):
    alerts = alert_table(spark, sf)
    out = I.assign(alerts, alerts.filter("severity = 'critical'").select("id"), "lee")
    return out.groupBy("severity", "assignee").agg(F.count(F.lit(1)).alias("n"))


def approvals(spark, sf):
    open_ones = incident_table(spark, sf).filter("status = 'open' and severity = 'critical'")
    payloads = I.approval_payloads(open_ones.select(F.col("id").alias("incident_id"), F.lit("kim").alias("actor"),
                                                    F.lit(NOW).cast("timestamp").alias("ts")))
    return L.chain_payloads(payloads).select("incident_id", "seq", "payload", "hash")


def created_tables(spark, sf):
    """Incidents, alerts and ledger created from scored events, appended as tables and read back."""
    scored = reliable(contexts(security_events(spark, sf), "anomaly_score"), "scored")
    triaged = reliable(triaged_clusters(scored, usable_rules(spark)), "triaged")
    incidents = I.new_incidents(triaged, "run-1", NOW)
    root = shared_dir(spark, "incident-store")
    append_table(incidents, root, "incidents", "run-1")
    append_table(I.new_alerts(anomalies(scored), incidents, NOW), root, "alerts", "run-1")
    append_table(L.chain_entries(I.creation_actions(incidents)), root, "ledger", "run-1")
    inc, al, le = (read_table(spark, root, t) for t in ("incidents", "alerts", "ledger"))
    per = al.groupBy("incident_id").agg(F.count(F.lit(1)).alias("alerts"), F.max("anomaly_score").alias("top_score"),
                                        F.count_distinct("source_type").alias("sources"),
                                        F.min("severity").alias("alert_severity"))
    entries = L.chain_status(L.verify_entries(le))
    return (inc.join(per, inc["id"] == per["incident_id"]).drop("incident_id")
            .join(entries, inc["id"] == entries["incident_id"])
            .select("entity", "technique", "tactic", "severity", "status", "confidence", "alerts", "top_score",
                    "sources", "alert_severity", F.col("valid").cast("int").alias("chain_valid"), "entries"))


def created_alerts(spark, sf):
    scored = contexts(security_events(spark, sf), "anomaly_score")
    incidents = I.new_incidents(triaged_clusters(scored, usable_rules(spark)), "run-1", NOW)
    return I.new_alerts(anomalies(scored), incidents, NOW).select("entity", "anomaly_score", "status", "severity", "source_type")


def count_query(column, default=None, source=incident_table):
    def run(spark, sf):
        return D.counts_by(source(spark, sf), column, default)
    return run


def kpi_query(spark, sf):
    k = D.kpis(incident_table(spark, sf), alert_table(spark, sf))
    return k.withColumn("avg_score", F.round("avg_score", 6)).withColumn(
        "avg_resolution_minutes", F.round("avg_resolution_minutes", 4))


def histogram(spark, sf):
    return D.score_histogram(alert_table(spark, sf)).select(
        "bin", F.round("bin_start", 6).alias("bin_start"), "n", F.round("mean", 6).alias("mean"))


def histogram_edges(spark, sf):
    return D.fixed_histogram(alert_table(spark, sf), [i / 10 for i in range(11)])


def daily(spark, sf):
    alerts = alert_table(spark, sf)
    last = alerts.agg(F.max("created_at")).scalar()
    return D.per_day(alerts, last).select(F.col("day").cast("string").alias("day"), "n")


def weekly_volume(spark, sf):
    alerts = alert_table(spark, sf)
    last = alerts.agg(F.max("created_at")).scalar()
    return D.per_day(alerts, last, 7).select(F.col("day").cast("string").alias("day"), "n")


def minutely(spark, sf):
    events = security_events(spark, sf)
    return D.per_minute(events, events.agg(F.max("timestamp")).scalar()).select(us("minute"), "n")


def heat(spark, sf):
    return D.technique_heat(incident_table(spark, sf))


def parents(spark, sf):
    return D.parent_counts(incident_table(spark, sf).filter("technique is not null"))


def matrix(spark, sf):
    m = D.matrix_heat(incident_table(spark, sf), [r.technique_id for r in load_rules()])
    return m.select("tactic", "technique", "n", F.col("has_rule").cast("int").alias("has_rule"),
                    D.heat_level(F.col("n")).alias("level"), D.heat_level_web(F.col("n")).alias("web_level"))


def layer(spark, sf):
    return D.navigator_layer(incident_table(spark, sf))


def colours(spark, sf):
    a = alert_table(spark, sf).filter("anomaly_score is not null")
    return a.groupBy(D.score_colour(F.col("anomaly_score")).alias("colour")).agg(F.count(F.lit(1)).alias("n"))


def ages(spark, sf):
    events = security_events(spark, sf)
    as_of = events.agg(F.max("timestamp")).scalar()
    return events.select(F.col("id").cast("bigint").alias("event_id"),
                         D.age_label(F.col("timestamp"), as_of).alias("age"))


def cost(spark, sf):
    c = D.cost_per_day(call_log(spark, sf))
    return c.select(F.col("day").cast("string").alias("day"), F.col("cost").cast("double").alias("cost"))


def call_stats(spark, sf):
    calls = call_log(spark, sf)
    p = percentiles(calls, "latency_ms", [0.5, 0.95])
    money = calls.agg(F.round(F.sum("cost_usd").cast("double") / F.sum("cluster_size") * 1000, 6)).scalar()
    return p.withColumn("cost_per_1000", money)


def latency_rollup(spark, sf):
    """Median and 95th percentile of a month from day sketches, and whether their ranks are within the stated error."""
    calls, points = call_log(spark, sf), {"p50": 0.5, "p95": 0.95}
    months = R.merged(R.slots(calls, "called_at", "latency_ms", "id", "day"), "day", "month")
    found = months.select("slot", *[R.quantile(p).alias(c) for c, p in points.items()])
    errors = R.rank_errors(calls, "called_at", "latency_ms", "month", found, points)
    return errors.select(F.date_format("slot", "yyyy-MM").alias("month"), "n", *[
        (F.col(c) <= R.KLL_ERROR).alias(f"{c}_within") for c in points])


def address_rollup(spark, sf):
    """Distinct addresses of a year from day sketches, and whether they are within the stated error of the exact number."""
    alerts = alert_table(spark, sf).select("created_at", "anomaly_score", "entity.ip")
    years = R.merged(R.slots(alerts, "created_at", "anomaly_score", "ip", "day"), "day", "year")
    exact = alerts.groupBy(F.date_trunc("year", "created_at").alias("slot")).agg(F.count_distinct("ip").alias("addresses"))
    off = F.abs(R.distinct() - F.col("addresses"))
    return years.join(exact, "slot").select(F.date_format("slot", "yyyy").alias("year"), "n", "addresses",
                                            (off <= R.HLL_ERROR * F.col("addresses")).alias("within"))


def registry(spark, sf):
    return D.entity_registry(security_events(spark, sf)).select("type", "value", us("first_seen"), us("last_seen"))


def incident_sizes(spark, sf):
    return I.incident_counts(alert_table(spark, sf))


def rule_techniques(spark, sf):
    """Distinct techniques the rules name, with the incidents each one has."""
    listed = spark.createDataFrame([(r.technique_id,) for r in load_rules()], "technique string").distinct()
    counts = D.technique_heat(incident_table(spark, sf), roll_up=False)
    return listed.join(counts, "technique", "left").select("technique", F.coalesce("n", F.lit(0)).alias("n"))


QUERIES = {
    "incidents_filtered": filtered_incidents, "alerts_filtered": filtered_alerts,
    "alerts_list_filter": alerts_csv_filter, "alerts_of_incident": busiest_incident_alerts,
    "incidents_of_technique": technique_incidents, "incidents_of_technique_first": technique_first_20,
    "severity_tab": severity_tab, "newest_incidents": newest_incidents, "newest_alerts": newest_alerts,
    "alert_page": alert_page, "merged_feed": feed, "alerts_new": new_alerts, "alerts_unseen": unseen_alerts,
    "incident_details": incident_details, "incident_ledger": incident_ledger,
    "ledger_chain": ledger_chain, "ledger_chain_continued": ledger_continued, "ledger_verified": ledger_verified,
    "ledger_status": ledger_status, "ledger_last_entries": ledger_ends,
    "payload_ledger": payload_chain, "payload_ledger_status": payload_verified,
    "status_changes_split": changes_split, "incident_current_status": current_status,
    "status_change_ledger": status_ledger, "bulk_acknowledge": acknowledged, "bulk_assign": assigned,
    "playbook_approvals": approvals, "incidents_created": created_tables, "alerts_created": created_alerts,
    "count_by_severity": count_query("severity"), "count_by_severity_default": count_query("severity", "low"),
    "count_by_status": count_query("status"), "alert_count_by_status": count_query("status", "open", alert_table),
    "alert_change_payloads": alert_payloads, "kpi_row": kpi_query, "score_histogram": histogram,
    "score_histogram_fixed": histogram_edges, "alerts_per_day": daily, "alert_volume_week": weekly_volume,
    "events_per_minute": minutely, "technique_heat": heat, "technique_parents": parents,
    "technique_matrix": matrix, "navigator_layer": layer, "score_colours": colours, "age_labels": ages,
    "call_cost_per_day": cost, "call_latency_and_cost": call_stats, "latency_rollup": latency_rollup, "distinct_addresses_rollup": address_rollup,
    "entity_registry": registry,
    "incident_sizes": incident_sizes, "rule_techniques": rule_techniques,
}

LISTED = "[" + ", ".join(f"'{t}'" for t in TECHNIQUE_LIST) + "]"
IA = f"""WITH inc AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, 'c' || o_custkey AS entity, o_orderkey,
    CASE WHEN o_custkey % 10 < 9 THEN {LISTED}[1 + o_custkey % 10] END AS technique,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium'
      WHEN '5-LOW' THEN 'low' END AS severity,
    CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'investigating' END AS status,
    o_totalprice AS confidence, epoch_us(o_orderdate) AS created_at,
    epoch_us(o_orderdate) + (o_custkey % 1440) * 60000000 AS updated_at FROM orders),
  al AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS id,
    CAST(l_orderkey AS VARCHAR) AS incident_id, 'Host-' || (l_partkey % 50) AS host, l_partkey, l_suppkey, l_linenumber,
    CASE WHEN round(l_tax * 100) = 8 THEN NULL WHEN l_discount = 0 THEN 0 ELSE l_quantity / 50 END AS anomaly_score,
    CASE l_returnflag WHEN 'A' THEN 'ack' WHEN 'R' THEN 'closed' ELSE CASE WHEN l_linestatus = 'O' THEN 'new' END END AS status,
    CASE WHEN l_quantity >= 42 THEN 'critical' WHEN l_quantity >= 35 THEN 'high' WHEN l_quantity >= 25 THEN 'medium'
      ELSE 'low' END AS severity,
    CASE l_partkey % 3 WHEN 0 THEN 'T1110.001' WHEN 1 THEN 'T1046' ELSE 'T1021' END AS technique,
    epoch_us(l_shipdate) + ((l_partkey * 37 + l_suppkey) % 86400) * 1000000 AS created_at FROM lineitem)"""
CHAT = """WITH RECURSIVE act AS (SELECT 'inc_' || conv_id AS incident_id, role AS action,
    'actor' || length(text) AS actor, '2024-01-01T00:00:0' || turn AS ts,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, turn FROM conversations),
  chain AS (SELECT incident_id, seq, action, actor, CAST(NULL AS VARCHAR) AS previous_hash,
      sha256(incident_id || action || actor || ts) AS this_hash FROM act WHERE seq = 1
    UNION ALL SELECT a.incident_id, a.seq, a.action, a.actor, c.this_hash,
      sha256(c.this_hash || a.incident_id || a.action || a.actor || a.ts)
    FROM chain c JOIN act a ON a.incident_id = c.incident_id AND a.seq = c.seq + 1)"""
PAYLOAD = """WITH RECURSIVE act AS (SELECT 'inc_' || conv_id AS incident_id,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq,
    '{"action": "' || role || '", "actor": "actor' || length(text) || '", "incident_id": "inc_' || conv_id ||
      '", "n": ' || turn || '}' AS payload FROM conversations),
  chain AS (SELECT incident_id, seq, payload, repeat('0', 64) AS prev_hash,
      sha256(repeat('0', 64) || payload) AS hash FROM act WHERE seq = 1
    UNION ALL SELECT a.incident_id, a.seq, a.payload, c.hash, sha256(c.hash || a.payload)
    FROM chain c JOIN act a ON a.incident_id = c.incident_id AND a.seq = c.seq + 1)"""
CHANGES = f"""{IA}, ch AS (SELECT *, o_orderkey % 50 = 0 AS unknown_id,
    CASE WHEN n = 0 THEN 'investigating' WHEN o_orderkey % 20 = 1 THEN 'bogus' WHEN o_orderkey % 2 = 0 THEN 'resolved'
      ELSE 'false_positive' END AS new_status, created_at + n * 86400000000 AS ts
  FROM inc CROSS JOIN (VALUES (0), (1)) t(n)),
  judged AS (SELECT *, CASE WHEN new_status = 'bogus' THEN 'invalid status' WHEN unknown_id THEN 'unknown id'
    ELSE 'applied' END AS reason FROM ch)"""
KPI = """count(*) AS total_incidents, count(*) FILTER (severity = 'critical' AND status = 'open') AS critical_open,
    count(*) FILTER (status = 'resolved') AS resolved,
    round(coalesce(sum(CASE WHEN status = 'resolved' THEN (updated_at - created_at) / 60e6 END), 0)
      / greatest(count(*) FILTER (status = 'resolved'), 1), 4) AS avg_resolution_minutes"""
AKPI = """count(*) AS total_alerts, count(*) FILTER (coalesce(status, 'new') = 'new') AS new_alerts,
    round(coalesce(avg(nullif(anomaly_score, 0)), 0), 6) AS avg_score"""
CELLS = "cells(tactic, technique) AS (VALUES " + ", ".join(
    f"('{k}', '{t}')" for k, ts in D.MATRIX.items() for t in ts) + ")"
PARENTS_WITH_RULE = sorted({r.technique_id.split(".")[0] for r in load_rules()})
RULE_TECHNIQUES = sorted({r.technique_id for r in load_rules()})

ORACLES = {
    "incidents_filtered": f"{IA} SELECT id, entity, technique, created_at FROM inc WHERE status = 'open' AND severity = 'critical'",
    "alerts_filtered": f"""{IA} SELECT id, incident_id, anomaly_score FROM al WHERE severity = 'high' AND status = 'ack'
        AND host LIKE 'Host-1%'""",
    "alerts_list_filter": f"""{IA} SELECT id, created_at FROM al WHERE severity IN ('critical', 'high')
        AND status IN ('new', 'closed') AND technique IN ('T1046', 'T1021')
        AND created_at BETWEEN epoch_us(TIMESTAMP '1997-01-01') AND epoch_us(TIMESTAMP '1998-06-30 12:00:00')""",
    "alerts_of_incident": f"""{IA}, top AS (SELECT incident_id FROM al GROUP BY 1 ORDER BY count(*) DESC, incident_id LIMIT 1)
        SELECT id, incident_id, severity FROM al SEMI JOIN top USING (incident_id)""",
    "incidents_of_technique": f"{IA} SELECT id, technique FROM inc WHERE technique = 'T1021' OR technique LIKE 'T1021.%'",
    "incidents_of_technique_first": f"""{IA} SELECT id, technique, created_at FROM inc
        WHERE technique = 'T1110' OR technique LIKE 'T1110.%' ORDER BY created_at DESC, id LIMIT 20""",
    "severity_tab": f"{IA} SELECT id, severity, created_at FROM inc WHERE severity = 'critical' ORDER BY created_at DESC, id LIMIT 50",
    "newest_incidents": f"{IA} SELECT id, severity, status, created_at FROM inc ORDER BY created_at DESC, id LIMIT 20",
    "newest_alerts": f"{IA} SELECT id, incident_id, created_at FROM al ORDER BY created_at DESC, id LIMIT 200",
    "alert_page": f"""{IA} SELECT id, created_at, count(*) OVER () AS total FROM al WHERE severity = 'critical'
        ORDER BY created_at DESC, id LIMIT 50 OFFSET 100""",
    "merged_feed": f"""{IA} SELECT 'alert' AS kind, id, severity, anomaly_score, CAST(NULL AS DOUBLE) AS confidence, created_at FROM al
        UNION ALL SELECT 'incident', id, severity, NULL, confidence, created_at FROM inc""",
    "alerts_new": f"{IA} SELECT id, status FROM al WHERE status IS NULL OR status = 'new'",
    "alerts_unseen": f"{IA} SELECT id FROM al WHERE status IS NULL OR status NOT IN ('ack', 'closed')",
    "incident_details": f"""{IA}, rk AS (SELECT *, (row_number() OVER (PARTITION BY incident_id ORDER BY created_at, id) - 1) // 4 AS page FROM al),
        pg AS (SELECT incident_id, page, string_agg(id, ',' ORDER BY created_at, id) AS alerts FROM rk GROUP BY ALL)
        SELECT inc.id, coalesce(page, 0) AS page, coalesce(alerts, '') AS alerts FROM inc LEFT JOIN pg ON inc.id = incident_id""",
    "incident_ledger": f"{CHAT} SELECT incident_id AS id, CAST(0 AS BIGINT) AS page, string_agg(action, ',' ORDER BY seq) AS actions FROM chain GROUP BY 1",
    "ledger_chain": f"{CHAT} SELECT incident_id, seq, action, previous_hash, this_hash FROM chain",
    "ledger_chain_continued": f"{CHAT} SELECT incident_id, seq, action, previous_hash, this_hash FROM chain",
    "ledger_verified": f"""{CHAT} SELECT incident_id, seq, substr(this_hash, 1, 16) || '...' AS hash,
        CASE WHEN length(actor) % 2 = 0 THEN 0 ELSE 1 END AS valid FROM chain""",
    "ledger_status": f"""{CHAT} SELECT incident_id, CASE WHEN count(*) >= 3 THEN 0 ELSE 1 END AS valid, count(*) AS entries
        FROM chain GROUP BY 1""",
    "ledger_last_entries": f"""{CHAT} SELECT incident_id, arg_max(this_hash, seq) AS last_hash, max(seq) AS last_seq FROM chain GROUP BY 1""",
    "payload_ledger": f"{PAYLOAD} SELECT incident_id, seq, payload, prev_hash, hash FROM chain",
    "payload_ledger_status": f"""{PAYLOAD} SELECT incident_id, CASE WHEN count(*) >= 2 THEN 0 ELSE 1 END AS valid,
        count(*) AS entries FROM chain GROUP BY 1""",
    "status_changes_split": f"{CHANGES} SELECT reason, new_status, count(*) AS n FROM judged GROUP BY ALL",
    "incident_current_status": f"""{CHANGES}, l AS (SELECT id, arg_max(new_status, n) AS s, max(ts) AS t FROM judged
        WHERE reason = 'applied' GROUP BY id)
        SELECT inc.id, coalesce(s, status) AS status, coalesce(t, updated_at) AS updated_at FROM inc LEFT JOIN l USING (id)""",
    "status_change_ledger": f"""{CHANGES}, a AS (SELECT id, n, 'status_changed_to_' || new_status AS action,
          strftime(make_timestamp(ts), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS t FROM judged WHERE reason = 'applied'),
        h AS (SELECT id, n, action, t, sha256(id || action || 'analyst' || t) AS h1 FROM a WHERE n = 0)
        SELECT id AS incident_id, CAST(1 AS BIGINT) AS seq, action, h1 AS this_hash FROM h
        UNION ALL SELECT a.id, 2, a.action, sha256(h1 || a.id || a.action || 'analyst' || a.t)
        FROM a JOIN h ON a.id = h.id WHERE a.n = 1""",
    "bulk_acknowledge": f"""{IA}, s AS (SELECT CASE WHEN coalesce(status, 'new') = 'new' THEN 'ack' ELSE status END AS st,
        coalesce(status, 'new') = 'new' AS was FROM al)
        SELECT st AS status, count(*) AS n, (SELECT count(*) FROM s WHERE was) AS ledger_entries FROM s GROUP BY 1""",
    "bulk_assign": f"{IA} SELECT severity, CASE severity WHEN 'critical' THEN 'lee' END AS assignee, count(*) AS n FROM al GROUP BY ALL",
    "playbook_approvals": f"""{IA}, p AS (SELECT id, '{{"action": "playbook_approved", "actor": "kim", "incident_id": "' || id || '"}}' AS payload
        FROM inc WHERE status = 'open' AND severity = 'critical')
        SELECT id AS incident_id, CAST(1 AS BIGINT) AS seq, payload, sha256(repeat('0', 64) || payload) AS hash FROM p""",
    "incidents_created": f"""{TRIAGE}, per AS (SELECT entity, count(*) AS alerts, max(score) AS top_score,
          count(DISTINCT source_type) AS sources FROM anom GROUP BY 1)
        SELECT entity, technique_id AS technique, tr.tactic, severity, 'open' AS status, confidence, alerts, top_score, sources,
          severity AS alert_severity, 1 AS chain_valid, CAST(1 AS BIGINT) AS entries FROM tr JOIN per USING (entity)""",
    "alerts_created": f"""WITH {EV}, x AS (SELECT *, max(score) OVER (PARTITION BY entity) AS top FROM e WHERE score > 0.4)
        SELECT entity, score AS anomaly_score, 'new' AS status, {BAND.format('top')} AS severity, source_type FROM x""",
    "count_by_severity": f"{IA} SELECT severity, count(*) AS n FROM inc GROUP BY 1",
    "count_by_severity_default": f"{IA} SELECT coalesce(severity, 'low') AS severity, count(*) AS n FROM inc GROUP BY 1",
    "count_by_status": f"{IA} SELECT status, count(*) AS n FROM inc GROUP BY 1",
    "alert_count_by_status": f"{IA} SELECT coalesce(status, 'open') AS status, count(*) AS n FROM al GROUP BY 1",
    "alert_change_payloads": f"""{IA} SELECT incident_id, CAST(0 AS BIGINT) AS seq, id AS alert_id, status AS old_status,
          'ack' AS new_status FROM al
        UNION ALL SELECT incident_id, 2, id, 'ack', 'closed' FROM al""",
    "kpi_row": f"{IA} SELECT * FROM (SELECT {KPI} FROM inc) CROSS JOIN (SELECT {AKPI} FROM al)",
    "score_histogram": f"""{IA}, s AS (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi, avg(anomaly_score) AS mean FROM al),
        b AS (SELECT least(floor((anomaly_score - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n
          FROM al CROSS JOIN s WHERE anomaly_score IS NOT NULL GROUP BY 1)
        SELECT i::INT AS bin, round(lo + i * ((hi - lo) / 20), 6) AS bin_start, coalesce(n, 0) AS n, round(mean, 6) AS mean
        FROM range(20) t(i) CROSS JOIN s LEFT JOIN b ON bin = i""",
    "score_histogram_fixed": f"""{IA}, b AS (SELECT floor(round(anomaly_score * 50) / 5)::INT AS i, count(*) AS n FROM al
          WHERE anomaly_score IS NOT NULL GROUP BY 1)
        SELECT t.i / 10.0::DOUBLE AS bin_start, coalesce(n, 0) AS n FROM range(11) t(i) LEFT JOIN b ON b.i = t.i""",
    "alerts_per_day": f"""{IA}, d AS (SELECT created_at // 86400000000 AS d FROM al), m AS (SELECT max(d) AS last FROM d)
        SELECT strftime(make_timestamp((last - i) * 86400000000), '%Y-%m-%d') AS day, count(d.d) AS n
        FROM m CROSS JOIN range(14) t(i) LEFT JOIN d ON d.d = last - i GROUP BY ALL""",
    "alert_volume_week": f"""{IA}, d AS (SELECT created_at // 86400000000 AS d FROM al), m AS (SELECT max(d) AS last FROM d)
        SELECT strftime(make_timestamp((last - i) * 86400000000), '%Y-%m-%d') AS day, count(d.d) AS n
        FROM m CROSS JOIN range(7) t(i) LEFT JOIN d ON d.d = last - i GROUP BY ALL""",
    "events_per_minute": f"""WITH {EV}, m AS (SELECT max(us) AS last FROM e)
        SELECT us // 60000000 * 60000000 AS minute, count(*) AS n FROM e CROSS JOIN m WHERE us > last - 3600000000 GROUP BY 1""",
    "technique_heat": f"""{IA}, x AS (SELECT technique AS t FROM inc UNION ALL
          SELECT split_part(technique, '.', 1) FROM inc WHERE technique LIKE '%.%')
        SELECT t AS technique, count(*) AS n FROM x WHERE t IS NOT NULL GROUP BY 1""",
    "technique_parents": f"{IA} SELECT split_part(technique, '.', 1) AS technique, count(*) AS n FROM inc WHERE technique IS NOT NULL GROUP BY 1",
    "technique_matrix": f"""{IA}, {CELLS}, c AS (SELECT cells.tactic, cells.technique, count(inc.id) AS n FROM cells
          LEFT JOIN inc ON inc.technique = cells.technique OR inc.technique LIKE cells.technique || '.%' GROUP BY ALL)
        SELECT tactic, technique, n,
          CASE WHEN {' OR '.join(f"technique LIKE '{p}%'" for p in PARENTS_WITH_RULE)} THEN 1 ELSE 0 END AS has_rule,
          CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'low' WHEN n <= 3 THEN 'medium' ELSE 'high' END AS level,
          CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'low' WHEN n = 2 THEN 'medium' ELSE 'high' END AS web_level FROM c""",
    "navigator_layer": f"""{IA} SELECT technique AS technique_id, count(*) AS score,
        CASE WHEN count(*) = 1 THEN 'low' WHEN count(*) <= 3 THEN 'medium' ELSE 'high' END AS level
        FROM inc WHERE technique IS NOT NULL GROUP BY 1""",
    "score_colours": f"""{IA} SELECT CASE WHEN anomaly_score >= 0.75 THEN '#ef4444' WHEN anomaly_score >= 0.5 THEN '#f97316'
        WHEN anomaly_score >= 0.3 THEN '#eab308' ELSE '#22c55e' END AS colour, count(*) AS n FROM al
        WHERE anomaly_score IS NOT NULL GROUP BY 1""",
    "age_labels": f"""WITH {EV}, m AS (SELECT max(us) AS last FROM e), d AS (SELECT event_id, (last - us) AS d FROM e CROSS JOIN m)
        SELECT event_id, CASE WHEN d < 60000000 THEN (d // 1000000) || 's ago' WHEN d < 3600000000 THEN (d // 60000000) || 'm ago'
          WHEN d < 86400000000 THEN (d // 3600000000) || 'h ago' ELSE (d // 86400000000) || 'd ago' END AS age FROM d""",
    "call_cost_per_day": """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day,
        CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / 1e9 AS cost FROM orders GROUP BY 1""",
    "call_latency_and_cost": """WITH c AS (SELECT CAST(o_custkey * 7 % 5000 AS INT) AS v, 1 + o_orderkey % 5 AS size,
          CAST(round(o_totalprice * 100) AS BIGINT) AS cost FROM orders),
        r AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM c)
        SELECT min(v) FILTER (i >= 0.5 * n) AS p50, min(v) FILTER (i >= 0.95 * n) AS p95,
          (SELECT round(sum(cost) / 1e9 / sum(size) * 1000, 6) FROM c) AS cost_per_1000 FROM r""",
    "latency_rollup": """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, true AS p50_within, true AS p95_within
        FROM orders GROUP BY 1""",
    "distinct_addresses_rollup": f"""{IA} SELECT strftime(make_timestamp(created_at), '%Y') AS year, count(*) AS n,
        count(DISTINCT concat(l_suppkey % 200, '-', l_linenumber)) AS addresses,
        true AS within FROM al GROUP BY 1""",
    "entity_registry": f"""WITH {EV}, x AS (SELECT 'ip' AS type, src_ip AS value, us FROM e UNION ALL SELECT 'host', host_name, us FROM e
          UNION ALL SELECT 'user', user_name, us FROM e)
        SELECT type, value, min(us) AS first_seen, max(us) AS last_seen FROM x WHERE value <> '' GROUP BY ALL""",
    "incident_sizes": f"""{IA} SELECT incident_id, count(*) AS alert_count,
        count(DISTINCT (l_suppkey % 200, l_linenumber, host, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey END)) AS entity_count
        FROM al GROUP BY 1""",
    "rule_techniques": f"""{IA}, t AS (SELECT unnest({RULE_TECHNIQUES}) AS technique)
        SELECT t.technique, count(inc.id) AS n FROM t LEFT JOIN inc ON inc.technique = t.technique GROUP BY 1""",
}
