"""Rule, cluster and triage queries over the activity table, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.attribution import top_features
from ..operators.clusters import cluster_by_entity, cluster_events, largest_first
from ..operators.rules import (attach_technique, assign_contexts, rule_context, rule_matches,
                               with_candidates, with_technique)
from ..operators.triage import (SEVERITY_BANDS, TACTIC_ACTIONS, confidence, incident_title,
                                recommended_action, severity_band)
from ..functions.rounding import plain_text
from ..functions.keys import clock_bucket, entity_cluster, event_micros, tie_breaker
from ..sources.rules import TECHNIQUES, load_rules, read_techniques, rules_frame, split_rules
from .detection import anomalies, contexts, triaged_clusters
from .driver_tables import security_events
from .reference_sql import EV, NINE


def event_id():
    return F.col("id").cast("bigint").alias("event_id")


def scored_contexts(spark, sf, **kw):
    return contexts(security_events(spark, sf), "anomaly_score", **kw)


def usable_rules(spark):
    return split_rules(spark, load_rules())[0]


def context_query(spark, sf):
    c = scored_contexts(spark, sf)
    flags = ["source_is_internal", "dest_is_internal", "dest_is_external"]
    return c.select(event_id(), "event_type", "action", "dest_port", *[F.col(f).cast("int").alias(f) for f in flags],
                    "anomaly_score", "command_line", "user", "api_call", "parent_process", "process",
                    *[F.col(f).cast("bigint").alias(f) for f in
                      ["event_count_1m", "event_count_5m", "distinct_dest_ports", "dest_ip_fanout",
                       "bytes_transferred"]],
                    F.round("geo_velocity_kmh", 4).alias("geo_velocity_kmh"))


def internal_addresses(spark, sf):
    """Octet rule against prefix list, per source address."""
    from ..functions.network import is_external, is_internal
    ip = F.col("source.ip")
    return security_events(spark, sf).groupBy(F.coalesce(ip, F.lit("-")).alias("ip")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(is_internal(ip).cast("int")).alias("internal"),
        F.max(is_internal(ip, literal=True).cast("int")).alias("internal_literal"),
        F.max(is_external(ip).cast("int")).alias("external"))


def matches_query(spark, sf):
    m = rule_matches(scored_contexts(spark, sf), usable_rules(spark), "id")
    return m.select(event_id(), "ordinal", "rule_id", "technique_id", "tactic")


def candidates_query(spark, sf):
    c = with_candidates(scored_contexts(spark, sf), usable_rules(spark))
    return c.select(event_id(), F.array_join("technique_ids", ",").alias("candidates"))


def technique_query(spark, sf):
    t = with_technique(scored_contexts(spark, sf), usable_rules(spark))
    return t.select(event_id(), "technique_id")


def metadata_query(spark, sf):
    t = with_technique(scored_contexts(spark, sf), usable_rules(spark))
    per = t.groupBy("technique_id").agg(F.count(F.lit(1)).alias("events"))
    return attach_technique(per, read_techniques(spark)).select(
        "technique_id", "events", "technique_name", "technique_tactic", "technique_description")


def entity_clusters(spark, sf):
    events = security_events(spark, sf)
    from ..functions.keys import entity_feature
    rows = events.select("id", "anomaly_score", entity_feature().alias("entity"),
                         event_micros().alias("us"), tie_breaker("id").alias("tie"))
    c = cluster_by_entity(anomalies(rows))
    return c.select("entity", "cluster_size", "max_score",
                    F.col("first_event_id").cast("bigint").alias("first_event_id"),
                    F.col("top_event_id").cast("bigint").alias("top_event_id"))


def _technique_events(spark, sf):
    t = with_technique(scored_contexts(spark, sf), usable_rules(spark))
    return t.select("id", F.col("entity2").alias("entity"), "technique_id", "us", "tie", "anomaly_score")


def technique_clusters(spark, sf):
    return largest_first(cluster_events(_technique_events(spark, sf)))


def clock_clusters(spark, sf):
    c = cluster_events(_technique_events(spark, sf), ignore_date=True)
    return c.select("entity", "technique_id", "bucket", "cluster_size")


def largest_cluster_members(spark, sf):
    """Point lookup: the members of the largest cluster (ties: the earliest)."""
    events = _technique_events(spark, sf)
    from ..functions.keys import epoch_bucket
    keyed = events.withColumn("bucket", epoch_bucket("us"))
    top = largest_first(cluster_events(events)).limit(1).select("entity", "technique_id", "bucket")
    return keyed.join(F.broadcast(top), ["entity", "technique_id", "bucket"], "left_semi").select(
        event_id(), "entity", "technique_id", "bucket")


def triage_query(spark, sf):
    t = triaged_clusters(scored_contexts(spark, sf), usable_rules(spark))
    return t.select("entity", "cluster_size", "max_score", F.array_join("technique_ids", ",").alias("candidates"),
                    "technique_id", "technique_name", "tactic", "severity", "confidence",
                    "rationale", "recommended_action")


def titles_query(spark, sf):
    t = triaged_clusters(scored_contexts(spark, sf), usable_rules(spark))
    return t.select("entity", incident_title(F.col("tactic"), F.col("technique_name"),
                                             F.coalesce("host_name", F.lit("unknown"))).alias("title"))


def bands_query(spark, sf):
    s = F.col("anomaly_score")
    return security_events(spark, sf).select(
        event_id(), severity_band(s).alias("severity"), confidence(s).alias("confidence"))


def actions_query(spark, sf):
    """Recommended action of every (event, rule) hit's tactic."""
    m = rule_matches(scored_contexts(spark, sf), usable_rules(spark), "id")
    return m.groupBy("tactic", recommended_action(F.col("tactic")).alias("action")).agg(
        F.count(F.lit(1)).alias("hits"))


def top3_query(spark, sf):
    c = scored_contexts(spark, sf)
    c = c.withColumn("tod_zscore", F.round("tod_zscore", 4)).withColumn(
        "geo_velocity_kmh", F.round("geo_velocity_kmh", 4))
    best = top_features()
    return c.select(event_id(), F.array_join(F.transform(best, lambda f: f["name"]), ",").alias("names"),
                    F.round(best[0]["value"], 3).alias("first_value"))


def entity_keys(spark, sf):
    from ..functions.keys import entity_feature
    return security_events(spark, sf).select(event_id(), entity_feature().alias("entity"),
                                             entity_cluster().alias("entity2"))


def clock_buckets(spark, sf):
    text = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return security_events(spark, sf).groupBy(clock_bucket(text).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))


def positional_contexts(spark, sf):
    """Events by position against a context list that is half as long."""
    events = security_events(spark, sf).select(event_id(), F.col("id").cast("bigint").alias("position"))
    shorter = security_events(spark, sf).select(
        (F.col("id").cast("bigint") * 2).alias("double"), F.col("id").cast("bigint").alias("position"),
        F.col("event.action").alias("context_action"))
    last = events.agg(F.max("position")).scalar()
    contexts_half = shorter.filter(F.col("double") <= last).drop("double")
    return assign_contexts(events, contexts_half).select("event_id", "context_action")


QUERIES = {
    "rule_context": context_query,
    "internal_addresses": internal_addresses,
    "rule_matches": matches_query,
    "rule_candidates": candidates_query,
    "technique_assigned": technique_query,
    "technique_metadata": metadata_query,
    "clusters_by_entity": entity_clusters,
    "clusters_by_technique": technique_clusters,
    "clusters_by_clock_time": clock_clusters,
    "cluster_lookup": largest_cluster_members,
    "triage_clusters": triage_query,
    "incident_titles": titles_query,
    "severity_and_confidence": bands_query,
    "tactic_actions": actions_query,
    "top_three_features": top3_query,
    "entity_keys": entity_keys,
    "clock_buckets": clock_buckets,
    "contexts_by_position": positional_contexts,
}

INTERNAL = "({0} LIKE '10.%' OR {0} LIKE '127.%' OR {0} LIKE '192.168.%' OR regexp_matches({0}, '^172\\.(1[6-9]|2[0-9]|3[01])\\.'))"
CTX = f"""{NINE},
ctx AS (
  SELECT *, CASE outcome WHEN 'failure' THEN 'failed' ELSE 'success' END AS result,
    coalesce({INTERNAL.format('src_ip')}, false) AS src_in, {INTERNAL.format('dip')} AS dst_in,
    (dip <> '' AND NOT {INTERNAL.format('dip')}) AS dst_ex, coalesce(user_name, '') AS usr
  FROM nine)"""
# (rule id, technique, tactic, name, condition), restated by hand.
RULES = [
    ("rule_brute_force_ssh", "T1110.001", "Credential Access", "Brute Force: Password Guessing (SSH)",
     "event_type = 'error' AND port = 22 AND c5m > 10"),
    ("rule_brute_force_rdp", "T1110.001", "Credential Access", "Brute Force: Password Guessing (RDP)",
     "event_type = 'error' AND port = 3389 AND c5m > 10"),
    ("rule_brute_force_http", "T1110.001", "Credential Access", "Brute Force: Password Guessing (HTTP)",
     "event_type = 'error' AND port IN (80, 443) AND c5m > 20"),
    ("rule_port_scan", "T1046", "Discovery", "Network Service Discovery", "ports > 50 AND ips < 5"),
    ("rule_network_scan", "T1046", "Discovery", "Network Service Discovery (Horizontal)", "ips > 50 AND ports < 5"),
    ("rule_ddos", "T1498", "Impact", "Network Denial of Service", "c1m > 1000 AND bytes > 100000000"),
    ("rule_lateral_smb", "T1021.002", "Lateral Movement", "Remote Services: SMB/Windows Admin Shares",
     "event_class = 'network' AND port IN (139, 445) AND src_in AND dst_in AND score > 0.8"),
    ("rule_lateral_rdp", "T1021.001", "Lateral Movement", "Remote Services: Remote Desktop Protocol",
     "event_class = 'network' AND port = 3389 AND src_in AND dst_in AND score > 0.8"),
    ("rule_lateral_ssh", "T1021.004", "Lateral Movement", "Remote Services: SSH",
     "event_class = 'network' AND port = 22 AND src_in AND dst_in AND score > 0.8"),
    ("rule_impossible_travel", "T1078", "Initial Access", "Valid Accounts (Impossible Travel)",
     "vel > 1000 AND event_class = 'auth' AND result = 'success'"),
    ("rule_privesc_sudo", "T1548.003", "Privilege Escalation",
     "Abuse Elevation Control Mechanism: Sudo and Sudo Caching",
     "event_class = 'process' AND command_line LIKE '%sudo%' AND usr <> 'root' AND score > 0.8"),
    ("rule_privesc_setuid", "T1548.001", "Privilege Escalation",
     "Abuse Elevation Control Mechanism: Setuid and Setgid",
     "event_class = 'process' AND command_line LIKE '%chmod u+s%'"),
    ("rule_data_exfil", "T1041", "Exfiltration", "Exfiltration Over C2 Channel",
     "bytes > 500000000 AND dst_ex AND score > 0.8"),
    ("rule_process_injection", "T1055", "Defense Evasion", "Process Injection", "false"),
    ("rule_suspicious_lineage", "T1059", "Execution", "Command and Scripting Interpreter",
     "event_class = 'process' AND parent_process IN ('winword.exe', 'excel.exe') "
     "AND process IN ('cmd.exe', 'powershell.exe')"),
]
RULE_ROWS = " UNION ALL ".join(
    f"SELECT event_id, {i} AS ordinal, '{r}' AS rule_id, '{t}' AS technique_id, '{k}' AS tactic, "
    f"'{n}' AS rule_name FROM ctx WHERE {w}" for i, (r, t, k, n, w) in enumerate(RULES))
HITS = f"{CTX}, hits AS ({RULE_ROWS})"
CANDIDATES = f"""{HITS},
first_hit AS (SELECT event_id, technique_id, min(ordinal) AS o FROM hits GROUP BY ALL),
cand AS (SELECT event_id, string_agg(technique_id, ',' ORDER BY o) AS candidates,
  arg_min(technique_id, o) AS technique FROM first_hit GROUP BY event_id),
tech AS (SELECT ctx.*, coalesce(candidates, '') AS candidates, coalesce(technique,
    CASE WHEN port = 22 OR result = 'failed' OR event_class = 'auth' THEN 'T1110.001'
      WHEN bytes >= 500000000 THEN 'T1498' WHEN dst_ex AND bytes > 0 THEN 'T1041'
      WHEN ports >= 10 THEN 'T1046' ELSE 'T1110.001' END) AS technique_id
  FROM ctx LEFT JOIN cand USING (event_id))"""
META = "meta(id, name, tactic, description) AS (VALUES " + ", ".join(
    f"('{k}', '{v[0]}', '{v[1]}', '{v[2]}')" for k, v in TECHNIQUES.items()) + ")"
BAND = "CASE " + " ".join(f"WHEN {{0}} >= {f} THEN '{n}'" for f, n in SEVERITY_BANDS) + " END"
ACTIONS = "act(tactic, action) AS (VALUES " + ", ".join(
    f"('{k}', '{v}')" for k, v in TACTIC_ACTIONS.items()) + ")"
NUM = ("regexp_replace(CAST(CAST({0} AS DECIMAL(38,4)) AS VARCHAR), '0{{1,3}}$', '')")
TOP3 = """
feat AS (
  SELECT event_id, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS i,
    unnest(['event_count_1m', 'event_count_5m', 'event_count_1h', 'failed_auth_ratio', 'distinct_dest_ports',
      'dest_ip_fanout', 'bytes_transferred', 'tod_zscore', 'geo_velocity_kmh']) AS name,
    unnest([c1m::DOUBLE, c5m, c1h, ratio, ports, ips, bytes, {tod}, {vel}]) AS x
  FROM nine),
top3 AS (SELECT event_id, name, x, row_number() OVER (PARTITION BY event_id ORDER BY abs(x) DESC, i) AS rn FROM feat
  QUALIFY rn <= 3)"""
TRIAGE = f"""{CANDIDATES}, {ACTIONS}, {TOP3.format(tod='tod', vel='vel')},
anom AS (SELECT * FROM tech WHERE score > 0.4),
cl AS (SELECT entity, count(*) AS cluster_size, max(score) AS max_score,
  arg_max(event_id, (score, -us, -event_id)) AS event_id FROM anom GROUP BY entity),
prim AS (SELECT event_id, arg_min(rule_name, ordinal) AS technique_name, arg_min(tactic, ordinal) AS tactic
  FROM hits GROUP BY event_id),
summ AS (SELECT event_id, string_agg(name || '=' || {NUM.format('x')}, ', ' ORDER BY rn) AS summary
  FROM top3 GROUP BY event_id),
tr AS (SELECT cl.entity, cluster_size, max_score, candidates,
    CASE WHEN candidates = '' THEN 'T0000' ELSE split_part(candidates, ',', 1) END AS technique_id,
    coalesce(technique_name, 'Unknown Technique') AS technique_name, coalesce(prim.tactic, 'Unknown') AS tactic,
    {BAND.format('max_score')} AS severity,
    CAST(printf('%.3f', least(max_score * 1.1, 1.0)) AS DOUBLE) AS confidence, summary, host_name
  FROM cl JOIN tech USING (event_id) LEFT JOIN prim USING (event_id) JOIN summ USING (event_id))"""

ORACLES = {
    "rule_context": f"""{CTX} SELECT event_id, event_class AS event_type, result AS action, port AS dest_port,
        CAST(src_in AS INT) AS source_is_internal, CAST(dst_in AS INT) AS dest_is_internal,
        CAST(dst_ex AS INT) AS dest_is_external, score AS anomaly_score, command_line, usr AS "user",
        action AS api_call, parent_process, process, c1m AS event_count_1m, c5m AS event_count_5m,
        ports AS distinct_dest_ports, ips AS dest_ip_fanout, CAST(bytes AS BIGINT) AS bytes_transferred,
        round(vel, 4) AS geo_velocity_kmh FROM ctx""",
    "internal_addresses": f"""WITH {EV} SELECT coalesce(src_ip, '-') AS ip, count(*) AS n,
        max(CASE WHEN {INTERNAL.format('src_ip')} THEN 1 ELSE 0 END) AS internal,
        max(CASE WHEN {INTERNAL.format('src_ip')} OR src_ip LIKE '172.2%' THEN 1 ELSE 0 END) AS internal_literal,
        max(CASE WHEN src_ip <> '' AND NOT {INTERNAL.format('src_ip')} THEN 1 ELSE 0 END) AS external
        FROM e GROUP BY 1""",
    "rule_matches": f"{HITS} SELECT event_id, ordinal, rule_id, technique_id, tactic FROM hits",
    "rule_candidates": f"{CANDIDATES} SELECT event_id, candidates FROM tech",
    "technique_assigned": f"{CANDIDATES} SELECT event_id, technique_id FROM tech",
    "technique_metadata": f"""{CANDIDATES}, {META}
        SELECT technique_id, count(*) AS events, coalesce(any_value(name), technique_id) AS technique_name,
          coalesce(CASE any_value(tactic) WHEN 'credential-access' THEN 'Credential Access'
            WHEN 'initial-access' THEN 'Initial Access' WHEN 'exfiltration' THEN 'Exfiltration'
            WHEN 'impact' THEN 'Impact' WHEN 'execution' THEN 'Execution' END, 'Unknown') AS technique_tactic,
          coalesce(any_value(description), 'Technique not found in local fallback table.') AS technique_description
        FROM tech LEFT JOIN meta ON technique_id = id GROUP BY technique_id""",
    "clusters_by_entity": f"""WITH {EV} SELECT entity, count(*) AS cluster_size, max(score) AS max_score,
        arg_min(event_id, (us, event_id)) AS first_event_id,
        arg_max(event_id, (score, -us, -event_id)) AS top_event_id FROM e WHERE score > 0.4 GROUP BY entity""",
    "clusters_by_technique": f"""{CANDIDATES} SELECT entity2 AS entity, technique_id, bucket,
        count(*) AS cluster_size, min(us) AS first_us, max(us) AS last_us FROM tech GROUP BY ALL""",
    "clusters_by_clock_time": f"""{CANDIDATES} SELECT entity2 AS entity, technique_id,
        strftime(make_timestamp(us // 300000000 * 300000000), 'T%H:%M') AS bucket, count(*) AS cluster_size
        FROM tech GROUP BY ALL""",
    "cluster_lookup": f"""{CANDIDATES}, big AS (SELECT entity2, technique_id, bucket FROM tech GROUP BY ALL
          ORDER BY count(*) DESC, min((us, event_id)) LIMIT 1)
        SELECT event_id, entity2 AS entity, technique_id, bucket FROM tech SEMI JOIN big
        USING (entity2, technique_id, bucket)""",
    "triage_clusters": f"""{TRIAGE} SELECT entity, cluster_size, max_score, candidates, technique_id,
        technique_name, tr.tactic, severity, confidence,
        substr('Anomaly score ' || printf('%.3f', max_score) || ' triggered on entity ' || entity ||
          '. Top contributing features: ' || summary || '. Heuristic rules matched technique ' || technique_id ||
          ' (' || tr.tactic || ').', 1, 500) AS rationale,
        coalesce(action, 'Investigate host and isolate if confirmed malicious.') AS recommended_action
        FROM tr LEFT JOIN act ON tr.tactic = act.tactic""",
    "incident_titles": f"""{TRIAGE} SELECT entity, tactic || ' via ' || technique_name || ' — ' ||
        coalesce(host_name, 'unknown') AS title FROM tr""",
    "severity_and_confidence": f"""WITH {EV} SELECT event_id, {BAND.format('score')} AS severity,
        CAST(printf('%.3f', least(score * 1.1, 1.0)) AS DOUBLE) AS confidence FROM e""",
    "tactic_actions": f"""{HITS}, {ACTIONS} SELECT tactic, action, count(*) AS hits
        FROM hits LEFT JOIN act USING (tactic) GROUP BY ALL""",
    "top_three_features": f"""{NINE}, {TOP3.format(tod='round(tod, 4)', vel='round(vel, 4)')}
        SELECT event_id, string_agg(name, ',' ORDER BY rn) AS names,
          round(max(CASE WHEN rn = 1 THEN x END), 3) AS first_value FROM top3 GROUP BY event_id""",
    "entity_keys": f"WITH {EV} SELECT event_id, entity, entity2 FROM e",
    "clock_buckets": f"""WITH {EV} SELECT strftime(make_timestamp(us // 300000000 * 300000000), 'T%H:%M') AS bucket,
        count(*) AS n FROM e GROUP BY 1""",
    "contexts_by_position": f"""WITH {EV}, m AS (SELECT max(event_id) // 2 AS last FROM e)
        SELECT a.event_id, b.action AS context_action FROM e a CROSS JOIN m
        JOIN e b ON b.event_id = least(a.event_id, m.last)""",
}
