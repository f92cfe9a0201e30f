"""Indicator, graph, lookup, session and evaluation queries, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..functions.keys import entity_feature, epoch_bucket, event_micros, tie_breaker
from ..functions.network import address_key, is_cidr, is_ip
from ..operators import attribution as A
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import indicators as IOC
from ..operators.incidents import incident_key, incident_timeline
from ..operators.locate import locate, ranges_of_networks
from ..operators.sessions import attach_sessions, score_history, sessions
from .driver_tables import activity, security_events, table
from .reference_sql import EV


def sanitized_logs(spark, sf):
    d = table(spark, sf, "documents")
    clean = X.sanitize_log(F.col("text"))
    return d.select("doc_id", F.length(clean).cast("bigint").alias("n"), F.sha2(clean, 256).alias("digest"))


def sanitized_html(spark, sf):
    """Raw page markup with terminal colour codes put in, made safe for a report."""
    coloured = F.concat(F.lit("\x1b[31m"), F.col("html"), F.lit("\x1b[0m"))
    return table(spark, sf, "pages").select("page_id", F.sha2(X.sanitize_log(coloured), 256).alias("digest"))


def sanitized_labels(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.sanitize_label(F.col("html")).alias("label"))


def safe_variables(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", X.is_safe_variable(F.col("url")).cast("int").alias("safe_url"),
                    X.is_hostname(IOC.url_host(F.col("url"))).cast("int").alias("host_ok"),
                    X.is_hostname_loose(F.col("url")).cast("int").alias("url_is_host"))


def candidate_iocs(spark, sf):
    """Typed indicator values, valid and hostile, formed from the activity columns."""
    e = F.expr
    return activity(spark, sf).select(
        "event_id", e("element_at(array('ip','cidr','port','hostname','username'), cast(1 + event_id % 5 as int))").alias("type"),
        e("""case event_id % 5
            when 0 then case k % 6 when 0 then concat('10.0.', k, '.', k + 200) when 1 then concat('fe80::', k)
                when 2 then concat('10.0.0.1; rm ', k) when 3 then concat(' 10.1.2.', k, ' ') when 4 then concat('01.2.3.', k)
                else concat('1:2:3:4:5:6:7:', k) end
            when 1 then case k % 4 when 0 then concat('10.0.0.0/', k) when 1 then concat('10.0.', k, '.0') when 2 then
                concat('2001:db8::/', k + 60) else '10.0.0.0/255.255.0.0' end
            when 2 then case k % 4 when 0 then cast(k * 1000 as string) when 1 then concat(k, 'x') when 2 then concat('0', k)
                else concat('-', k) end
            when 3 then case k % 4 when 0 then concat('web-', k, '.corp') when 1 then concat('-bad', k) when 2 then
                concat('host$(', k, ')') else repeat('a', k + 10) end
            else case k % 4 when 0 then concat('alice_', k) when 1 then concat('Bob', k) when 2 then concat('u; drop ', k)
                else repeat('z', k) end end""").alias("value"))


def ioc_split(spark, sf):
    good, bad = IOC.validate_iocs(candidate_iocs(spark, sf))
    return good.select("event_id", "type", "value", "clean").unionByName(
        bad.withColumn("clean", F.lit(None).cast("string")))


def ioc_by_field(spark, sf):
    """Page addresses checked as url, as host name, as address and under an unknown name."""
    p = table(spark, sf, "pages")
    host = IOC.url_host(F.col("url"))
    return p.select("page_id", *[
        IOC.is_valid_field(F.lit(name), value).cast("int").alias(f"{name}_ok")
        for name, value in (("url", F.col("url")), ("domain", host), ("src_ip", host), ("other", F.col("url")), ("port", F.length("url").cast("string")))])


def ioc_variables(spark, sf):
    """Playbook variables by their hints; keys without a hint take the generic pattern."""
    keys = ["attacker_ip", "target_subnet", "port", "victim_host", "victim_user"]
    i = candidate_iocs(spark, sf).withColumn("key", F.when(F.col("event_id") % 7 == 0, F.lit("incident_id")).otherwise(
        F.element_at(F.array(*[F.lit(k) for k in keys]), (1 + F.col("event_id") % 5).cast("int"))))
    return i.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count(IOC.clean_variable(F.col("key"), F.col("value"))).alias("valid"))


def entity_rows(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "cast(l_orderkey as string) as incident_id",
        "l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey as position",
        "element_at(array('attacker', 'victim', 'pivot', 'context'), cast(1 + l_partkey % 4 as int)) as role",
        "case when l_partkey % 5 > 0 then concat('10.', l_suppkey % 200, '.0.', l_linenumber) else '' end as ip",
        "case when l_partkey % 3 > 0 then concat('host-', l_partkey % 50) end as host",
        "case when l_partkey % 7 < 2 then concat('user', l_suppkey) end as user",
        "case when l_suppkey % 2 = 0 then 'DE' end as geo_country")


def indicators(spark, sf):
    return IOC.incident_indicators(entity_rows(spark, sf))


def indicators_any(spark, sf):
    return IOC.incident_indicators_any_role(entity_rows(spark, sf))


def nodes(spark, sf):
    return G.graph_nodes(entity_rows(spark, sf))


def sides(spark, sf):
    return G.edge_sides(entity_rows(spark, sf)).groupBy("incident_id", "edge", "side").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("first"))


def edges(spark, sf):
    return G.edge_counts(entity_rows(spark, sf))


def edge_page(spark, sf):
    """The third page of 500 edges."""
    return G.edge_page(entity_rows(spark, sf), first=1000, size=500)


def playbooks(spark, sf):
    from .driver_tables import incident_table
    return incident_table(spark, sf).select("id", G.playbook(F.coalesce("technique", F.lit(""))).alias("playbook"))


def evidence(spark, sf):
    """The first five sanitized lines per incident; conversations are the incidents."""
    c = table(spark, sf, "conversations")
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("rank", rank).filter("rank <= 5").select(
        "conv_id", "rank", F.sha2(X.sanitize_log(F.col("text")), 256).alias("digest"))


def ranges(spark, sf):
    """Address ranges per nation: one wide and one narrow inside it."""
    wide = table(spark, sf, "nation").selectExpr(
        "(10L << 24) + ((n_nationkey * 8L) << 16) as start_ip", "(10L << 24) + ((n_nationkey * 8L + 7) << 16) + 65535 as end_ip",
        "n_name as country", "64000 + n_nationkey as network")
    narrow = table(spark, sf, "nation").selectExpr(
        "(10L << 24) + ((n_nationkey * 8L) << 16) as start_ip", "(10L << 24) + ((n_nationkey * 8L) << 16) + 49 as end_ip",
        "concat(n_name, ' core') as country", "65000 + n_nationkey as network")
    return wide.unionByName(narrow)


def located(spark, sf):
    rows = activity(spark, sf).selectExpr("event_id as id", "case when k = 7 then 'n/a' else concat('10.', user_id % 250, '.0.', k) end as ip")
    return locate(rows, ranges(spark, sf)).select(F.col("id").alias("event_id"), "country", "network")


def located_both_families(spark, sf):
    """Addresses of both families in several spellings, over networks and ranges that nest and overlap."""
    x = F.expr
    rows = activity(spark, sf).select(
        F.col("event_id").alias("id"),
        x("""case when k = 7 then 'n/a' else case event_id % 5
             when 0 then format_string('2001:db8:%x:%x::%x', user_id % 250, k % 4, k)
             when 1 then format_string('2001:0DB8:%04X:%04X:0000:0000:0000:%04X', user_id % 250, k % 4, k)
             when 2 then format_string('2001:db8:%x:%x::0.0.0.%d%%eth0', user_id % 250, k % 4, k)
             when 3 then format_string('10.%d.0.%d', user_id % 250, k)
             else format_string('::ffff:10.%d.0.%d', user_id % 250, k) end end""").alias("ip"))
    n = table(spark, sf, "nation").withColumn("h", F.col("n_nationkey") * 8)
    networks = n.select(F.explode(F.array(
        F.struct(x("format_string('2001:db8:%x::/45', h)").alias("network"), x("concat(n_name, ' wide')").alias("country")),
        F.struct(x("format_string('2001:db8:%x:1::/64', h)").alias("network"), x("concat(n_name, ' net')").alias("country")),
        F.struct(x("format_string('10.%d.0.99/13', h)").alias("network"), x("concat(n_name, ' wide4')").alias("country")))).alias("r")).select("r.*")
    spans = n.select(F.explode(F.array(
        F.struct(x("format_string('2001:db8:%x::', h)").alias("start_ip"), x("format_string('2001:db8:%x:1::20', h)").alias("end_ip"),
                 x("concat(n_name, ' across')").alias("country")),
        F.struct(x("format_string('2001:db8:%x:1::11', h)").alias("start_ip"), x("format_string('2001:db8:%x:1::40', h)").alias("end_ip"),
                 x("concat(n_name, ' core')").alias("country")),
        F.struct(x("format_string('10.%d.0.0', h)").alias("start_ip"), x("format_string('10.%d.0.49', h)").alias("end_ip"),
                 x("concat(n_name, ' core4')").alias("country")))).alias("r")).select("r.*")
    keyed = spans.select(address_key(F.col("start_ip")).alias("start_ip"), address_key(F.col("end_ip")).alias("end_ip"), "country")
    every = ranges_of_networks(networks).select("start_ip", "end_ip", "country").unionByName(keyed)
    return locate(rows, every, part_rows=200).select(F.col("id").alias("event_id"), "country")


def alert_rows(spark, sf):
    return security_events(spark, sf).select(
        "id", entity_feature().alias("entity"), F.col("event.action").alias("technique_id"),
        event_micros().alias("us"), tie_breaker("id").alias("tie"), "anomaly_score", "log").filter("anomaly_score > 0.4")


def session_query(spark, sf):
    return sessions(alert_rows(spark, sf))


def session_members(spark, sf):
    return attach_sessions(alert_rows(spark, sf)).select(F.col("id").cast("bigint").alias("event_id"), "session_start")


def history(spark, sf):
    h = score_history(alert_rows(spark, sf))
    return h.select(F.col("id").cast("bigint").alias("event_id"), F.size("score_history").alias("n"),
                    F.array_join(F.transform("score_history", lambda s: F.round(s * 10000).cast("bigint").cast("string")), ",").alias("scores"))


def timeline(spark, sf):
    """Events behind each incident's alerts, fetched by id from the event table."""
    alerts = alert_rows(spark, sf).select(F.concat_ws("@", "entity", epoch_bucket("us", 3600)).alias("incident_id"),
                                          F.col("id").alias("event_id"))
    events = security_events(spark, sf).select(F.col("id").alias("event_id"), "timestamp", F.col("event.action").alias("action"),
                                               F.col("log.raw").alias("raw_preview"))
    return incident_timeline(alerts, events).select("incident_id", F.unix_micros("timestamp").alias("us"), "action", "raw_preview")


def blended(spark, sf):
    raw, mse = F.col("value") / 400 - 0.4, F.col("value") / 300
    return activity(spark, sf).select("event_id", A.blend(A.forest_score(raw), A.reconstruction_score(mse)).alias("anomaly_score"))


def judged(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 1000 / 1000).alias("score"))
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")


def matrix_query(spark, sf):
    r = E.rates(E.confusion(judged(spark, sf), 0.4))
    return r.select("tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fpr", "fnr")],
                    F.col("passed").cast("int").alias("passed"))


def auc_query(spark, sf):
    return E.roc_auc(judged(spark, sf)).select(F.round("roc_auc", 6).alias("roc_auc"))


def curve_query(spark, sf):
    return E.precision_recall_curve(judged(spark, sf)).select(
        "threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def threshold_query(spark, sf):
    return E.choose_threshold(E.precision_recall_curve(judged(spark, sf)), 0.5, 0.25).select("threshold")


def volume_query(spark, sf):
    v = E.extrapolate(E.confusion(judged(spark, sf), 0.4))
    return v.withColumn("cost_per_day", F.round("cost_per_day", 4))


def report_query(spark, sf):
    return E.report(judged(spark, sf), 0.4).select("metric", F.round("value", 6).alias("value"))


QUERIES = {
    "sanitized_logs": sanitized_logs, "sanitized_html": sanitized_html, "sanitized_labels": sanitized_labels,
    "safe_variables": safe_variables, "ioc_validation": ioc_split, "ioc_by_field": ioc_by_field,
    "ioc_variables": ioc_variables, "incident_indicators": indicators, "incident_indicators_any_role": indicators_any,
    "graph_nodes": nodes, "graph_edge_sides": sides, "graph_edge_counts": edges, "graph_edge_page": edge_page, "playbook_choice": playbooks,
    "evidence_lines": evidence, "address_lookup": located, "address_lookup_both_families": located_both_families, "incident_sessions": session_query,
    "incident_session_members": session_members, "score_history": history, "incident_timeline": timeline,
    "score_blend": blended, "confusion_and_rates": matrix_query, "roc_auc": auc_query,
    "precision_recall_curve": curve_query, "chosen_threshold": threshold_query,
    "volume_extrapolation": volume_query, "evaluation_report": report_query,
}

CLEAN = r"""replace(replace(regexp_replace(regexp_replace({0}, '\x1b\[[0-9;]*m', '', 'g'), '[<>{{}}"\[\]|;`]', '', 'g'),
    '&', '&amp;'), '''', '&#x27;')[:500]"""
HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"
IOCS = r"""
i AS (SELECT event_id, k, event_id % 5 AS t, ['ip','cidr','port','hostname','username'][1 + event_id % 5] AS type,
  CASE event_id % 5
    WHEN 0 THEN CASE k % 6 WHEN 0 THEN '10.0.' || k || '.' || (k + 200) WHEN 1 THEN 'fe80::' || k
      WHEN 2 THEN '10.0.0.1; rm ' || k WHEN 3 THEN ' 10.1.2.' || k || ' ' WHEN 4 THEN '01.2.3.' || k ELSE '1:2:3:4:5:6:7:' || k END
    WHEN 1 THEN CASE k % 4 WHEN 0 THEN '10.0.0.0/' || k WHEN 1 THEN '10.0.' || k || '.0' WHEN 2 THEN '2001:db8::/' || (k + 60)
      ELSE '10.0.0.0/255.255.0.0' END
    WHEN 2 THEN CASE k % 4 WHEN 0 THEN CAST(k * 1000 AS VARCHAR) WHEN 1 THEN k || 'x' WHEN 2 THEN '0' || k ELSE '-' || k END
    WHEN 3 THEN CASE k % 4 WHEN 0 THEN 'web-' || k || '.corp' WHEN 1 THEN '-bad' || k WHEN 2 THEN 'host$(' || k || ')'
      ELSE repeat('a', k + 10) END
    ELSE CASE k % 4 WHEN 0 THEN 'alice_' || k WHEN 1 THEN 'Bob' || k WHEN 2 THEN 'u; drop ' || k ELSE repeat('z', k) END END AS value
  FROM e),
ok AS (SELECT *, CASE t
    WHEN 0 THEN CASE k % 6 WHEN 0 THEN CASE WHEN k + 200 <= 255 THEN value END WHEN 1 THEN value WHEN 3 THEN trim(value) WHEN 5 THEN value END
    WHEN 1 THEN CASE k % 4 WHEN 0 THEN CASE WHEN k <= 32 THEN value END WHEN 1 THEN value WHEN 2 THEN CASE WHEN k + 60 <= 128 THEN value END
      ELSE value END
    WHEN 2 THEN CASE k % 4 WHEN 0 THEN CASE WHEN k * 1000 BETWEEN 1 AND 65535 THEN value END WHEN 2 THEN CAST(k AS VARCHAR) END
    WHEN 3 THEN CASE k % 4 WHEN 0 THEN value WHEN 3 THEN CASE WHEN k + 10 <= 63 THEN value END END
    ELSE CASE k % 4 WHEN 0 THEN value WHEN 3 THEN CASE WHEN k BETWEEN 1 AND 32 THEN value END END END AS clean FROM i)"""
ENT = """WITH ent AS (SELECT CAST(l_orderkey AS VARCHAR) AS incident_id,
    l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS position,
    ['attacker', 'victim', 'pivot', 'context'][1 + l_partkey % 4] AS role,
    CASE WHEN l_partkey % 5 > 0 THEN '10.' || (l_suppkey % 200) || '.0.' || l_linenumber END AS ip,
    CASE WHEN l_partkey % 3 > 0 THEN 'host-' || (l_partkey % 50) END AS host,
    CASE WHEN l_partkey % 7 < 2 THEN 'user' || l_suppkey END AS usr,
    CASE WHEN l_suppkey % 2 = 0 THEN 'DE' END AS geo FROM lineitem)"""
AL = f"WITH {EV}, a AS (SELECT *, action AS technique_id FROM e WHERE score > 0.4)"
SESS = f"""{AL}, g AS (SELECT *, coalesce(us - lag(us) OVER w > 300000000, true) AS fresh FROM a
    WINDOW w AS (PARTITION BY entity, technique_id ORDER BY us, event_id)),
  s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY entity, technique_id ORDER BY us, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g),
  st AS (SELECT *, min(us) OVER (PARTITION BY entity, technique_id, sid) AS session_start FROM s)"""
JUDGED = "WITH j AS (SELECT n_chars % 1000 / 1000.0 AS score, quality AS label FROM labels JOIN documents USING (doc_id))"
CM = f"""{JUDGED}, c AS (SELECT count(*) FILTER (score >= 0.4 AND label = 1) AS tp, count(*) FILTER (score < 0.4 AND label <> 1) AS tn,
    count(*) FILTER (score >= 0.4 AND label <> 1) AS fp, count(*) FILTER (score < 0.4 AND label = 1) AS fn FROM j),
  m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr,
    coalesce(fn / nullif(fn + tp, 0), 0) AS fnr FROM c)"""
# Every positive against every negative, by rank sums with averaged ties.
AUC = """r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM j),
  auc AS (SELECT (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
    / (count(*) FILTER (label = 1) * count(*) FILTER (label <> 1)) AS v FROM r)"""
CURVE = f"""{JUDGED}, t AS (SELECT DISTINCT score AS threshold FROM j),
  pr AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold) AS flagged,
    count(*) FILTER (label = 1) AS p FROM t CROSS JOIN j GROUP BY threshold)"""

ORACLES = {
    "sanitized_logs": f"SELECT doc_id, length({CLEAN.format('text')}) AS n, sha256({CLEAN.format('text')}) AS digest FROM documents",
    "sanitized_html": f"SELECT page_id, sha256({CLEAN.format('html')}) AS digest FROM pages",
    "sanitized_labels": r"""SELECT page_id, '"' || coalesce(nullif(regexp_replace(regexp_replace(html, '[<>\[\]{}|;"''`]', '', 'g'),
        '^\s+|\s+$', '', 'g')[:80], ''), 'unknown') || '"' AS label FROM pages""",
    "safe_variables": rf"""SELECT page_id, CASE WHEN regexp_full_match(url, '[A-Za-z0-9_.:/-]+') THEN 1 ELSE 0 END AS safe_url,
        CASE WHEN regexp_full_match({HOST}, '([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)*[a-z0-9]+') THEN 1 ELSE 0 END AS host_ok, 0 AS url_is_host FROM pages""",
    "ioc_validation": f"WITH {EV}, {IOCS} SELECT event_id, type, value, clean FROM ok",
    "ioc_by_field": r"""SELECT page_id, 1 AS url_ok, 1 AS domain_ok, 0 AS src_ip_ok,
        CASE WHEN regexp_full_match(url, '[A-Za-z0-9_.:/-]+') THEN 1 ELSE 0 END AS other_ok, 1 AS port_ok FROM pages""",
    "ioc_variables": rf"""WITH {EV}, {IOCS} SELECT CASE WHEN event_id % 7 = 0 THEN 'incident_id' ELSE
          ['attacker_ip','target_subnet','port','victim_host','victim_user'][1 + t] END AS key, count(*) AS n,
          count(CASE WHEN event_id % 7 = 0 THEN CASE WHEN regexp_full_match(value, '[A-Za-z0-9_.:/ -]{{1,200}}') THEN 1 END
            WHEN clean IS NOT NULL THEN 1 END) AS valid FROM ok GROUP BY 1""",
    "incident_indicators": f"""{ENT} SELECT incident_id,
        coalesce(arg_max(ip, position) FILTER (role = 'attacker' AND ip IS NOT NULL), '0.0.0.0') AS attacker_ip,
        coalesce(arg_max(host, position) FILTER (role = 'victim' AND host IS NOT NULL), 'unknown-host') AS victim_host,
        coalesce(arg_max(ip, position) FILTER (role = 'victim' AND ip IS NOT NULL), '127.0.0.1') AS victim_ip,
        coalesce(arg_max(usr, position) FILTER (role = 'victim' AND usr IS NOT NULL), 'unknown-user') AS victim_user FROM ent GROUP BY 1""",
    "incident_indicators_any_role": f"""{ENT} SELECT incident_id,
        coalesce(arg_max(ip, position) FILTER (role = 'attacker' AND ip IS NOT NULL), '0.0.0.0') AS attacker_ip,
        coalesce(arg_max(host, position) FILTER (host IS NOT NULL), 'unknown-host') AS victim_host,
        coalesce(arg_max(ip, position) FILTER (role <> 'attacker' AND ip IS NOT NULL), '127.0.0.1') AS victim_ip,
        coalesce(arg_max(usr, position) FILTER (usr IS NOT NULL), 'nobody') AS victim_user FROM ent GROUP BY 1""",
    "graph_nodes": f"""{ENT}, p AS (SELECT *, concat_ws('\\n', ip, host, 'user:' || usr, '(' || geo || ')') AS parts FROM ent)
        SELECT incident_id, position, role, '"' || CASE WHEN parts = '' THEN role ELSE array_to_string(string_split(parts, '\\n')[1:2], '\\n') END || '"' AS label,
          CASE role WHEN 'attacker' THEN 'fill:#ef4444,color:#fff,stroke:#dc2626' WHEN 'victim' THEN 'fill:#f97316,color:#fff,stroke:#ea580c'
            WHEN 'pivot' THEN 'fill:#eab308,color:#000,stroke:#ca8a04' ELSE 'fill:#3b82f6,color:#fff,stroke:#2563eb' END AS style FROM p""",
    "graph_edge_sides": f"""{ENT}, s(edge, side, role) AS (VALUES ('attack', 'from', 'attacker'), ('attack', 'to', 'victim'),
          ('pivot', 'from', 'attacker'), ('pivot', 'to', 'pivot'), ('lateral', 'from', 'pivot'), ('lateral', 'to', 'victim'))
        SELECT incident_id, edge, side, count(*) AS n, min(position) AS first FROM ent JOIN s USING (role) GROUP BY ALL""",
    "graph_edge_counts": f"""{ENT}, s(edge, fr, tr) AS (VALUES ('attack', 'attacker', 'victim'), ('pivot', 'attacker', 'pivot'), ('lateral', 'pivot', 'victim'))
        SELECT a.incident_id, edge, count(DISTINCT a.position) AS sources, count(DISTINCT b.position) AS targets, count(*) AS edges
        FROM ent a JOIN s ON a.role = fr JOIN ent b ON b.incident_id = a.incident_id AND b.role = tr GROUP BY ALL""",
    "graph_edge_page": f"""{ENT}, s(edge, fr, tr) AS (VALUES ('attack', 'attacker', 'victim'), ('pivot', 'attacker', 'pivot'), ('lateral', 'pivot', 'victim')),
        numbered AS (SELECT row_number() OVER (ORDER BY a.incident_id, edge, a.position, b.position) - 1 AS number, a.incident_id, edge,
          a.position AS from_position, b.position AS to_position
          FROM ent a JOIN s ON a.role = fr JOIN ent b ON b.incident_id = a.incident_id AND b.role = tr)
        SELECT * FROM numbered WHERE number BETWEEN 1000 AND 1499""",
    "playbook_choice": """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_custkey % 10 = 9 THEN 'generic_block.yml' ELSE
        ['brute_force.yml','brute_force.yml','lateral_movement.yml','lateral_movement.yml','port_scan_block.yml','ddos_mitigation.yml',
         'data_exfil_egress_block.yml','impossible_travel_lockout.yml','scripting_interpreter_block.yml'][1 + o_custkey % 10] END AS playbook FROM orders""",
    "evidence_lines": f"""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS rank,
        sha256({CLEAN.format('text')}) AS digest FROM conversations QUALIFY rank <= 5""",
    "address_lookup": f"""WITH {EV} SELECT event_id,
        CASE WHEN k <> 7 AND user_id % 250 < 200 THEN 'NATION_' || (user_id % 250 // 8) ||
          CASE WHEN user_id % 250 % 8 = 0 AND k < 50 THEN ' core' ELSE '' END END AS country,
        CAST(CASE WHEN k <> 7 AND user_id % 250 < 200 THEN CASE WHEN user_id % 250 % 8 = 0 AND k < 50 THEN 65000 ELSE 64000 END
          + user_id % 250 // 8 END AS INT) AS network FROM e""",
    "address_lookup_both_families": f"""WITH {EV},
        asked AS (SELECT event_id, event_id % 5 < 3 AS v6, CASE WHEN k = 7 THEN NULL WHEN event_id % 5 < 3
            THEN (user_id % 250)::HUGEINT * 1208925819614629174706176 + (k % 4)::HUGEINT * 18446744073709551616 + k
            ELSE (user_id % 250)::HUGEINT * 65536 + k END AS place FROM e),
        n AS (SELECT n_name, (n_nationkey * 8)::HUGEINT * 1208925819614629174706176 AS b6, (n_nationkey * 8)::HUGEINT * 65536 AS b4,
            18446744073709551616::HUGEINT AS s FROM nation),
        r AS (SELECT true AS v6, b6 AS lo, b6 + 8 * 1208925819614629174706176::HUGEINT - 1 AS hi, n_name || ' wide' AS country FROM n
          UNION ALL SELECT true, b6 + s, b6 + 2 * s - 1, n_name || ' net' FROM n
          UNION ALL SELECT true, b6, b6 + s + 32, n_name || ' across' FROM n
          UNION ALL SELECT true, b6 + s + 17, b6 + s + 64, n_name || ' core' FROM n
          UNION ALL SELECT false, b4, b4 + 8 * 65536 - 1, n_name || ' wide4' FROM n
          UNION ALL SELECT false, b4, b4 + 49, n_name || ' core4' FROM n)
        SELECT event_id, arg_min(country, (hi - lo, lo)) AS country FROM asked LEFT JOIN r ON asked.v6 = r.v6 AND place BETWEEN lo AND hi
        GROUP BY event_id""",
    "incident_sessions": f"""{SESS} SELECT entity, technique_id, session_start, max(us) AS session_end, count(*) AS alert_count
        FROM st GROUP BY ALL""",
    "incident_session_members": f"{SESS} SELECT event_id, session_start FROM st",
    "score_history": f"""{AL} SELECT event_id, CAST(count(*) OVER w AS INT) AS n,
        string_agg(CAST(CAST(round(score * 10000) AS BIGINT) AS VARCHAR), ',') OVER w AS scores FROM a
        WINDOW w AS (PARTITION BY entity ORDER BY us, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "incident_timeline": f"""{AL} SELECT entity || '@' || (us // 3600000000) AS incident_id, us, action,
        event_type || ' k=' || k AS raw_preview FROM a""",
    "score_blend": """SELECT event_id, CAST(printf('%.4f',
        greatest(least((value / 400 - 0.4 + 0.5) / 1.5, 1.0), 0.0) * 0.6 + greatest(least(value / 300 / 0.5, 1.0), 0.0) * 0.4) AS DOUBLE)
        AS anomaly_score FROM events""",
    "confusion_and_rates": f"""{CM} SELECT tp, tn, fp, fn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1,
        round(fpr, 6) AS fpr, round(fnr, 6) AS fnr, CASE WHEN "precision" >= 0.75 AND recall >= 0.9 THEN 1 ELSE 0 END AS passed FROM m""",
    "roc_auc": f"{JUDGED}, {AUC} SELECT round(v, 6) AS roc_auc FROM auc",
    "precision_recall_curve": f"""{CURVE} SELECT threshold, round(tp / flagged, 6) AS "precision", round(tp / p, 6) AS recall FROM pr""",
    "chosen_threshold": f"{CURVE} SELECT max(threshold) AS threshold FROM pr WHERE tp / flagged >= 0.5 AND tp / p >= 0.25",
    "volume_extrapolation": f"""{CM} SELECT CAST(floor(50000000 * (tp + fp) / (tp + tn + fp + fn)) AS BIGINT) AS flagged_per_day,
        CAST(floor(50000000 * tp / (tp + tn + fp + fn) / 5) AS BIGINT) AS calls_per_day,
        round(50000000 * (tp + fp) / (tp + tn + fp + fn) / 1000 * 0.18, 4) AS cost_per_day FROM m""",
    "evaluation_report": f"""{CM}, {AUC}, x AS (SELECT *, CASE WHEN "precision" >= 0.75 AND recall >= 0.9 THEN 1 ELSE 0 END AS passed,
          v AS roc_auc FROM m CROSS JOIN auc)
        SELECT unnest(['tp','tn','fp','fn','precision','recall','f1','fpr','fnr','passed','roc_auc']) AS metric,
          round(unnest([tp::DOUBLE, tn, fp, fn, "precision", recall, f1, fpr, fnr, passed, roc_auc]), 6) AS value FROM x""",
}
