"""Source and normalizer queries: raw records written from the activity table, read back as
events. The check SQL states the expected fields from the activity columns, without patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.events import contract_violations
from ..operators.normalize_cloud import normalize_cloudtrail
from ..operators.normalize_flow import normalize_cicids
from ..operators.normalize_text import normalize_auth_log, normalize_syslog
from ..operators.training import seeded_sample, training_features
from ..session import shared_dir
from ..sources.logs import (list_source_types, read_events, read_flows, read_lines, split_bad, split_flows,
                            union_events)
from ..sources.rules import load_rules, rules_frame, split_rules
from ..sources.tables import write_events
from .driver_tables import activity, security_events
from .raw_lines import auth_lines, cloud_lines, flow_rows, syslog_lines
from .reference_sql import EV

INGEST = "2024-02-01 00:00:00"


def fields(events):
    return events.select(
        F.col("id").cast("bigint").alias("event_id"), F.unix_seconds("timestamp").alias("ts"),
        F.col("ts_fallback").cast("int").alias("ts_fallback"),
        F.col("event.action").alias("action"), F.col("event.outcome").alias("outcome"),
        F.array_join("event.category", ",").alias("category"),
        F.col("source.ip").alias("src_ip"), F.col("source.port").alias("src_port"),
        F.col("destination.host").alias("dest_host"), F.col("destination.port").alias("dest_port"),
        F.col("user.name").alias("user_name"), F.col("host.name").alias("host"),
        F.length("log.raw").alias("raw_length"), F.length("related.hash").alias("hash_length"))


def syslog_query(spark, sf):
    return fields(normalize_syslog(syslog_lines(activity(spark, sf)), 2024, INGEST))


def auth_query(spark, sf):
    return fields(normalize_auth_log(auth_lines(activity(spark, sf)), 2024, INGEST)).drop("raw_length")


def cloud_query(spark, sf):
    n = normalize_cloudtrail(cloud_lines(activity(spark, sf)), INGEST, emit_parse_errors=True)
    return fields(n).join(n.select(F.col("id").cast("bigint").alias("event_id"), F.col("user.id").alias("arn"),
                                   F.col("user.domain").alias("account")), "event_id").drop("raw_length")


def flow_query(spark, sf):
    n = normalize_cicids(flow_rows(activity(spark, sf)), INGEST)
    raw = F.from_json("log.raw", "label string, flow_duration double, total_fwd_packets bigint, "
                                 "total_bwd_packets bigint, flow_bytes_per_s double")
    extra = n.select(F.col("id").cast("bigint").alias("event_id"), raw.alias("r")).select("event_id", "r.*")
    return fields(n).join(extra, "event_id").drop("raw_length")


def quarantine_query(spark, sf):
    good, bad = split_bad(cloud_lines(activity(spark, sf)), "cloudtrail")
    return (good.select(F.lit("good").alias("part")).unionByName(bad.select(F.lit("bad").alias("part")))
            .groupBy("part").agg(F.count(F.lit(1)).alias("n")))


def union_query(spark, sf):
    """All four sources as one event table, counted by source and action."""
    acts = activity(spark, sf)
    merged = union_events(
        normalize_syslog(syslog_lines(acts), 2024, INGEST), normalize_auth_log(auth_lines(acts), 2024, INGEST),
        normalize_cloudtrail(cloud_lines(acts), INGEST), normalize_cicids(flow_rows(acts), INGEST))
    return merged.groupBy(F.col("log.source_type").alias("source_type")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event.outcome") == "failure").alias("failures"))


def contract_query(spark, sf):
    """Events against the contract; the unhashed parse errors are the only violations."""
    acts = activity(spark, sf)
    merged = union_events(
        normalize_syslog(syslog_lines(acts), 2024), normalize_auth_log(auth_lines(acts), 2024),
        normalize_cloudtrail(cloud_lines(acts), INGEST, emit_parse_errors=True))
    bad = contract_violations(merged)
    return bad.select(F.col("log.source_type").alias("source_type"), F.explode("failed_rules").alias("rule")) \
        .groupBy("source_type", "rule").agg(F.count(F.lit(1)).alias("n"))


def custody_query(spark, sf):
    """Equal content has an equal hash whatever its id: distinct hashes against distinct lines."""
    lines = auth_lines(activity(spark, sf))
    n = normalize_auth_log(lines, 2024, INGEST)
    return n.agg(F.count_distinct("related.hash").alias("hashes"), F.count_distinct("log.raw").alias("contents"))


def text_files_query(spark, sf):
    """Lines written as text files, read back through the source registry."""
    path = shared_dir(spark, "auth-text")
    auth_lines(activity(spark, sf)).select("raw").write.text(path)
    events = read_events(spark, path, "AUTH", year=2024, ingest_time=INGEST)
    return events.groupBy(F.col("event.action").alias("action"), F.col("event.outcome").alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user.name").alias("users"))


def stable_ids_query(spark, sf):
    """The same files read twice, the second time dealt out in other splits: all ids differ and all come again."""
    path = shared_dir(spark, "auth-again")
    auth_lines(activity(spark, sf)).select("raw").write.text(path)
    first = read_events(spark, path, "auth", year=2024, ingest_time=INGEST).select("id")
    second = normalize_auth_log(read_lines(spark, path).repartition(7), 2024, INGEST).select("id", F.lit(1).alias("again"))
    return first.join(second, "id", "left").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("id").alias("ids"), F.count("again").alias("found_again"))


def cloud_files_query(spark, sf):
    path = shared_dir(spark, "cloud-text")
    cloud_lines(activity(spark, sf)).select("raw").write.text(path)
    good, bad = split_bad(read_lines(spark, path), "cloudtrail")
    events = normalize_cloudtrail(good, INGEST)
    return (events.groupBy(F.col("event.action").alias("action")).agg(F.count(F.lit(1)).alias("n"))
            .unionByName(bad.groupBy(F.lit("quarantine").alias("action")).agg(F.count(F.lit(1)).alias("n"))))


def flow_files_query(spark, sf):
    path = shared_dir(spark, "flow-csv")
    flow_rows(activity(spark, sf)).drop("line_id").write.csv(path, header=True, ignoreLeadingWhiteSpace=False,
                                                             ignoreTrailingWhiteSpace=False)
    events = read_events(spark, path, "cicids", ingest_time=INGEST)
    return events.groupBy(F.col("event.action").alias("action"), F.col("event.outcome").alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("destination.ip").alias("targets"))


def flow_quarantine_query(spark, sf):
    """Flow CSV in which some lines lost their last fields and some have one too many: events by action, and the quarantine."""
    path = shared_dir(spark, "flow-broken")
    rows = flow_rows(activity(spark, sf)).drop("line_id")
    whole = F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in rows.columns])
    packets = F.col("` Total Fwd Packets`").cast("int")
    line = (F.when(packets % 10 == 3, F.array_join(F.slice(whole, 1, 8), ","))
            .when(packets % 10 == 4, F.concat(F.array_join(whole, ","), F.lit(",extra"))).otherwise(F.array_join(whole, ",")))
    rows.select(line.alias("value")).write.text(path)
    good, bad = split_flows(spark, path, columns=rows.columns)
    events = normalize_cicids(good, INGEST)
    return (events.groupBy(F.col("event.action").alias("action")).agg(F.count(F.lit(1)).alias("n"))
            .unionByName(bad.groupBy(F.concat(F.lit("quarantine, "), "error").alias("action")).agg(F.count(F.lit(1)).alias("n"))))


def history_query(spark, sf):
    """Events written as a table partitioned by day, then read for a range of hours."""
    path = shared_dir(spark, "history")
    write_events(security_events(spark, sf).drop("anomaly_score"), path)
    rows = spark.read.parquet(path).filter("event_date between date'2024-01-01' and date'2024-01-01'")
    return rows.groupBy(F.col("event_date").cast("string").alias("event_date"),
                        F.col("log.source_type").alias("source_type")).agg(F.count(F.lit(1)).alias("n"))


def rules_query(spark, sf):
    """Rules with the number of events whose class each rule names."""
    rules = rules_frame(spark, split_rules(spark, load_rules())[0])
    kinds = security_events(spark, sf).groupBy(F.element_at("event.category", 1).alias("category")).agg(
        F.count(F.lit(1)).alias("events"))
    named = rules.withColumn("category", F.expr(
        "case regexp_extract(condition, \"event_type = '(\\\\w+)'\", 1) when 'auth' then 'authentication' "
        "when 'process' then 'process' when 'network' then 'network' end"))
    return named.join(F.broadcast(kinds), "category", "left").select(
        "ordinal", "rule_id", "technique_id", "tactic", "events")


def sample_query(spark, sf):
    """Seeded sample without replacement: size and range; the rows are fixed by the seed."""
    rows = activity(spark, sf)
    s = seeded_sample(rows, 1000, key="event_id", seed=42)
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


def training_query(spark, sf):
    t = training_features(flow_rows(activity(spark, sf)), seed=42)
    return t.select(F.col("line_id").cast("bigint").alias("event_id"),
                    *[F.round(c, 6).alias(c) for c in
                      ["event_count_1m", "failed_auth_ratio", "distinct_dest_ports", "bytes_transferred"]])


QUERIES = {
    "normalize_syslog": syslog_query,
    "normalize_auth_log": auth_query,
    "normalize_cloudtrail": cloud_query,
    "normalize_network_flow": flow_query,
    "quarantine_split": quarantine_query,
    "source_union": union_query,
    "event_contract": contract_query,
    "custody_hash": custody_query,
    "text_log_files": text_files_query,
    "stable_event_ids": stable_ids_query,
    "json_log_files": cloud_files_query,
    "flow_csv_files": flow_files_query,
    "flow_quarantine": flow_quarantine_query,
    "event_history_by_day": history_query,
    "rules_source": rules_query,
    "training_sample": sample_query,
    "training_features": training_query,
}

R = f"""WITH {EV}, r AS (SELECT *, raw_us // 1000000 AS sec, 'user' || user_id AS u,
  '10.' || (user_id % 250) || '.0.' || k AS ip, 'host-' || (user_id % 3) AS h, 1024 + k AS p,
  user_id % 4 = 3 AS no_identity, event_type = 'purchase' AND k % 10 = 0 AS broken FROM e)"""
INGEST_S = 1706745600
NAMES = ["ConsoleLogin", "CreateUser", "DeleteUser", "AttachUserPolicy", "CreateAccessKey",
         "AuthorizeSecurityGroupIngress", "RunInstances", "StopInstances", "GetObject", "PutObject",
         "AssumeRole", "ListBuckets"]
CLOUD_ACTION = ("CASE WHEN broken THEN 'cloudtrail_parse_error' WHEN k >= 97 THEN 'unknown_action' ELSE "
                "['console_login','user_created','user_deleted','policy_attached','access_key_created',"
                "'security_group_modified','instance_launched','instance_stopped','s3_object_read',"
                "'s3_object_write','role_assumed','listbuckets'][1 + k % 12] END")
CLOUD_CATEGORY = ("CASE WHEN broken OR k >= 97 THEN 'process' ELSE ['authentication','iam','iam','iam,configuration',"
                  "'iam','network,configuration','host','host','file','file','authentication,iam','process']"
                  "[1 + k % 12] END")
AUTH_ACTION = ("CASE event_id % 9 WHEN 0 THEN 'ssh_login_failed' WHEN 1 THEN 'ssh_login_success' WHEN 2 THEN "
               "'ssh_invalid_user' WHEN 3 THEN 'sudo_command' WHEN 4 THEN CASE WHEN k % 3 = 0 THEN "
               "'su_session_closed' ELSE 'su_session_opened' END WHEN 5 THEN 'pam_auth_failure' "
               "WHEN 6 THEN 'cron_session' ELSE 'auth_event' END")
AUTH_OUTCOME = ("CASE WHEN event_id % 9 IN (0, 2, 5) THEN 'failure' WHEN event_id % 9 IN (7, 8) THEN 'unknown' "
                "ELSE 'success' END")
FLOW_ACTION = ("['network_flow','ftp_brute_force','ssh_brute_force','dos_slowloris','dos_slowhttp','dos_hulk',"
               "'dos_goldeneye','heartbleed_exploit','web_brute_force','web_xss','web_sqli','infiltration',"
               "'botnet_activity','port_scan','ddos','somenewattacktype','odd_label'][1 + k % 17]")
FLOW_OUTCOME = "CASE WHEN k % 17 = 0 THEN 'success' WHEN k % 17 >= 15 THEN 'unknown' ELSE 'failure' END"

ORACLES = {
    "normalize_syslog": f"""{R} SELECT event_id,
        CASE event_type WHEN 'purchase' THEN {INGEST_S} ELSE sec END AS ts,
        CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END AS ts_fallback,
        CASE event_type WHEN 'error' THEN 'ssh_login_failed' WHEN 'signup' THEN 'ssh_login_success'
          WHEN 'view' THEN 'ssh_login_success' ELSE 'syslog_message' END AS action,
        CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'success' WHEN 'view' THEN 'success'
          ELSE 'unknown' END AS outcome,
        CASE WHEN event_type IN ('click', 'purchase') THEN 'process' ELSE 'authentication' END AS category,
        CASE WHEN event_type NOT IN ('click', 'purchase') THEN ip END AS src_ip,
        CASE WHEN event_type NOT IN ('click', 'purchase') THEN p END AS src_port,
        CASE event_type WHEN 'purchase' THEN 'unknown' WHEN 'view' THEN 'web-' || k ELSE h END AS dest_host,
        CAST(NULL AS INT) AS dest_port,
        CASE WHEN event_type NOT IN ('click', 'purchase') THEN u END AS user_name,
        CASE event_type WHEN 'purchase' THEN 'unknown' WHEN 'view' THEN 'web-' || k ELSE h END AS host,
        CASE event_type WHEN 'purchase' THEN 1000
          WHEN 'error' THEN length(concat('Jan 00 00:00:00 ', h, ' sshd[', k, ']: Failed password for ',
            CASE WHEN k % 3 = 0 THEN 'invalid user ' ELSE '' END, u, ' from ', ip, ' port ', p, ' ssh2'))
          WHEN 'signup' THEN length(concat('Jan 00 00:00:00 ', h, ' sshd[', k, ']: Accepted ',
            CASE WHEN k % 2 = 0 THEN 'publickey' ELSE 'password' END, ' for ', u, ' from ', ip, ' port ', p, ' ssh2'))
          WHEN 'click' THEN length(concat('Jan 00 00:00:00 ', h, ' kernel: [', k, '.789] eth0: link up'))
          ELSE length(concat('<134>1 2024-01-01T00:00:00+02:00 web-', k, ' app ', k, ' - - Accepted password for ',
            u, ' from ', ip, ' port ', p, ' ssh2')) END AS raw_length,
        71 AS hash_length FROM r""",
    "normalize_auth_log": f"""{R} SELECT event_id,
        CASE event_id % 9 WHEN 8 THEN {INGEST_S} ELSE sec END AS ts,
        CASE event_id % 9 WHEN 8 THEN 1 ELSE 0 END AS ts_fallback,
        {AUTH_ACTION} AS action, {AUTH_OUTCOME} AS outcome,
        CASE event_id % 9 WHEN 3 THEN 'process,iam' WHEN 4 THEN 'authentication,session' WHEN 6 THEN 'process'
          ELSE 'authentication' END AS category,
        CASE WHEN event_id % 9 < 3 THEN ip END AS src_ip, CASE WHEN event_id % 9 < 2 THEN p END AS src_port,
        CASE event_id % 9 WHEN 8 THEN 'unknown' ELSE h END AS dest_host,
        CASE WHEN event_id % 9 < 3 THEN 22 END AS dest_port,
        CASE WHEN event_id % 9 < 6 THEN u END AS user_name,
        CASE event_id % 9 WHEN 8 THEN 'unknown' ELSE h END AS host, 71 AS hash_length FROM r""",
    "normalize_cloudtrail": f"""{R} SELECT event_id,
        CASE WHEN broken THEN {INGEST_S} ELSE sec END AS ts, CASE WHEN broken THEN 1 ELSE 0 END AS ts_fallback,
        {CLOUD_ACTION} AS action, {CLOUD_CATEGORY} AS category,
        CASE WHEN broken THEN 'unknown' WHEN event_type = 'error' THEN 'failure'
          WHEN event_type = 'click' AND k % 24 = 0 THEN 'failure' ELSE 'success' END AS outcome,
        CASE WHEN NOT broken THEN ip END AS src_ip, CAST(NULL AS INT) AS src_port,
        CASE WHEN NOT broken THEN CASE WHEN k % 5 > 0 THEN 'svc' || (k % 5) ELSE '' END END AS dest_host,
        CAST(NULL AS INT) AS dest_port,
        CASE WHEN NOT broken THEN CASE WHEN no_identity THEN 'unknown' WHEN user_id % 3 = 0 THEN u
          WHEN user_id % 3 = 1 THEN 'P' || user_id ELSE 'unknown' END END AS user_name,
        CASE WHEN NOT broken THEN CASE WHEN k % 5 > 0 THEN 'svc' || (k % 5) || '.amazonaws.com' ELSE 'aws' END END AS host,
        CASE WHEN NOT broken THEN 71 END AS hash_length,
        CASE WHEN NOT broken THEN CASE WHEN no_identity THEN '' ELSE 'arn:' || user_id END END AS arn,
        CASE WHEN NOT broken THEN CASE WHEN no_identity THEN '' ELSE '42' END END AS account FROM r""",
    "normalize_network_flow": f"""{R} SELECT event_id,
        CASE event_id % 4 WHEN 0 THEN sec WHEN 2 THEN sec WHEN 1 THEN sec // 60 * 60
          ELSE CASE WHEN day(ts) <= 12 THEN epoch(make_timestamp(2024, day(ts), 1, hour(ts), minute(ts), 0))
            ELSE sec // 60 * 60 END END::BIGINT AS ts, 0 AS ts_fallback,
        {FLOW_ACTION} AS action, {FLOW_OUTCOME} AS outcome,
        CASE WHEN k % 17 IN (0, 15, 16) THEN 'network' WHEN k % 17 IN (8, 9, 10) THEN 'network,web,intrusion_detection'
          ELSE 'network,intrusion_detection' END AS category,
        ip AS src_ip, p AS src_port, CASE WHEN k % 7 > 0 THEN '192.168.0.' || k END AS dest_host,
        CASE WHEN k % 10 <> 6 THEN nullif(k, 0) END AS dest_port, CAST(NULL AS VARCHAR) AS user_name,
        CASE WHEN k % 7 > 0 THEN '192.168.0.' || k ELSE 'unknown' END AS host, 71 AS hash_length,
        ['BENIGN','FTP-Patator','SSH-Patator','DoS slowloris','DoS Slowhttptest','DoS Hulk','DoS GoldenEye',
         'Heartbleed','Web Attack – Brute Force','Web Attack – XSS','Web Attack – Sql Injection','Infiltration',
         'Bot','PortScan','DDoS','SomeNewAttackType','Odd Label'][1 + k % 17] AS label,
        CAST(user_id AS DOUBLE) AS flow_duration, CAST(k AS BIGINT) AS total_fwd_packets,
        CAST(CASE WHEN k % 13 = 0 THEN 0 ELSE k // 2 END AS BIGINT) AS total_bwd_packets,
        CASE WHEN k % 11 < 3 THEN 0.0 ELSE value END AS flow_bytes_per_s FROM r""",
    "quarantine_split": f"{R} SELECT CASE WHEN broken THEN 'bad' ELSE 'good' END AS part, count(*) AS n FROM r GROUP BY 1",
    "source_union": f"""{R} SELECT 'syslog' AS source_type, count(*) AS events,
          count(*) FILTER (event_type = 'error') AS failures FROM r
        UNION ALL SELECT 'auth_log', count(*), count(*) FILTER (event_id % 9 IN (0, 2, 5)) FROM r
        UNION ALL SELECT 'cloudtrail', count(*), count(*) FILTER (event_type = 'error' OR (event_type = 'click' AND k % 24 = 0))
          FROM r WHERE NOT broken
        UNION ALL SELECT 'cicids', count(*), count(*) FILTER (k % 17 BETWEEN 1 AND 14) FROM r""",
    "event_contract": f"""{R} SELECT 'syslog' AS source_type, 'timestamp' AS rule, count(*) AS n FROM r WHERE event_type = 'purchase'
        UNION ALL SELECT 'auth_log', 'timestamp', count(*) FROM r WHERE event_id % 9 = 8
        UNION ALL SELECT 'cloudtrail', 'hash', count(*) FROM r WHERE broken""",
    "custody_hash": f"""{R}, t AS (SELECT CASE event_id % 9 WHEN 8 THEN 'no header at all ' || k ELSE
          concat(sec, '|', h, '|', event_id % 9, '|', k, '|', CASE WHEN event_id % 9 = 7 THEN '' ELSE u END) END AS line FROM r)
        SELECT count(DISTINCT line) AS hashes, count(DISTINCT line) AS contents FROM t""",
    "text_log_files": f"""{R} SELECT {AUTH_ACTION} AS action, {AUTH_OUTCOME} AS outcome, count(*) AS n,
        count(DISTINCT CASE WHEN event_id % 9 < 6 THEN u END) AS users FROM r GROUP BY ALL""",
    "stable_event_ids": "SELECT count(*) AS events, count(*) AS ids, count(*) AS found_again FROM events",
    "json_log_files": f"""{R} SELECT CASE WHEN broken THEN 'quarantine' ELSE {CLOUD_ACTION} END AS action,
        count(*) AS n FROM r GROUP BY ALL""",
    "flow_csv_files": f"""{R} SELECT {FLOW_ACTION} AS action, {FLOW_OUTCOME} AS outcome, count(*) AS n,
        count(DISTINCT CASE WHEN k % 7 > 0 THEN k END) AS targets FROM r GROUP BY ALL""",
    "flow_quarantine": f"""{R} SELECT CASE WHEN k % 10 = 3 THEN 'quarantine, fields filled: ' || (8 - (k % 7 = 0)::INT) || ' of 11'
          WHEN k % 10 = 4 THEN 'quarantine, fields filled: ' || (11 - (k % 7 = 0)::INT) || ' of 11' ELSE {FLOW_ACTION} END AS action,
        count(*) AS n FROM r GROUP BY ALL""",
    "event_history_by_day": f"""WITH {EV} SELECT '2024-01-01' AS event_date, source_type, count(*) AS n FROM e
        WHERE us < 1704067200000000 + 86400000000 GROUP BY ALL""",
    "training_sample": "SELECT least(count(*), 1000) AS n, least(count(*), 1000) AS ids FROM events",
    "training_features": f"""{R}, f AS (SELECT event_id, k::DOUBLE AS fwd, CASE WHEN k % 13 = 0 THEN 0 ELSE k // 2 END AS bwd,
          CASE WHEN k % 10 = 6 THEN 0 ELSE k END AS port, CASE WHEN k % 11 < 3 THEN 0.0 ELSE value END AS bps FROM r),
        x AS (SELECT event_id, fwd, CASE WHEN fwd > 0 THEN least(greatest((fwd - bwd) / (fwd + 1), 0), 1) ELSE 0 END AS ratio,
          least(greatest(port % 10 + 1, 1), 100) AS ports, bps FROM f),
        m AS (SELECT max(fwd) AS a, max(ratio) AS b, max(ports) AS c, max(bps) AS d FROM x)
        SELECT event_id, round(fwd / a, 6) AS event_count_1m, round(ratio / b, 6) AS failed_auth_ratio,
          round(ports / c, 6) AS distinct_dest_ports, round(bps / d, 6) AS bytes_transferred FROM x CROSS JOIN m""",
}

CLASS_OF_RULE = ["auth"] * 3 + [None] * 3 + ["network"] * 3 + ["auth", "process", "process", None, "process", "process"]
RULE_VALUES = ", ".join(
    f"({i}, '{r.id}', '{r.technique_id}', '{r.tactic}', {'NULL' if c is None else repr(c)})"
    for i, (r, c) in enumerate(zip(load_rules(), CLASS_OF_RULE, strict=True)))
ORACLES["rules_source"] = f"""WITH {EV}, ru(ordinal, rule_id, technique_id, tactic, cls) AS (VALUES {RULE_VALUES}),
    n AS (SELECT event_class, count(*) AS events FROM e GROUP BY 1)
    SELECT ordinal, rule_id, technique_id, tactic, events FROM ru LEFT JOIN n ON cls = event_class"""
