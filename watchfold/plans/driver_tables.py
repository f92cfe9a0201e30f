"""The analytics tables read as security records: one fixed formula per column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import event_columns
from ..session import prepare

BASE_US = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with time compressed 60-fold and its JSON key as a number."""
    return activity_columns(table(spark, sf_dir, "events"))


def activity_columns(events: DataFrame) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        "event_id", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        us.alias("raw_us"),
    ).withColumn("us", F.expr(f"{BASE_US}L + (raw_us - {BASE_US}L) div 60L"))


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_security_events(activity(spark, sf_dir))


def as_security_events(acts: DataFrame) -> DataFrame:
    """Activity rows in the event schema; ids are zero-padded so text order is arrival order."""
    e = F.expr
    event_id = e("lpad(cast(event_id as string), 12, '0')")
    values = {
        "id": event_id, "event.id": event_id,
        "timestamp": e("timestamp_micros(us)"),
        "event.kind": F.lit("event"),
        "event.category": e("case when event_type in ('error','signup') then array('authentication') "
                            "when event_type = 'click' then array('process') else array('network') end"),
        "event.action": e("case event_type when 'error' then 'ssh_login_failed' when 'signup' then "
                          "'ssh_login_success' when 'click' then 'sudo_command' else 'network_flow' end"),
        "event.outcome": e("case when event_type = 'error' then 'failure' else 'success' end"),
        "source.ip": e("case user_id % 5 when 0 then '10.1.0.7' when 1 then '172.200.4.9' "
                       "when 2 then '203.0.113.44' when 3 then null else '' end"),
        "source.geo.location.lat": e("case when event_id % 3 = 0 then -60.0D + 20 * (event_id % 7) end"),
        "source.geo.location.lon": e("case when event_id % 3 = 0 then -150.0D + 30 * (event_id % 11) end"),
        "destination.ip": e("case when k = 99 then '' when k < 50 then concat('10.0.0.', k % 20) "
                            "else concat('198.51.100.', k) end"),
        "destination.port": e("case k % 10 when 0 then 22 when 1 then 3389 when 2 then 80 when 3 then 443 "
                              "when 4 then 445 when 5 then 139 when 6 then 0 else 1000 + k end"),
        "user.name": e("case user_id % 5 when 3 then 'svc-backup' when 4 then null else "
                       "case when user_id % 2 = 0 then 'root' else 'alice' end end"),
        "host.name": e("case when user_id % 7 = 0 then null else concat('host-', user_id % 3) end"),
        "log.source_type": e("case event_id % 4 when 0 then 'syslog' when 1 then 'auth_log' "
                             "when 2 then 'cloudtrail' else 'cicids' end"),
        "log.raw": e("concat(event_type, ' k=', k)"),
        "network.bytes": e("cast(floor(value * 1e6) as bigint)"),
        "process.command_line": e("case when event_type = 'click' then case when k < 40 then "
                                  "concat('sudo systemctl restart svc', k) when k < 60 then "
                                  "'chmod u+s /usr/bin/tool' else 'ls -la' end end"),
        "process.parent": e("case when event_type = 'click' then case k % 4 when 0 then 'winword.exe' "
                            "when 1 then 'excel.exe' else 'explorer.exe' end end"),
        "process.name": e("case when event_type = 'click' then case k % 3 when 0 then 'cmd.exe' "
                          "when 1 then 'powershell.exe' else 'notepad.exe' end end"),
        "ts_fallback": F.lit(False),
    }
    return acts.select(*event_columns(values), e("least(cast(round(value * 100) as bigint) * 5 div 6, 10000L) / 10000.0D").alias("anomaly_score"))


TECHNIQUE_LIST = ["T1110.001", "T1110", "T1021.002", "T1021.001", "T1046", "T1498", "T1041", "T1078", "T1059.003"]


def incident_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as incidents."""
    listed = ", ".join(f"'{t}'" for t in TECHNIQUE_LIST)
    return table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) as id", "concat('c', o_custkey) as entity",
        f"case when o_custkey % 10 < 9 then element_at(array({listed}), cast(1 + o_custkey % 10 as int)) end as technique",
        "case o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'high' when '3-MEDIUM' then 'medium' "
        "when '5-LOW' then 'low' end as severity",
        "case o_orderstatus when 'O' then 'open' when 'F' then 'resolved' else 'investigating' end as status",
        "o_totalprice as confidence",
        "cast(o_orderdate as timestamp) as created_at",
        "cast(o_orderdate as timestamp) + make_dt_interval(0, 0, cast(o_custkey % 1440 as int)) as updated_at")


def alert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as alerts of those incidents."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyyMMdd')) as id",
        "cast(l_orderkey as string) as incident_id",
        "named_struct('ip', concat('10.', l_suppkey % 200, '.0.', l_linenumber), 'host', concat('Host-', l_partkey % 50), "
        "'user', case when l_suppkey % 3 = 0 then concat('user', l_suppkey) end) as entity",
        "case when round(l_tax * 100) = 8 then null when l_discount = 0 then 0D else l_quantity / 50 end as anomaly_score",
        "case l_returnflag when 'A' then 'ack' when 'R' then 'closed' else case when l_linestatus = 'O' then 'new' end end as status",
        "case when l_quantity >= 42 then 'critical' when l_quantity >= 35 then 'high' when l_quantity >= 25 then 'medium' else 'low' end as severity",
        "case l_partkey % 3 when 0 then 'T1110.001' when 1 then 'T1046' else 'T1021' end as technique",
        "cast(l_shipdate as timestamp) + make_dt_interval(0, 0, 0, cast((l_partkey * 37 + l_suppkey) % 86400 as int)) as created_at")


def chat_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as ledger actions: one chain per conversation, in turn order."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat('inc_', conv_id) as incident_id", "role as action", "concat('actor', length(text)) as actor",
        "concat('2024-01-01T00:00:0', turn) as timestamp", "turn")


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a log of model calls, with latency and decimal cost."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "cast(o_orderdate as timestamp) as called_at",
        "cast(o_custkey * 7 % 5000 as int) as latency_ms", "cast(1 + o_orderkey % 5 as int) as cluster_size",
        "cast(cast(round(o_totalprice * 100) as bigint) / 1000000000BD as decimal(20, 9)) as cost_usd")
