import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from watchfold.operators import evaluation
from watchfold.operators.incidents import alert_change_payloads
from watchfold.operators.normalize_text import normalize_syslog, with_line_id
from watchfold.operators.training import flow_features
from watchfold.schema import FEATURES
from watchfold.sources.logs import split_bad
from watchfold.sources.rules import TECHNIQUES, Rule, load_rules, read_techniques, split_rules
from watchfold.sources.tables import append_table, read_table, write_snapshots


def test_report_is_written_as_json(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (0, 0.5), (1, 0.4)], "label int, score double")
    evaluation.write_report(evaluation.report(df, 0.4), str(tmp_path / "r"))
    lines = [json.loads(x) for p in Path(tmp_path / "r").glob("*.json") for x in p.read_text().splitlines()]
    got = {x["metric"]: x["value"] for x in lines}
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (2, 1, 0, 1) and got["recall"] == 1.0 and got["roc_auc"] == 0.75


def test_snapshots_by_week(spark, tmp_path):
    week = 7 * 86_400_000_000
    f = spark.range(20).select(F.col("id").cast("string").alias("id"), (F.col("id") % 2 * week + 1_704_067_200_000_000).alias("us"))
    write_snapshots(f, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {(str(r.week), r["count"]) for r in back.groupBy("week").count().collect()} == {("2024-01-01", 10), ("2024-01-08", 10)}


def test_append_keeps_declared_columns(spark, tmp_path):
    row = spark.sql("select 'x' as incident_id, 1L as seq, 'created' as action, 'system' as actor, cast(null as string) as previous_hash, "
                    "'h' as this_hash, 't' as timestamp, 'extra' as other")
    append_table(row, str(tmp_path), "ledger", "monday")
    append_table(row, str(tmp_path), "ledger", "monday")
    append_table(row, str(tmp_path), "ledger", "tuesday")
    back = read_table(spark, str(tmp_path), "ledger")
    assert back.count() == 2 and back.columns == ["incident_id", "seq", "action", "actor", "previous_hash", "this_hash", "timestamp"]


def test_custody_hash_covers_the_whole_record(spark):
    lines = spark.createDataFrame([(str(i), "Jan  5 10:00:00 alpha app: " + "x" * 1500 + end) for i, end in enumerate("aab")],
                                  "line_id string, raw string")
    rows = normalize_syslog(lines, 2026).orderBy("id").select("related.hash", F.length("log.raw").alias("n")).collect()
    assert rows[0].hash == rows[1].hash != rows[2].hash and {r.n for r in rows} == {1000}


def test_ids_are_stable_and_equal_records_keep_their_own(spark):
    lines = spark.createDataFrame([("f", "same")] * 300 + [("g", "same"), ("f", "other"), ("f", ""), (None, None)], "path string, raw string")
    ids = [sorted((r.raw or "", r.line_id) for r in with_line_id(df).select("raw", "line_id").collect()) for df in (lines, lines.repartition(7))]
    assert ids[0] == ids[1] and len({i for _, i in ids[0]}) == 304 and [r for r, _ in ids[0]].count("same") == 301
    twice = lines.select("raw", "raw", "path")
    assert with_line_id(twice).columns == ["raw", "raw", "path", "line_id"] and with_line_id(twice.limit(0)).count() == 0


def test_quarantine_keeps_whole_records(spark):
    _, bad = split_bad(spark.createDataFrame([("{" + "y" * 2000,)], "raw string"), "cloudtrail")
    row = bad.first()
    assert len(row.raw) == 2001 and len(row.preview) == 500


def test_draws_do_not_depend_on_partitions(spark):
    rows = spark.range(300).selectExpr("cast(id as string) as line_id", "id % 9 as `Total Fwd Packets`", "'BENIGN' as Label")
    wanted = flow_features(rows).select("line_id", *FEATURES).orderBy("line_id").collect()
    assert wanted == flow_features(rows.repartition(7)).select("line_id", *FEATURES).orderBy("line_id").collect()
    z = [r.tod_zscore for r in wanted]
    assert abs(sum(z)) / len(z) < 0.3 and 0.7 < sum(x * x for x in z) / len(z) < 1.3


def test_changes_name_the_status_before(spark):
    alerts = spark.createDataFrame([("a", "i", "new"), ("b", None, "new")], "id string, incident_id string, status string")
    changes = spark.sql("""select * from values ('a', 'closed', 'lee', timestamp '2026-01-02', 1L), ('a', 'ack', 'lee', timestamp '2026-01-02', 0L),
        ('b', 'nonsense', 'lee', timestamp '2026-01-01', 0L), ('c', 'ack', 'lee', timestamp '2026-01-01', 0L)
        as t(alert_id, new_status, actor, ts, seq)""")
    said = [json.loads(r.payload) for r in alert_change_payloads(alerts, changes).orderBy("ts", "seq").collect()]
    assert [(x["from"], x["to"]) for x in said] == [("new", "ack"), ("ack", "closed")]


def test_bundle_is_completed_and_deduplicated(spark, tmp_path):
    def pattern(number, name):
        return {"type": "attack-pattern", "name": name, "external_references": [{"source_name": "mitre-attack", "external_id": number}]}
    (tmp_path / "b.json").write_text(json.dumps({"objects": [pattern("T1078", "Mine"), pattern("T1078", "Other")]}))
    got = {r.technique_id: r.name for r in read_techniques(spark, str(tmp_path / "b.json")).collect()}
    assert got["T1078"] == "Mine" and got["T1110"] == "Brute Force" and set(got) >= set(TECHNIQUES)


@pytest.mark.parametrize("condition", ["user > 5", "dest_port = 'ssh'", "bytes_transferred / dest_port > 1", "dest_port -1 > 2",
                                       "source_is_internal = 'maybe'"])
def test_conditions_that_may_fail_are_left_out(spark, condition):
    assert split_rules(spark, [Rule("r", "T1", "n", "t", condition)])[0] == []


def test_conditions_on_numbers_stay(spark):
    good, bad = split_rules(spark, [Rule("r", "T1", "n", "t", "dest_port > -1 and anomaly_score >= 1 and bytes_transferred > 2.5"), *load_rules()])
    assert bad == [] and len(good) == 1 + len(load_rules())


def test_flow_lines_with_other_fields_are_left_to_the_quarantine(spark, tmp_path):
    """Reading flow files as events takes the good lines only; the others are in the quarantine, whole."""
    from watchfold.sources.logs import read_events, split_flows
    (tmp_path / "flows.csv").write_text("Source IP,Destination IP,Destination Port,Label\n10.0.0.1,10.0.0.2,80,BENIGN\n10.0.0.3,short\n"
                                        "10.0.0.4,10.0.0.5,22,DDoS\n1,2,3,4,5,6\n")
    events = read_events(spark, str(tmp_path), "cicids")
    assert sorted(r.ip for r in events.select("source.ip").collect()) == ["10.0.0.1", "10.0.0.4"]
    good, bad = split_flows(spark, str(tmp_path))
    assert good.count() == 2 and sorted(r.raw for r in bad.collect()) == ["1,2,3,4,5,6", "10.0.0.3,short"]


def test_daily_counts_let_the_scan_skip_files(spark, tmp_path):
    from watchfold.operators.dashboards import per_day
    rows = spark.createDataFrame([("2024-01-01 23:59:59.999999",), ("2024-01-02 00:00:00",), ("2024-01-03 23:59:59.999999",), ("2024-01-04 00:00:00",),
                                  (None,)], "t string").select(F.col("t").cast("timestamp").alias("created_at"))
    rows.write.parquet(str(tmp_path / "alerts"))
    counted = per_day(spark.read.parquet(str(tmp_path / "alerts")), "2024-01-03", 2)
    assert sorted((str(r.day), r.n) for r in counted.collect()) == [("2024-01-02", 1), ("2024-01-03", 1)]
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at" in plan and "LessThan(created_at" in plan
