import json

import pytest
from pyspark.sql import functions as F

from watchfold.functions.keys import clock_bucket, entity_cluster, entity_feature
from watchfold.functions.rounding import fixed_text, round_exact
from watchfold.operators.clusters import cluster_by_entity, cluster_events, find_cluster, largest_first
from watchfold.operators.events import event_columns
from watchfold.operators.rules import (assign_contexts, attach_technique, context_columns, rule_matches,
                                       with_candidates, with_technique)
from watchfold.operators.triage import triage
from watchfold.sources.rules import (CONTEXT_COLUMNS, CONTEXT_DDL, Rule, condition_problem, load_rules,
                                     read_techniques, split_rules)

DEFAULTS = {"string": "", "int": 0, "double": 0.0, "boolean": False}


def contexts(spark, *changes):
    rows = [tuple(c.get(k, DEFAULTS[t]) for k, t in CONTEXT_COLUMNS.items()) for c in changes]
    return spark.createDataFrame(rows, CONTEXT_DDL)


def candidates(spark, **change):
    return with_candidates(contexts(spark, change), load_rules()).first().technique_ids


@pytest.mark.parametrize("change, expected", [
    ({"event_type": "auth", "action": "failed", "dest_port": 22, "event_count_5m": 15.0}, ["T1110.001"]),
    ({"event_type": "auth", "action": "failed", "dest_port": 443, "event_count_5m": 15.0}, []),
    ({"bytes_transferred": 6e8, "dest_is_external": True, "anomaly_score": 0.95}, ["T1041"]),
    ({"geo_velocity_kmh": 2000.0, "event_type": "auth", "action": "success"}, ["T1078"]),
    ({"event_type": "process", "command_line": "sudo chmod u+s x", "user": "", "anomaly_score": 0.9}, ["T1548.003", "T1548.001"]),
    ({"event_type": "process", "command_line": "sudo x", "user": "root", "anomaly_score": 0.9}, []),
    ({"event_type": "process", "api_call": "xWriteProcessMemory"}, ["T1055"]),
    ({"event_type": "process", "parent_process": "excel.exe", "process": "cmd.exe"}, ["T1059"]),
    ({"distinct_dest_ports": 60.0, "dest_ip_fanout": 3.0}, ["T1046"]),
    ({"event_count_1m": 1001.0, "bytes_transferred": 2e8}, ["T1498"]),
    ({"event_type": "network", "dest_port": 445, "source_is_internal": True, "dest_is_internal": True, "anomaly_score": 0.9}, ["T1021.002"]),
    ({}, []),
])
def test_rules(spark, change, expected):
    assert candidates(spark, **change) == expected


@pytest.mark.parametrize("condition", [
    "__import__('os')", "java_method('a', 'b')", "dest_port = (select 1)", "dest_port > 1; drop", "event.action = 'x'",
    "unknown_name = 1", "exists(array(1), x -> x > 0)", "reflect('a') = 'b'"])
def test_unsafe_conditions_are_left_out(spark, condition):
    assert condition_problem(condition)
    good, bad = split_rules(spark, [Rule("r", "T1", "n", "t", condition)])
    assert not good and len(bad) == 1


def test_ill_typed_condition_is_left_out(spark):
    good, bad = split_rules(spark, [Rule("r", "T1", "n", "t", "dest_port"), *load_rules()])
    assert len(good) == 15 and bad[0][1].startswith("not a boolean")


@pytest.mark.parametrize("condition, holds", [
    ("user in ('alice', 'bob') and not dest_port = 23", True), ("contains(command_line, 'bash') or dest_port > 99", True),
    ("user not in ('alice')", False), ("dest_port between 1 and 21", False)])
def test_condition_forms(spark, condition, holds):
    c = contexts(spark, {"user": "alice", "dest_port": 22, "command_line": "/bin/bash"})
    assert rule_matches(c, [Rule("r", "T1", "n", "t", condition)], "user").count() == int(holds)


def test_yaml_and_json_rules(tmp_path):
    rule = {"id": "a", "technique_id": "T1", "name": "n", "tactic": "t", "condition": "dest_port = 1"}
    (tmp_path / "r.json").write_text(json.dumps({"rules": [rule]}))
    assert load_rules(str(tmp_path / "r.json"))[0].id == "a"
    yaml = pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text(yaml.safe_dump({"rules": [rule]}))
    assert load_rules(str(tmp_path / "r.yaml")) == load_rules(str(tmp_path / "r.json"))


def test_technique_metadata(spark, tmp_path):
    ids = spark.createDataFrame([("T1078",), ("T9999",)], "technique_id string")
    rows = {r.technique_id: r for r in attach_technique(ids, read_techniques(spark)).collect()}
    assert rows["T1078"].technique_name == "Valid Accounts" and rows["T1078"].technique_tactic == "Initial Access"
    assert rows["T9999"].technique_name == "T9999" and rows["T9999"].technique_tactic == "Unknown"
    bundle = {"objects": [
        {"type": "attack-pattern", "name": "From bundle", "description": "d", "kill_chain_phases": [{"phase_name": "lateral-movement"}],
         "external_references": [{"source_name": "other", "external_id": "x"}, {"source_name": "mitre-attack", "external_id": "T9999"}]},
        {"type": "malware", "name": "no"}]}
    (tmp_path / "b.json").write_text(json.dumps(bundle, indent=1))
    found = attach_technique(ids, read_techniques(spark, str(tmp_path / "b.json"))).filter("technique_id = 'T9999'").first()
    assert (found.technique_name, found.technique_tactic) == ("From bundle", "Lateral Movement")


def test_default_techniques(spark):
    c = contexts(spark, {"dest_port": 22}, {"action": "FAILED"}, {"bytes_transferred": 5e8}, {"bytes_transferred": 5.0, "dest_is_external": True},
                 {"distinct_dest_ports": 10.0}, {})
    assert [r.technique_id for r in with_technique(c, load_rules()).collect()] == [
        "T1110.001", "T1110.001", "T1498", "T1041", "T1046", "T1110.001"]


def scored(spark, rows):
    return spark.createDataFrame(rows, "id string, entity string, technique_id string, us bigint, tie bigint, anomaly_score double")


def test_clusters(spark):
    minute = 60_000_000
    rows = [(str(i), "a", "T1", (370 + i) * minute, i, 0.5 + i / 10) for i in range(3)] + [("9", "b", "T1", 372 * minute, 9, 0.9)]
    got = largest_first(cluster_events(scored(spark, rows))).collect()
    assert [(r.entity, r.cluster_size) for r in got] == [("a", 3), ("b", 1)]
    assert find_cluster(scored(spark, rows), "a", "T1", 371 * minute).count() == 3
    day = 86_400_000_000
    again = rows + [("10", "a", "T1", 370 * minute + day, 10, 0.1)]
    assert cluster_events(scored(spark, again)).count() == 3
    assert cluster_events(scored(spark, again), ignore_date=True).count() == 2
    assert largest_first(cluster_events(scored(spark, []))).collect() == []


def test_cluster_by_entity_takes_first_of_equal_maxima(spark):
    rows = [("1", "a", "T", 5, 1, 0.9), ("2", "a", "T", 3, 2, 0.4), ("3", "a", "T", 9, 3, 0.9), ("4", "a", "T", 1, 4, None)]
    r = cluster_by_entity(scored(spark, rows)).first()
    assert (r.cluster_size, r.max_score, r.first_event_id, r.top_event_id) == (4, 0.9, "4", "1")


def test_entity_precedence(spark):
    df = spark.createDataFrame([("1.2.3.4", "h", "u"), (None, "h", "u"), ("", "", "u"), (None, None, None)], "ip string, h string, u string")
    e = df.select(*event_columns({"source.ip": F.col("ip"), "host.name": F.col("h"), "user.name": F.col("u")}))
    assert [tuple(r) for r in e.select(entity_cluster(), entity_feature()).collect()] == [
        ("1.2.3.4", "1.2.3.4"), ("h", "u"), ("u", "u"), ("unknown", "unknown")]


def test_clock_bucket(spark):
    df = spark.createDataFrame([("2026-08-11T06:13:45Z",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(clock_bucket("t")).collect()] == ["T06:10", "T00:00", "T00:00"]


def test_contexts_are_padded_with_the_last(spark):
    events = spark.createDataFrame([(i,) for i in range(5)], "position int")
    given = spark.createDataFrame([(0, "a"), (1, "b")], "position int, ctx string")
    got = {r.position: r.ctx for r in assign_contexts(events, given).collect()}
    assert got == {0: "a", 1: "b", 2: "b", 3: "b", 4: "b"}


def test_top3_only_context(spark):
    df = spark.createDataFrame([(5.0, [("event_count_1m", 5.0)])], "x double, top_features array<struct<name: string, value: double>>")
    e = df.select(*event_columns({}), F.lit(0.9).alias("anomaly_score"), "top_features", F.col("x").alias("event_count_1m"),
                  F.lit(7.0).alias("event_count_5m"), *[F.lit(0.0).alias(c) for c in
                  ("distinct_dest_ports", "dest_ip_fanout", "bytes_transferred", "geo_velocity_kmh")])
    r = e.select(*[c.alias(n) for n, c in context_columns(top3_only=True).items()]).first()
    assert r.event_count_1m == 5.0 and r.event_count_5m == 0.0


@pytest.mark.parametrize("score, techniques, name, tactic, severity, technique, action", [
    (0.9, ["T1110.001"], "Brute Force", "Credential Access", "critical", "T1110.001", "reset affected credentials"),
    (0.4, [], None, None, "low", "T0000", "Investigate host"), (0.7, [], None, None, "high", "T0000", "Investigate"),
    (0.5, [], None, None, "medium", "T0000", "Investigate")])
def test_triage(spark, score, techniques, name, tactic, severity, technique, action):
    df = spark.createDataFrame([("10.0.0.5", score, [("event_count_1m", 15.0)], techniques, name, tactic)],
                               "entity string, max_score double, top_features array<struct<name: string, value: double>>, "
                               "technique_ids array<string>, technique_name string, tactic string")
    r = triage(df).first()
    assert (r.severity, r.technique_id) == (severity, technique) and action in r.recommended_action
    assert "10.0.0.5" in r.rationale and "event_count_1m=15.0" in r.rationale
    assert r.confidence == round(min(score * 1.1, 1.0), 3)


def test_rounding_is_exact(spark):
    values = [i / 10000 for i in range(0, 10001, 5)] + [i / 10000 * 1.1 for i in range(0, 9000, 7)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", round_exact(F.col("v"), 3).alias("r"), fixed_text(F.col("v"), 3).alias("t")).collect():
        assert (r.r, r.t) == (round(r.v, 3), f"{r.v:.3f}")
