"""Detection rules and technique metadata: small dimension data read on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTEXT_COLUMNS = {
    "event_type": "string", "action": "string", "dest_port": "int",
    "event_count_1m": "double", "event_count_5m": "double",
    "distinct_dest_ports": "double", "dest_ip_fanout": "double",
    "bytes_transferred": "double", "geo_velocity_kmh": "double",
    "source_is_internal": "boolean", "dest_is_internal": "boolean", "dest_is_external": "boolean",
    "anomaly_score": "double", "command_line": "string", "user": "string", "api_call": "string",
    "parent_process": "string", "process": "string",
}
CONTEXT_DDL = ", ".join(f"`{k}` {v}" for k, v in CONTEXT_COLUMNS.items())

# What a condition may contain besides context columns and literals.
ALLOWED_WORDS = {"and", "or", "not", "in", "is", "null", "true", "false", "between", "like",
                 "contains", "startswith", "endswith"}
ALLOWED_FUNCTIONS = {"contains", "startswith", "endswith", "in", "and", "or", "not"}

# Technique id -> name, tactic, description where no ATT&CK bundle is given, fixed values.
TECHNIQUES = {
    "T1110.001": ("Password Guessing", "credential-access",
                  "Brute force attacks guessing passwords against SSH/other services."),
    "T1110": ("Brute Force", "credential-access",
              "Multiple failed authentication attempts indicative of brute forcing."),
    "T1078": ("Valid Accounts", "initial-access",
              "Use of legitimate credentials - impossible travel or stolen creds."),
    "T1041": ("Exfiltration Over C2 Channel", "exfiltration",
              "Large outbound transfer to external destination."),
    "T1021": ("Remote Services", "lateral-movement",
              "Lateral movement via remote access services (SMB/RDP/SSH)."),
    "T1068": ("Exploitation for Privilege Escalation", "privilege-escalation",
              "Privilege escalation via sudo/setuid or kernel exploits."),
    "T1498": ("Network Denial of Service", "impact",
              "High-rate traffic characteristic of DDoS/Volumetric attack."),
    "T1059": ("Command and Scripting Interpreter", "execution",
              "Suspicious command-line arguments or parent/child process tree."),
}
NOT_FOUND = "Technique not found in local fallback table."


@dataclass(frozen=True)
class Rule:
    id: str
    technique_id: str
    name: str
    tactic: str
    condition: str


def load_rules(path: str | None = None) -> list[Rule]:
    """Rules in file order from JSON, or YAML where a YAML parser is installed."""
    file = Path(path) if path else Path(__file__).parent.parent / "resources" / "rules.json"
    text = file.read_text(encoding="utf-8")
    if file.suffix in (".yaml", ".yml"):
        import yaml
        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    rows = data.get("rules", data) if isinstance(data, dict) else data
    return [Rule(**{k: r[k] for k in Rule.__dataclass_fields__}) for r in rows]


def condition_problem(condition: str) -> str | None:
    """Why a condition is not a plain predicate over the context, or None if it is."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", condition)
    if re.search(r"[;`\"\\\[\]{}]|--|/\*|\w\.\s*[A-Za-z_]|->", bare):
        return "disallowed character"
    for word in re.findall(r"[A-Za-z_]\w*", bare):
        if word.lower() not in ALLOWED_WORDS and word not in CONTEXT_COLUMNS:
            return f"unknown name {word}"
    if re.search(r"[+*/%&|^~]|[\w')]\s*-", bare):
        return "arithmetic"
    for call in re.findall(r"([A-Za-z_]\w*)\s*\(", bare):
        if call.lower() not in ALLOWED_FUNCTIONS:
            return f"call of {call}"
    return None


def failing_cast(probe: DataFrame, condition: str) -> str | None:
    """The first implicit conversion in the analyzed condition that may fail on a row's values: of anything but a
    number to a type other than text."""
    plan = probe.sparkSession.sql(f"EXPLAIN EXTENDED SELECT {condition} AS c FROM {{probe}}", probe=probe).first()[0]
    analyzed = plan.split("== Analyzed Logical Plan ==")[1].split("== Optimized Logical Plan ==")[0]
    for value, kind in re.findall(r"\bcast\((.*?)(?:#\d+L?)? as (\w+)", analyzed):
        number = CONTEXT_COLUMNS.get(value) in ("int", "double") or re.fullmatch(r"-?[\d.]+(E-?\d+)?", value)
        if kind != "string" and not number:
            return f"conversion of {value} to {kind}"
    return None


def split_rules(spark: SparkSession, rules: list[Rule]) -> tuple[list[Rule], list[tuple[Rule, str]]]:
    """Usable rules, and those left out with the reason; checked against the typed context."""
    probe = spark.createDataFrame([], CONTEXT_DDL)
    good, bad = [], []
    for rule in rules:
        problem = condition_problem(rule.condition)
        if problem is None:
            try:
                kind = probe.select(F.expr(rule.condition).alias("c")).schema["c"].dataType.typeName()
                problem = failing_cast(probe, rule.condition) if kind == "boolean" else f"not a boolean but {kind}"
            except Exception as exc:  # the analyzer's own message
                problem = str(exc).splitlines()[0]
        if problem:
            bad.append((rule, problem))
        else:
            good.append(rule)
    return good, bad


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame(
        [(i, r.id, r.technique_id, r.name, r.tactic, r.condition) for i, r in enumerate(rules)],
        "ordinal int, rule_id string, technique_id string, name string, tactic string, condition string")


def title_case_tactic(c):
    """'credential-access' -> 'Credential Access'; titles pass unchanged."""
    return F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))


def fallback_techniques(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in TECHNIQUES.items()],
                                 "technique_id string, name string, tactic string, description string")


BUNDLE = ("objects array<struct<type: string, name: string, description: string, "
          "external_references: array<struct<source_name: string, external_id: string>>, "
          "kill_chain_phases: array<struct<phase_name: string>>>>")


def read_techniques(spark: SparkSession, bundle_path: str | None = None) -> DataFrame:
    """ATT&CK patterns of a STIX bundle with their first kill-chain phase; techniques the bundle lacks come
    from the fallback. Each id once: of repeated ids the first by name and text."""
    if bundle_path is None:
        return fallback_techniques(spark)
    objects = (spark.read.schema(BUNDLE).json(bundle_path, multiLine=True)
               .select(F.explode("objects").alias("o")).filter("o.type = 'attack-pattern'"))
    refs = F.filter("o.external_references", lambda r: r["source_name"] == "mitre-attack")
    given = objects.select(
        F.try_element_at(refs, F.lit(1))["external_id"].alias("technique_id"),
        F.col("o.name").alias("name"),
        F.coalesce(F.try_element_at(F.col("o.kill_chain_phases"), F.lit(1))["phase_name"],
                   F.lit("Unknown")).alias("tactic"),
        F.coalesce("o.description", F.lit("No description available.")).alias("description"),
    ).filter("technique_id is not null")
    both = given.withColumn("_rank", F.lit(0)).unionByName(
        fallback_techniques(spark).withColumn("_rank", F.lit(1)))
    first = both.groupBy("technique_id").agg(F.min(F.struct("_rank", "name", "tactic", "description")).alias("_t"))
    return first.select("technique_id", "_t.name", "_t.tactic", "_t.description")
