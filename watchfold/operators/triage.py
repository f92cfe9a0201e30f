"""Deterministic triage of clusters on column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import fixed_text, plain_text, round_exact
from .normalize_cloud import lookup

# Score bands, fixed values; the first that the score reaches applies.
SEVERITY_BANDS = [(0.85, "critical"), (0.70, "high"), (0.50, "medium"), (0.00, "low")]

# Tactic -> recommended action, fixed values.
TACTIC_ACTIONS = {
    "Credential Access": "Block source IP at perimeter firewall and reset affected credentials.",
    "Discovery": "Rate-limit or null-route scanning source; review exposed service inventory.",
    "Lateral Movement": "Isolate pivot host from internal network segment; review shared credentials.",
    "Privilege Escalation": "Suspend affected account; audit sudo/setuid changes on host.",
    "Exfiltration": "Block egress to destination IP/domain; capture packet trace for forensics.",
    "Impact": "Activate DDoS mitigation (null-route or scrubbing service); notify upstream.",
    "Initial Access": "Force re-authentication for affected accounts; review access logs.",
    "Defense Evasion": "Collect memory image of affected process; quarantine host.",
    "Execution": "Kill suspicious process tree; capture command history and file hashes.",
}
DEFAULT_ACTION = "Investigate host and isolate if confirmed malicious."
NO_TECHNIQUE = ("T0000", "Unknown Technique", "Unknown")


def severity_band(score: Column) -> Column:
    out = F.lit("low")
    for floor, name in reversed(SEVERITY_BANDS):
        out = F.when(score >= floor, name).otherwise(out)
    return out


def confidence(score: Column) -> Column:
    return round_exact(F.least(score * 1.1, F.lit(1.0)), 3)


def recommended_action(tactic: Column) -> Column:
    table = {k: (v,) for k, v in TACTIC_ACTIONS.items()}
    return F.substring(F.coalesce(lookup(table, tactic, 0), F.lit(DEFAULT_ACTION)), 1, 300)


def feature_summary(top_features: Column) -> Column:
    """'name=value, ...' of the first three features."""
    parts = F.transform(F.slice(top_features, 1, 3),
                        lambda f: F.concat(f["name"], F.lit("="), F.coalesce(plain_text(f["value"]), F.lit("?"))))
    return F.array_join(F.coalesce(parts, F.array()), ", ")


def rationale(score: Column, entity: Column, summary: Column, technique: Column, tactic: Column) -> Column:
    text = F.concat(F.lit("Anomaly score "), fixed_text(score, 3), F.lit(" triggered on entity "), entity,
                    F.lit(". Top contributing features: "), summary,
                    F.lit(". Heuristic rules matched technique "), technique,
                    F.lit(" ("), tactic, F.lit(")."))
    return F.substring(text, 1, 500)


def triage(clusters: DataFrame) -> DataFrame:
    """Add the triage columns to clusters with entity, max_score, top_features, technique_ids and
    the primary rule's technique_name and tactic (null where no rule matched)."""
    score = F.col("max_score")
    technique = F.coalesce(F.try_element_at("technique_ids", F.lit(1)), F.lit(NO_TECHNIQUE[0]))
    df = clusters.withColumns({
        "technique_id": technique,
        "technique_name": F.coalesce("technique_name", F.lit(NO_TECHNIQUE[1])),
        "tactic": F.coalesce("tactic", F.lit(NO_TECHNIQUE[2])),
    })
    return df.withColumns({
        "severity": severity_band(score),
        "confidence": confidence(score),
        "recommended_action": recommended_action(F.col("tactic")),
        "rationale": rationale(score, F.col("entity"), feature_summary(F.col("top_features")),
                               F.col("technique_id"), F.col("tactic")),
    })


def incident_title(tactic: Column, technique: Column, host: Column) -> Column:
    return F.concat(tactic, F.lit(" via "), technique, F.lit(" — "), host)
