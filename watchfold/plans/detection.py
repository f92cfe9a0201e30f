"""From events to triaged clusters, as one lazy frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import entity_cluster
from ..operators.attribution import top_features
from ..operators.clusters import cluster_by_entity
from ..operators.features import extract_features
from ..operators.rules import static_context, with_candidates
from ..operators.triage import triage
from ..settings import THRESHOLD
from ..sources.rules import CONTEXT_COLUMNS


def contexts(events: DataFrame, *carry: str, literal: bool = False) -> DataFrame:
    """Every event with its rule context: narrow scalar columns only, so the raw text never
    travels through the feature shuffles and is fetched by id where a report needs it."""
    static = [c.alias(n) for n, c in static_context(literal).items()]
    return extract_features(
        events, *static, entity_cluster().alias("entity2"),
        F.coalesce("log.source_type", F.lit("unknown")).alias("source_type"),
        F.col("host.name").alias("host_name"), *carry)


def anomalies(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.filter(F.col("anomaly_score") > threshold)


def triaged_clusters(scored: DataFrame, rules, threshold: float = THRESHOLD) -> DataFrame:
    """Clusters of anomalous events by entity, matched on their top event and triaged."""
    hot = anomalies(scored, threshold)
    if "top_features" not in hot.columns:
        hot = hot.withColumn("top_features", top_features())
    payload = [c for c in CONTEXT_COLUMNS] + ["top_features", "host_name"]
    clusters = cluster_by_entity(hot, *payload)
    matched = with_candidates(clusters, rules)
    named = matched.withColumns({"technique_name": F.col("primary_rule.name"),
                                 "tactic": F.col("primary_rule.tactic")})
    return triage(named.drop("rule_hits", "primary_rule"))
