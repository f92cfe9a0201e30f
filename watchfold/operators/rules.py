"""Rule context, rule matching and technique metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.network import is_external, is_internal
from ..schema import FEATURES
from ..sources.rules import CONTEXT_COLUMNS, NOT_FOUND, Rule, title_case_tactic

DEFAULT_TECHNIQUE = "T1110.001"


def event_class() -> Column:
    """The category list as the one word the rules compare with."""
    def has(name: str) -> Column:
        return F.coalesce(F.array_contains("event.category", name), F.lit(False))
    return (F.when(has("authentication"), "auth").when(has("process"), "process")
            .when(has("network"), "network")
            .otherwise(F.coalesce(F.try_element_at("event.category", F.lit(1)), F.lit(""))))


def result_word() -> Column:
    return (F.when(F.col("event.outcome") == "failure", "failed")
            .when(F.col("event.outcome") == "success", "success")
            .otherwise(F.coalesce("event.action", F.lit(""))))


def static_context(literal: bool = False) -> dict[str, Column]:
    """The rule inputs that need only the event itself. Missing text is '' and missing numbers
    are 0, so a comparison never meets a null. ``literal`` uses the prefix list of internal
    addresses."""
    def text(path: str) -> Column:
        return F.coalesce(F.col(path), F.lit(""))

    return {
        "event_type": event_class(), "action": result_word(),
        "dest_port": F.coalesce("destination.port", F.lit(0)),
        "source_is_internal": is_internal(F.col("source.ip"), literal),
        "dest_is_internal": is_internal(F.col("destination.ip"), literal),
        "dest_is_external": is_external(F.col("destination.ip"), literal),
        "command_line": text("process.command_line"), "user": text("user.name"),
        "api_call": text("event.action"), "parent_process": text("process.parent"),
        "process": text("process.name"),
    }


def context_columns(literal: bool = False, top3_only: bool = False) -> dict[str, Column]:
    """The 18 rule inputs of an event row that carries its features and score.

    ``top3_only`` zeroes features that are not in ``top_features``.
    """
    def number(name: str) -> Column:
        value = F.coalesce(F.col(name), F.lit(0.0))
        if top3_only:
            listed = F.exists("top_features", lambda f: f["name"] == name)
            value = F.when(F.coalesce(listed, F.lit(False)), value).otherwise(0.0)
        return value

    out = static_context(literal)
    out["anomaly_score"] = F.coalesce("anomaly_score", F.lit(0.0))
    out.update({name: number(name) for name in CONTEXT_COLUMNS if name in FEATURES})
    return {name: out[name] for name in CONTEXT_COLUMNS}


def rule_context(events: DataFrame, *keys: str, **options) -> DataFrame:
    """``keys`` and the 18 context columns."""
    return events.select(*keys, *[c.alias(n) for n, c in context_columns(**options).items()])


def with_rule_hits(contexts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``rule_hits``: all rules whose condition holds, in rule order. No shuffle, no join.

    ``split_rules`` leaves out conditions that could fail on a row's values (arithmetic, conversions of text).
    """
    hits = [F.when(F.expr(r.condition), F.struct(
        F.lit(i).alias("ordinal"), F.lit(r.id).alias("rule_id"),
        F.lit(r.technique_id).alias("technique_id"), F.lit(r.name).alias("name"),
        F.lit(r.tactic).alias("tactic"))) for i, r in enumerate(rules)]
    return contexts.withColumn("rule_hits", F.array_compact(F.array(*hits)))


def with_candidates(contexts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add the distinct techniques in rule order, and those of the first rule that holds."""
    first = F.try_element_at("rule_hits", F.lit(1))
    return with_rule_hits(contexts, rules).withColumns({
        "technique_ids": F.array_distinct(F.transform("rule_hits", lambda h: h["technique_id"])),
        "primary_rule": first,
    })


def rule_matches(contexts: DataFrame, rules: Sequence[Rule], *keys: str) -> DataFrame:
    """One row per (event, rule) that holds."""
    return with_rule_hits(contexts, rules).select(*keys, F.explode("rule_hits").alias("h")).select(
        *keys, "h.*")


def default_technique() -> Column:
    """Technique of a context that no rule matches: the first case that applies."""
    return (F.when((F.col("dest_port") == 22) | (F.lower("action") == "failed")
                   | (F.lower("event_type") == "auth"), "T1110.001")
            .when(F.col("bytes_transferred") >= 500_000_000, "T1498")
            .when(F.col("dest_is_external") & (F.col("bytes_transferred") > 0), "T1041")
            .when(F.col("distinct_dest_ports").cast("int") >= 10, "T1046")
            .otherwise(DEFAULT_TECHNIQUE))


def with_technique(contexts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``technique_id``: first matching rule, else the default cascade."""
    df = with_rule_hits(contexts, rules)
    first = F.try_element_at("rule_hits", F.lit(1))["technique_id"]
    return df.withColumn("technique_id", F.coalesce(first, default_technique())).drop("rule_hits")


def attach_technique(df: DataFrame, techniques: DataFrame, key: str = "technique_id") -> DataFrame:
    """Name, tactic and description of each technique; an unknown id names itself.

    The corpus holds each id once; Spark broadcasts it where its size allows.
    """
    meta = techniques.select(F.col("technique_id").alias("_t"), F.col("name").alias("_n"),
                             F.col("tactic").alias("_k"), F.col("description").alias("_d"))
    return df.join(meta, F.col(key) == F.col("_t"), "left").select(
        *df.columns,
        F.coalesce("_n", F.col(key)).alias("technique_name"),
        F.coalesce(title_case_tactic(F.col("_k")), F.lit("Unknown")).alias("technique_tactic"),
        F.coalesce("_d", F.lit(NOT_FOUND)).alias("technique_description"))


def assign_contexts(events: DataFrame, contexts: DataFrame, position: str = "position") -> DataFrame:
    """Join by position; events past the last context take the last one.

    The last context comes from a one-row subquery, so the padded events do not pile up on one
    join key.
    """
    payload = [c for c in contexts.columns if c != position]
    last = contexts.agg(F.max_by(F.struct(position, *payload), position)).scalar()
    joined = events.join(contexts, position, "left")
    past = F.col(position) > last[position]
    return joined.select(*events.columns, *[F.when(past, last[c]).otherwise(F.col(c)).alias(c) for c in payload])
