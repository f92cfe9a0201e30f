"""Model queries. Seeded training has no SQL counterpart, so the queries that train are checked by tests on
planted anomalies and by row counts; those of a given model have SQL that walks its trees and multiplies its layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational_models as R
from ..operators import scoring
from ..operators.features import extract_features
from ..operators.training import benign_only, flow_features, seeded_sample
from ..schema import FEATURES
from ..session import reliable, shared_dir
from .detection import anomalies, contexts, triaged_clusters
from .detection_queries import usable_rules
from .driver_tables import activity, security_events
from .raw_lines import flow_rows
from .reference_sql import NINE


def trained_on_events(spark, features, sample: int | None = None):
    """Models of all rows of ``features``, or of a seeded sample of so many."""
    path = shared_dir(spark, "model")
    scoring.train(features if sample is None else seeded_sample(features, sample, key="id"), path)
    return scoring.load(spark, path)


def event_scores(spark, sf):
    """Train on the features of all events, then score them."""
    features = reliable(extract_features(security_events(spark, sf)), "features")
    scored = scoring.score(features, trained_on_events(spark, features))
    return scored.select(F.col("id").cast("bigint").alias("event_id"), "anomaly_score",
                         F.transform("top_features", lambda f: f["name"]).alias("top_features"))


def flow_scores(spark, sf):
    """Train on all benign flows, flag outliers among all flows by the 1 % quantile of all benign ones."""
    flows = flow_rows(activity(spark, sf))
    features = reliable(flow_features(flows).withColumnRenamed("line_id", "id"), "flows")
    benign = benign_only(features)
    path = shared_dir(spark, "flow-model")
    scoring.train(benign, path)
    model = scoring.load(spark, path)
    limit = scoring.contamination_threshold(scoring.score(benign, model))
    scored = scoring.with_outlier_flag(scoring.score(features, model), limit)
    return scored.select(F.col("id").cast("bigint").alias("event_id"), F.trim("Label").alias("label"),
                         "anomaly_score", F.col("is_outlier").cast("int").alias("is_outlier"))


def error_percentiles(spark, sf):
    features = reliable(extract_features(security_events(spark, sf)), "features")
    scored = scoring.score(features, trained_on_events(spark, features))
    grid = scoring.benign_error_grid(scored)
    return scored.select(F.col("id").cast("bigint").alias("event_id"), scoring.error_percentile(grid).alias("percentile"))


def scored_triage(spark, sf):
    """Features, model scores, clusters, rules and triage over all events."""
    rows = reliable(contexts(security_events(spark, sf)), "contexts")
    scored = scoring.score(rows, trained_on_events(spark, rows))
    return triaged_clusters(anomalies(scored), usable_rules(spark)).select(
        "entity", "cluster_size", "max_score", "technique_id", "tactic", "severity", "confidence", "rationale")


def given_scores(spark, sf):
    """Features of all events scored by the given model, by joins and array expressions."""
    features = reliable(extract_features(security_events(spark, sf)), "features")
    nodes = spark.createDataFrame(R.given_nodes(), R.NODES)
    return R.score_relationally(features, nodes, R.given_weights(), dict(zip(FEATURES, R.GIVEN_MAXIMA)))


def given_forest(spark, sf):
    return given_scores(spark, sf).select(F.col("id").cast("bigint").alias("event_id"), F.round("forest_raw", 8).alias("forest_raw"))


def given_reconstruction(spark, sf):
    errors = F.transform("recon_errors", lambda e: F.round(e, 6))
    return given_scores(spark, sf).select(F.col("id").cast("bigint").alias("event_id"), F.round("recon_error", 6).alias("recon_error"),
                                          F.element_at(errors, 1).alias("first_error"), F.element_at(errors, 9).alias("last_error"))


def given_ensemble(spark, sf):
    """The same by the Arrow pass over the model's arrays."""
    features = reliable(extract_features(security_events(spark, sf)), "features")
    scored = scoring.score(features, R.given_model(spark))
    return scored.select(F.col("id").cast("bigint").alias("event_id"), F.round("forest_raw", 8).alias("forest_raw"),
                         F.round("recon_error", 6).alias("recon_error"), F.round("anomaly_score", 3).alias("anomaly_score"))


QUERIES = {
    "forest_scores_given_model": given_forest,
    "reconstruction_given_model": given_reconstruction,
    "ensemble_given_model": given_ensemble,
    "model_event_scores": event_scores,
    "model_flow_outliers": flow_scores,
    "model_error_percentiles": error_percentiles,
    "model_scored_triage": scored_triage,
}

def _layer(number: int, fan_in: int, relu: bool) -> str:
    """Layer ``number`` from the one before it: products summed by output, weights by the given rule."""
    z = f"sum(v * (((i * 7 + j * 13 + {number} * 5) % 11 - 5) / 20.0::DOUBLE)) + ((j * 3 + {number}) % 7 - 3) / 50.0::DOUBLE"
    return f"""l{number + 1} AS (SELECT event_id, j AS i, {f'greatest({z}, 0)' if relu else z} AS v
      FROM l{number}, (SELECT unnest(range({fan_in})) AS j) GROUP BY event_id, j)"""


GIVEN = f"""{NINE},
x AS (SELECT event_id, [c1m / 8.0::DOUBLE, c5m / 40.0::DOUBLE, c1h / 400.0::DOUBLE, ratio, ports / 20.0::DOUBLE, ips / 20.0::DOUBLE,
    bytes / 9e9, tod / 4.0::DOUBLE, vel / 4e7] AS x FROM nine),
nodes AS (SELECT tree, node, floor(log2(node + 1))::INT AS depth, (tree * 5 + node * 3) % 9 AS feature,
    pow(((tree * 7 + node * 11) % 17 + 1) / 18.0::DOUBLE, 2) AS threshold, 1 + (tree + node) % 40 AS size
  FROM (SELECT unnest(range(20)) AS tree), (SELECT unnest(range(31)) AS node)),
walk AS (
  SELECT event_id, x, tree, 0 AS node, 0 AS level FROM x, (SELECT unnest(range(20)) AS tree)
  UNION ALL
  SELECT event_id, x, w.tree, 2 * w.node + CASE WHEN x[feature + 1] <= threshold THEN 1 ELSE 2 END, level + 1
  FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE level < 4),
forest AS (
  SELECT event_id, pow(2, -avg(depth + CASE WHEN size > 2 THEN 2 * (ln(size - 1) + 0.5772156649015329) - 2 * (size - 1) / size::DOUBLE
      WHEN size = 2 THEN 1 ELSE 0 END) / (2 * (ln(255) + 0.5772156649015329) - 2 * 255 / 256.0::DOUBLE)) AS forest_raw
  FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE level = 4 GROUP BY event_id),
l0 AS (SELECT event_id, unnest(range(9)) AS i, unnest(x) AS v FROM x),
{_layer(0, 32, True)}, {_layer(1, 16, True)}, {_layer(2, 8, False)}, {_layer(3, 16, True)}, {_layer(4, 32, True)}, {_layer(5, 9, False)},
errors AS (
  SELECT event_id, list(pow(l6.v - l0.v, 2) ORDER BY i) AS e, avg(pow(l6.v - l0.v, 2)) AS recon_error
  FROM l6 JOIN l0 USING (event_id, i) GROUP BY event_id),
scored AS (
  SELECT event_id, forest_raw, recon_error, e,
    0.6 * greatest(least((forest_raw + 0.5) / 1.5, 1), 0) + 0.4 * greatest(least(recon_error / 0.5, 1), 0) AS blended
  FROM forest JOIN errors USING (event_id))"""
GIVEN = GIVEN.replace("WITH ", "WITH RECURSIVE ", 1)

ORACLES: dict[str, str] = {
    "forest_scores_given_model": f"{GIVEN} SELECT event_id, round(forest_raw, 8) AS forest_raw FROM scored",
    "reconstruction_given_model": f"""{GIVEN} SELECT event_id, round(recon_error, 6) AS recon_error, round(e[1], 6) AS first_error,
        round(e[9], 6) AS last_error FROM scored""",
    "ensemble_given_model": f"""{GIVEN} SELECT event_id, round(forest_raw, 8) AS forest_raw, round(recon_error, 6) AS recon_error,
        round(CAST(printf('%.4f', blended) AS DOUBLE), 3) AS anomaly_score FROM scored""",
}
