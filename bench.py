"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "normalize_syslog", "normalize_auth_log", "normalize_cloudtrail", "normalize_network_flow",
    "feature_vector", "rule_matches", "clusters_by_technique", "triage_clusters", "incidents_created",
    "ledger_chain", "status_change_ledger", "incident_details", "kpi_row", "technique_matrix",
    "incident_sessions", "score_history", "address_lookup", "ioc_validation", "graph_edge_counts",
    "roc_auc", "precision_recall_curve", "model_event_scores", "stream_feature_vector",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from watchfold.plans import catalog
    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    queries["kpi_row"](spark, sf_dir).collect()  # starts the session before the clock
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else None}))


if __name__ == "__main__":
    main()
