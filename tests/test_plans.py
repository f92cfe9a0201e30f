"""Physical plans: no cartesian product, filters reach the scan, no Python in the native operators,
and no window that gathers raw rows in one partition."""

import io
import re
from contextlib import redirect_stdout

import pytest

from watchfold.plans import catalog


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


NATIVE = ["feature_vector", "rule_matches", "clusters_by_technique", "triage_clusters", "normalize_syslog", "normalize_network_flow",
          "incident_details", "kpi_row", "technique_matrix", "incident_sessions", "score_history", "address_lookup", "ioc_validation",
          "graph_edge_counts", "roc_auc", "precision_recall_curve", "ledger_verified"]


@pytest.mark.parametrize("name", NATIVE)
def test_plan(name, spark, sf):
    text = plan(catalog.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if not name.startswith("ledger"):
        assert not re.search(r"EvalPython|InPandas|InArrow|PythonUDF", text)


def test_features_shuffle_events_twice(spark, sf):
    """Once by second for the global rank, once by (entity, slot) for all entity features."""
    text = plan(catalog.queries()["feature_vector"](spark, sf))
    wide = re.findall(r"Input \[\d+\]: \[([^\]]*)\]\nArguments: hashpartitioning", text)
    assert sum("nbytes" in w for w in wide) == 2


def test_single_partition_windows_are_over_hours_only(spark, sf):
    text = plan(catalog.queries()["feature_vector"](spark, sf))
    inputs = re.findall(r"Input \[\d+\]: \[([^\]]*)\]\nArguments: SinglePartition", text)
    assert inputs and all("hour" in i and "us#" not in i for i in inputs)


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(catalog.queries()["technique_parents"](spark, sf))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"o_custkey"}
    by_day = plan(catalog.queries()["event_history_by_day"](spark, sf))
    assert re.search(r"PartitionFilters: \[[^\]]*event_date", by_day)
