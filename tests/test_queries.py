"""Registered queries next to DuckDB on the smallest tables, and a look at their plans."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

# The rest are run by ``python -m tests.oracle``; these cover each kind of query in little time.
CHECKED = (
    "src1_typed_scan", "src3_jobs_payload", "src4_builds_payload", "src6_blob_lines", "src9_request_contract",
    "ag1_analytics_summary", "ag4_accuracy_trend", "ag5_anomaly_rate_trend", "ag6_alert_effectiveness", "ag8_job_comparison",
    "ag20_classification_report", "ag21_hourly_failures", "crv1_roc_auc", "crv2_precision_recall",
    "win1_seconds_since_previous", "win7_stratified_split", "win9_escalation", "fea1_structured_features", "fea3_tfidf",
    "seq1_encode_builds", "pip1_score_logs", "pip2_sync_builds", "snk3_upsert_builds",
)


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", CHECKED)
def test_equals_duckdb(spark, duck, sf, name):
    assert compare(name, spark, duck, sf, entry.queries()[name], entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", CHECKED)
def test_plan_has_no_product_join(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns and out.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
