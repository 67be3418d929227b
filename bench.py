"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
Each query is run once to warm up and then timed BENCH_RUNS times (default once); the best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from buildlark.plans import QUERIES

HEADLINE = (
    "fn4_mask", "fn13_tfidf_text", "fn28_keyword_verdict",
    "src6_blob_lines", "src4_builds_payload",
    "ag1_analytics_summary", "ag4_accuracy_trend", "ag5_anomaly_rate_trend", "ag6_alert_effectiveness",
    "ag8_job_comparison", "ag9_build_overview", "ag16_token_vocabulary", "ag20_classification_report",
    "ag21_hourly_failures",
    "win1_seconds_since_previous", "win4_event_numbers", "win7_stratified_split", "win9_escalation",
    "jn7_alerts_with_predictions", "tk1_newest_predictions", "tk4_build_history", "tk9_top_terms",
    "crv1_roc_points", "crv1_roc_auc", "crv2_precision_recall",
    "min1_mine_templates", "min1_mine_templates_unstamped", "min3_assign_templates",
    "fea1_structured_features", "fea3_tfidf", "seq1_encode_builds", "fc1_forecast",
    "pip1_score_logs", "pip2_sync_builds", "snk3_upsert_builds", "st1_follow_builds",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("buildlark-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        runs = []
        for _ in range(1 + int(os.environ.get("BENCH_RUNS", "1"))):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs[1:] or runs), 3)
        print(f"{name} {runs}", file=sys.stderr, flush=True)
    out = {
        "metric": "warm time, summed over the headline queries",
        "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }
    if "min1_mine_templates" in times:
        lines = spark.read.parquet(f"{sf}/events.parquet").count()
        out["mining_lines_per_sec"] = round(lines / times["min1_mine_templates"])
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
