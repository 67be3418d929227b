"""Queries for scans, payloads, projections, filters, joins, roll-ups, windows and top-k reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buildlark import schemas
from buildlark.functions import logtext, scoring, times
from buildlark.operators import builds as B
from buildlark.operators import metrics as M
from buildlark.operators import ordering
from buildlark.operators import rollups as R
from buildlark.operators.training_run import join_cv
from buildlark.plans import views
from buildlark.plans.registry import query
from buildlark.plans.views import AS_OF, with_views
from buildlark.sources import payloads
from buildlark.sources import tables as T

# The trend of orders looks back from the day after the last one.
ORDERS_AS_OF = "2001-08-02 00:00:00"

# Non-blank lines as DuckDB sees them: the same line breaks and the same white space.
_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPLIT = r"regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
_LINES = f"list_filter({_SPLIT}, lambda x: regexp_matches(x, '[^{_WS}]'))"


# --- sources -----------------------------------------------------------------
@query("src1_typed_scan", """
SELECT event_id, epoch_us(ts) AS epoch, user_id, event_type, value, props FROM events""")
def typed_scan(spark, sf):
    ddl = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    e = T.scan(spark, f"{sf}/events.parquet", ddl)
    return e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("epoch"),
                    "user_id", "event_type", "value", "props")


@query("src2_recent_documents", """
SELECT event_id, epoch_us(ts) AS epoch, event_type FROM events ORDER BY ts DESC, event_id LIMIT 1000""")
def recent_documents(spark, sf):
    e = T.recent(views.table(spark, sf, "events"), "ts", 1000, "event_id")
    return e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("epoch"), "event_type")


@query("src3_jobs_payload", """
SELECT c_name AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'notbuilt' ELSE c_mktsegment END AS color,
  CASE WHEN c_acctbal > 0 THEN c_custkey END AS last_build_number,
  CASE WHEN c_acctbal > 0 THEN 'SUCCESS' END AS last_build_result, false AS demo FROM customer
UNION ALL
SELECT c_name || '-nightly', 'blue', c_custkey + 1, NULL, false FROM customer""")
def jobs_payload(spark, sf):
    """Two jobs per customer, landed as JSON and read back."""
    c = views.table(spark, sf, "customer")
    last = F.struct(F.col("c_custkey").alias("number"), F.lit("SUCCESS").alias("result"))
    nightly = F.struct((F.col("c_custkey") + 1).alias("number"), F.lit(None).cast("string").alias("result"))
    jobs = F.array(
        F.struct(
            F.col("c_name").alias("name"),
            F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("color"),
            F.when(F.col("c_acctbal") > 0, last).alias("lastBuild"),
        ),
        F.struct(
            F.concat("c_name", F.lit("-nightly")).alias("name"), F.lit("blue").alias("color"),
            nightly.alias("lastBuild"),
        ),
    )
    return payloads.jobs(c.select(F.to_json(F.struct(jobs.alias("jobs"))).alias("body")))


@query("src4_builds_payload", """
SELECT o_orderpriority AS job_name, o_orderkey * 3 + k AS build_number,
  CASE k WHEN 0 THEN 'FAILURE' ELSE 'IN_PROGRESS' END AS status,
  CASE k WHEN 0 THEN cast(floor(o_totalprice) AS bigint) ELSE 0 END AS duration_ms,
  epoch_us(o_orderdate) AS epoch, CASE k WHEN 0 THEN 'u/' || o_orderkey ELSE '' END AS url, false AS demo
FROM orders, (SELECT unnest([0, 1]) AS k)""")
def builds_payload(spark, sf):
    """Three builds per order, landed as JSON and read back with the first two kept."""
    o = views.table(spark, sf, "orders")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    key = F.col("o_orderkey")
    null = lambda t: F.lit(None).cast(t)

    def one(k, result, duration, url):
        return F.struct(
            (key * 3 + k).alias("number"), result.alias("result"), ms.alias("timestamp"),
            duration.alias("duration"), url.alias("url"),
        )

    took = F.floor("o_totalprice").cast("bigint")
    body = F.to_json(F.struct(
        F.col("o_orderpriority").alias("job_name"),
        F.array(
            one(0, F.lit("FAILURE"), took, F.concat(F.lit("u/"), key.cast("string"))),
            one(1, F.lit(""), null("bigint"), null("string")),
            one(2, null("string"), took, null("string")),
        ).alias("builds"),
    ))
    out = payloads.builds(o.select(body.alias("body")), count=2)
    return out.withColumn("epoch", F.unix_micros("build_timestamp")).drop("build_timestamp")


@query("src5_console_tail", "SELECT doc_id, md5(right(text, 2048)) AS log FROM documents")
def console_tail(spark, sf):
    logs = views.table(spark, sf, "documents").select("doc_id", F.col("text").alias("log"))
    return payloads.console_tail(logs).withColumn("log", F.md5("log"))


@query("src6_blob_lines", f"""
SELECT doc_id, cast(unnest(range(0, len(l))) AS integer) AS pos, md5(unnest(l)) AS line FROM (
  SELECT doc_id, CASE WHEN len({_LINES}) > 0 THEN {_LINES}
    ELSE [regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g')] END AS l FROM documents)""")
def blob_lines(spark, sf):
    d = views.documents(spark, sf)
    return payloads.blob_lines(d, "text", "doc_id").withColumn("line", F.md5("line"))


@query("src7_first_line", f"""
SELECT doc_id, md5(CASE WHEN len({_LINES}) > 0 THEN {_LINES}[1]
  ELSE regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g') END) AS line FROM documents""")
def first_line(spark, sf):
    return views.documents(spark, sf).select(
        "doc_id", F.md5(logtext.first_line(F.col("text"))).alias("line")
    )


@query("src9_request_contract", """
SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE 'user-' || user_id END AS pipeline_id,
  event_type NOT IN ('error', 'signup') AS is_valid FROM events""")
def request_contract(spark, sf):
    """Scoring requests checked against their contract: errors are cut JSON, sign-ups lack the id."""
    e = views.table(spark, sf, "events")
    user = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    good = F.to_json(F.struct(user.alias("pipeline_id"), F.col("props").alias("logs")))
    body = (
        F.when(F.col("event_type") == "error", F.lit('{"pipeline_id": '))
        .when(F.col("event_type") == "signup", F.to_json(F.struct(F.col("props").alias("logs"))))
        .otherwise(good)
    )
    checked = payloads.validate(
        e.select("event_id", body.alias("body")), "body", schemas.CONTRACTS["prediction_request"]
    )
    return checked.select("event_id", F.col("record.pipeline_id").alias("pipeline_id"), "is_valid")


# --- projections and filters ---------------------------------------------------
@query("prj1_prediction_history", with_views("""
SELECT id, pipeline_id, risk_level, anomaly_score, predicted_failures, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at
FROM predictions"""))
def prediction_history(spark, sf):
    return B.as_document(views.predictions(spark, sf).select(
        "id", "pipeline_id", "risk_level", "anomaly_score", "predicted_failures", "created_at"
    ))


@query("prj2_alert_document", with_views("""
SELECT cast(prediction_id AS varchar) AS _id, line, to_json({'timestamp': strftime(created_at, '%Y-%m-%dT%H:%M:%S'),
  'severity': severity, 'alert_type': alert_type, 'is_resolved': is_resolved}) :: varchar AS _source FROM alerts"""))
def alert_document(spark, sf):
    source = F.struct(
        times.iso(F.col("created_at")).alias("timestamp"), "severity", "alert_type", "is_resolved"
    )
    return views.alerts(spark, sf).select(
        F.col("prediction_id").cast("string").alias("_id"), "line", F.to_json(source).alias("_source")
    )


_JUDGED = "SELECT job_name, build_number, status, duration_ms, predicted_failure, actual_failure, prediction_correct"


@query("prj3_build_rows", with_views(_JUDGED + """,
  strftime(build_timestamp, '%Y-%m-%dT%H:%M:%S') AS build_timestamp FROM judged_builds"""))
def build_rows(spark, sf):
    return B.as_document(B.judged(views.builds(spark, sf)))


@query("prj4_actual_failure", with_views("SELECT build_number, status, actual_failure FROM judged_builds"))
def actual_failure(spark, sf):
    return views.builds(spark, sf).select(
        "build_number", "status", B.actual_failure(F.col("status")).alias("actual_failure")
    )


@query("prj5_prediction_correct", with_views("SELECT build_number, prediction_correct FROM judged_builds"))
def prediction_correct(spark, sf):
    held = B.prediction_correct(F.col("status"), F.col("predicted_failure"))
    return views.builds(spark, sf).select("build_number", held.alias("prediction_correct"))


@query("prj6_default_log", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'Build log from job-' || (user_id % 5) ELSE props END AS logs FROM events""")
def default_log(spark, sf):
    """Requests without a log (views) get the default text."""
    e = views.table(spark, sf, "events")
    job = F.concat(F.lit("job-"), (F.col("user_id") % 5).cast("string"))
    given = F.when(F.col("event_type") != "view", F.col("props"))
    default = F.concat(F.lit("Build log from "), job)
    return e.select("event_id", F.when(F.coalesce(given, F.lit("")) == "", default).otherwise(given).alias("logs"))


@query("flt1_equality", with_views("""
SELECT prediction_id, line, alert_type FROM alerts WHERE is_resolved AND severity = 'WARNING'"""))
def equality(spark, sf):
    a = T.matching(views.alerts(spark, sf), is_resolved=True, severity="WARNING")
    return a.select("prediction_id", "line", "alert_type")


@query("flt2_last_days", f"""
SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""")
def last_days(spark, sf):
    return T.newer_than(views.table(spark, sf, "events"), "ts", views.as_of(), 7).select("event_id", "event_type")


@query("flt3_not_null_and_equal", with_views("""
SELECT prediction_id, line, created_at FROM alerts WHERE resolved_at IS NOT NULL AND severity = 'CRITICAL'"""))
def not_null_and_equal(spark, sf):
    a = views.alerts(spark, sf).where("resolved_at IS NOT NULL")
    return T.matching(a, severity="CRITICAL").select("prediction_id", "line", "created_at")


@query("flt4_optional_job", with_views("""
SELECT 'all' AS asked, build_number FROM builds UNION ALL SELECT '1-URGENT', build_number FROM builds WHERE job_name = '1-URGENT'"""))
def optional_job(spark, sf):
    b = views.builds(spark, sf)
    everything = T.matching(b, job_name=None).select(F.lit("all").alias("asked"), "build_number")
    one = T.matching(b, job_name="1-URGENT").select(F.lit("1-URGENT").alias("asked"), "build_number")
    return everything.unionByName(one)


@query("flt5_point_lookup", with_views("SELECT id, pipeline_id, risk_level FROM predictions WHERE id = 77"))
def point_lookup(spark, sf):
    return T.point_lookup(views.predictions(spark, sf), "id", 77).select("id", "pipeline_id", "risk_level")


@query("flt6_non_negative", """
SELECT c_custkey, cast(trunc(c_acctbal) AS integer) AS failures FROM customer WHERE c_acctbal >= 0""")
def non_negative(spark, sf):
    from buildlark.operators.forecast import clean_series

    c = views.table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("failures"))
    return clean_series(c, "failures")


@query("flt7_minimum_samples", with_views("""
SELECT job_name, build_number FROM builds WHERE job_name || status IN
  (SELECT job_name || status FROM builds GROUP BY job_name, status HAVING count(*) >= 50)"""))
def minimum_samples(spark, sf):
    return M.enough(views.builds(spark, sf), ["job_name", "status"], 50).select("job_name", "build_number")


# --- joins ---------------------------------------------------------------------
@query("jn1_cv_onto_test", with_views("""
SELECT t.training_run, t.model_name, t.f1_score, c.cv_f1 FROM
  (SELECT training_run, model_name, max(f1_score) AS f1_score FROM model_runs GROUP BY ALL) t LEFT JOIN
  (SELECT training_run, model_name, min(f1_score) AS cv_f1 FROM model_runs WHERE f1_score > 0.5 GROUP BY ALL) c
  USING (training_run, model_name)"""))
def cv_onto_test(spark, sf):
    """Held-out figures with the cross-validation figures where there are any."""
    runs = views.model_runs(spark, sf)
    test = runs.groupBy("training_run", "model_name").agg(F.max("f1_score").alias("f1_score"))
    cv = runs.where("f1_score > 0.5").groupBy("training_run", "model_name").agg(F.min("f1_score").alias("cv_f1"))
    return join_cv(test, cv, ("training_run", "model_name"))


@query("jn5_upsert_keys", with_views("""
SELECT job_name, build_number FROM builds WHERE status <> 'IN_PROGRESS' AND NOT EXISTS (
  SELECT 1 FROM alerts a WHERE a.prediction_id = builds.build_number)"""))
def upsert_keys(spark, sf):
    """Finished builds for which no alert row is stored yet."""
    stored = views.alerts(spark, sf).select(F.col("prediction_id").alias("build_number"))
    fresh = views.builds(spark, sf).where("status <> 'IN_PROGRESS'")
    return fresh.join(stored, "build_number", "left_anti").select("job_name", "build_number")


@query("jn5_two_key_lookup", with_views("""
SELECT job_name, build_number, build_number % 2 = 0 AS stored FROM builds WHERE status <> 'IN_PROGRESS'"""))
def two_key_lookup(spark, sf):
    """Which finished builds are stored by job and number; every number is also stored under another job."""
    every = views.builds(spark, sf)
    number = F.col("build_number")
    stored = every.where(number % 2 == 0).select("job_name", "build_number").unionByName(
        every.select(F.concat(F.lit("other-"), "job_name").alias("job_name"), "build_number"))
    known = stored.distinct().withColumn("stored", F.lit(True))
    fresh = every.where("status <> 'IN_PROGRESS'").select("job_name", "build_number")
    return fresh.join(known, ["job_name", "build_number"], "left").select("job_name", "build_number", F.coalesce("stored", F.lit(False)).alias("stored"))


@query("jn7_alerts_with_predictions", with_views("""
SELECT a.prediction_id, a.line, a.severity, p.risk_level, p.confidence FROM alerts a LEFT JOIN predictions p ON a.prediction_id = p.id"""))
def alerts_with_predictions(spark, sf):
    p = views.predictions(spark, sf).select(F.col("id").alias("prediction_id"), "risk_level", "confidence")
    a = views.alerts(spark, sf).select("prediction_id", "line", "severity")
    return a.join(p, "prediction_id", "left")


@query("jn8_latest_run", with_views("""
SELECT created_seq, training_run, model_name FROM model_runs WHERE training_run = (SELECT arg_max(training_run, created_seq) FROM model_runs)"""))
def latest_run(spark, sf):
    return R.latest_run(views.model_runs(spark, sf)).select("created_seq", "training_run", "model_name")


# --- aggregations ----------------------------------------------------------------
@query("ag1_analytics_summary", with_views("""
SELECT p.*, p.total_anomalies / greatest(p.total_predictions, 1) * 100 AS anomaly_rate, a.*, m.*
FROM (SELECT count(*) AS total_predictions, count_if(is_anomaly) :: bigint AS total_anomalies FROM predictions) p,
  (SELECT count(*) AS total_alerts FROM alerts) a,
  (SELECT accuracy AS model_accuracy, f1_score AS model_f1, test_samples FROM model_metrics ORDER BY created_at DESC LIMIT 1) m"""))
def analytics_summary(spark, sf):
    return R.analytics_summary(
        views.predictions(spark, sf), views.alerts(spark, sf), views.model_metrics(spark, sf)
    )


@query("ag2_dashboard", with_views("""
SELECT count_if(created_at >= TIMESTAMP '1998-12-01' - INTERVAL 7 DAY) :: bigint AS total_alerts,
  count_if(severity = 'CRITICAL' AND NOT is_resolved) :: bigint AS critical_issues,
  (SELECT arg_max(accuracy, created_at) FROM model_metrics) AS model_accuracy FROM alerts"""))
def dashboard(spark, sf):
    as_of = F.lit("1998-12-01 00:00:00").cast("timestamp_ntz")
    return R.dashboard(views.alerts(spark, sf), views.model_metrics(spark, sf), as_of)


@query("ag3_weekday_trend", with_views(f"""
SELECT cast(d.day_no AS integer) AS day_no, d.date, coalesce(c.n, 0) :: bigint AS count
FROM (SELECT unnest(range(7)) AS day_no, unnest(['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun']) AS date) d
LEFT JOIN (SELECT strftime(created_at, '%a') AS date, count_if(is_anomaly) AS n FROM predictions
           WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1) c USING (date)"""))
def weekday_trend(spark, sf):
    return R.weekday_trend(views.predictions(spark, sf), views.as_of())


@query("ag4_accuracy_trend", with_views(f"""
SELECT day, accuracy, accuracy * 1.05e0 AS precision_ref, accuracy * 0.95e0 AS recall_ref,
  coalesce(tp / nullif(tp + fp, 0), 0.0e0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0e0) AS recall,
  total_predictions, correct_predictions
FROM (SELECT *, cast(correct_predictions AS double) / total_predictions AS accuracy FROM (
  SELECT strftime(predicted_at, '%Y-%m-%d') AS day, count(*) AS total_predictions,
    count(*) FILTER (predicted_anomaly = actual_anomaly) AS correct_predictions,
    cast(count(*) FILTER (predicted_anomaly AND actual_anomaly) AS double) AS tp,
    cast(count(*) FILTER (predicted_anomaly AND NOT actual_anomaly) AS double) AS fp,
    cast(count(*) FILTER (NOT predicted_anomaly AND actual_anomaly) AS double) AS fn
  FROM prediction_analytics WHERE predicted_at >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 30 DAY GROUP BY 1))"""))
def accuracy_trend(spark, sf):
    return R.accuracy_trend(views.prediction_analytics(spark, sf), F.lit(ORDERS_AS_OF).cast("timestamp_ntz"))


@query("ag5_anomaly_rate_trend", with_views(f"""
SELECT day, total_predictions, anomalies_detected, anomalies_detected / total_predictions * 100 AS anomaly_rate
FROM (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS total_predictions,
  count_if(is_anomaly) :: bigint AS anomalies_detected FROM predictions
  WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1)"""))
def anomaly_rate_trend(spark, sf):
    return R.anomaly_rate_trend(views.predictions(spark, sf), views.as_of())


@query("ag6_alert_effectiveness", with_views("""
SELECT total_alerts, resolved_alerts, critical_alerts,
  cast(resolved_alerts AS double) / total_alerts * 100 AS resolution_rate,
  cast(micros AS double) / (timed * 3600000000.0e0) AS avg_resolution_time_hours, anomaly_alerts, forecast_alerts
FROM (SELECT count(*) AS total_alerts, count_if(is_resolved) :: bigint AS resolved_alerts,
  count_if(severity = 'CRITICAL') :: bigint AS critical_alerts,
  sum(epoch_us(resolved_at) - epoch_us(created_at)) AS micros, count(resolved_at) AS timed,
  count_if(alert_type = 'ANOMALY') :: bigint AS anomaly_alerts,
  count_if(alert_type = 'FORECAST') :: bigint AS forecast_alerts FROM alerts)"""))
def alert_effectiveness(spark, sf):
    return R.alert_effectiveness(views.alerts(spark, sf))


@query("ag7_system_health", with_views("""
SELECT successful_predictions, failed_predictions, avg_prediction_time_ms,
  coalesce(successful_predictions / nullif(successful_predictions + failed_predictions, 0), 0.0e0) * 100 AS success_rate
FROM (SELECT * FROM system_metrics ORDER BY created_at DESC LIMIT 1)"""))
def system_health(spark, sf):
    return R.system_health(views.system_metrics(spark, sf))


_COUNTS = """count(*) AS total_builds, count_if(actual_failure) :: bigint AS actual_failures,
  count_if(predicted_failure) :: bigint AS predicted_failures,
  count_if(prediction_correct) :: bigint AS correct_predictions"""


@query("ag8_job_comparison", with_views(f"""
SELECT *, round(cast(correct_predictions AS double) / total_builds, 3) AS accuracy FROM (
  SELECT job_name, {_COUNTS}, count_if(predicted_failure AND NOT actual_failure) :: bigint AS false_positives,
    count_if(NOT predicted_failure AND actual_failure) :: bigint AS false_negatives
  FROM judged_builds WHERE status <> 'IN_PROGRESS' GROUP BY job_name)"""))
def job_comparison(spark, sf):
    return B.comparison(B.judged(views.builds(spark, sf)))


@query("ag9_build_overview", with_views(f"""
SELECT *, round(cast(correct_predictions AS double) / total_builds, 3) AS overall_accuracy FROM (
  SELECT {_COUNTS}, count_if(duration_ms > 400000) :: bigint AS high_risk_builds FROM judged_builds)"""))
def build_overview(spark, sf):
    b = B.judged(views.builds(spark, sf))
    return B.overview(b.withColumn("risk_level", F.when(F.col("duration_ms") > 400000, "HIGH")))


@query("ag10_severity_counts", with_views("""
SELECT count_if(severity = 'CRITICAL') :: bigint AS critical, count_if(severity = 'WARNING') :: bigint AS warning,
  count_if(severity = 'INFO') :: bigint AS info FROM alerts"""))
def severity_counts(spark, sf):
    return R.severity_counts(views.alerts(spark, sf))


@query("ag11_class_balance", with_views("""
SELECT is_anomaly, n, 100.0e0 * n / sum(n) OVER () AS percent FROM (
  SELECT is_anomaly, count(*) AS n FROM labelled_lines GROUP BY 1)"""))
def class_balance(spark, sf):
    return R.class_balance(views.labelled_lines(spark, sf)).drop("class_weight")


# Key and time column of each table.
_INVENTORY = {
    "events": ("event_id", "ts"), "orders": ("o_orderkey", "o_orderdate"), "lineitem": ("l_orderkey", "l_shipdate"),
    "documents": ("doc_id", None), "conversations": ("conv_id", None),
}


def _stamps_as_text(ts: str | None) -> str:
    return f"* REPLACE (strftime({ts}, '%Y-%m-%d %H:%M:%S') AS {ts})" if ts else "*"


@query("ag12_table_inventory", "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, cast(min({k}) AS varchar) AS sample_key, "
    f"(SELECT min(cast(to_json(r) AS varchar)) FROM (SELECT {_stamps_as_text(ts)} FROM {t} "
    f"WHERE {k} = (SELECT min({k}) FROM {t})) r) AS sample_row FROM {t}"
    for t, (k, ts) in _INVENTORY.items()))
def table_inventory(spark, sf):
    def shown(t, ts):
        table = views.table(spark, sf, t)
        return table.withColumn(ts, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")) if ts else table

    return R.table_inventory({t: (shown(t, ts), k) for t, (k, ts) in _INVENTORY.items()})


@query("ag15_top_services", with_views(r"""
SELECT service, count(*) AS n, min(event_id) AS first_pos FROM (
  SELECT event_id, coalesce(nullif(regexp_extract(raw, '\[([A-Za-z][\w\-\.]{1,63})\]', 1), ''), '__NONE__') AS service
  FROM event_logs) GROUP BY 1 ORDER BY n DESC, first_pos LIMIT 32"""))
def top_services(spark, sf):
    lines = views.event_logs(spark, sf).select(
        F.col("event_id").alias("pos"), logtext.service(F.col("raw")).alias("service")
    )
    return R.top_services(lines, "service")


_CELLS = """count_if(actual_failure AND predicted_failure) :: bigint AS tp,
  count_if(NOT actual_failure AND NOT predicted_failure) :: bigint AS tn,
  count_if(NOT actual_failure AND predicted_failure) :: bigint AS fp,
  count_if(actual_failure AND NOT predicted_failure) :: bigint AS fn"""
_SCORES = """*, cast(tp + tn AS double) / (tp + tn + fp + fn) AS accuracy,
  coalesce(tp / nullif(tp + fp, 0), 0.0e0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0e0) AS recall"""
_F1 = """CASE WHEN precision + recall = 0 THEN 0.0e0 ELSE 2.0e0 * precision * recall / (precision + recall) END"""


def _verdicts(spark, sf) -> DataFrame:
    """Finished and running builds with label and prediction as 0/1."""
    return B.judged(views.builds(spark, sf)).select(
        "job_name", "build_number",
        F.col("actual_failure").cast("int").alias("label"),
        F.col("predicted_failure").cast("int").alias("prediction"),
    )


@query("ag17_confusion", with_views(f"""
SELECT *, coalesce(tp / nullif(tp + fn, 0), 0.0e0) AS tpr, coalesce(fp / nullif(fp + tn, 0), 0.0e0) AS fpr,
  coalesce(tn / nullif(tn + fp, 0), 0.0e0) AS specificity
FROM (SELECT job_name, {_CELLS} FROM judged_builds GROUP BY job_name)"""))
def confusion(spark, sf):
    return M.confusion(_verdicts(spark, sf), "label", "prediction", ["job_name"])


@query("ag17_confusion_of_latest_metrics", with_views("""
SELECT tp, tn, fp, fn, coalesce(tp / nullif(tp + fn, 0), 0.0e0) AS tpr, coalesce(fp / nullif(fp + tn, 0), 0.0e0) AS fpr,
  coalesce(tn / nullif(tn + fp, 0), 0.0e0) AS specificity FROM (SELECT * FROM model_metrics ORDER BY created_at DESC LIMIT 1)"""))
def confusion_of_latest(spark, sf):
    return M.with_rates(T.latest_row(views.model_metrics(spark, sf), "created_at").select("tp", "tn", "fp", "fn"))


@query("ag18_classifier_scores", with_views(f"""
SELECT *, {_F1} AS f1_score FROM (SELECT {_SCORES} FROM (SELECT job_name, {_CELLS} FROM judged_builds GROUP BY job_name))"""))
def classifier_scores(spark, sf):
    return M.scores(_verdicts(spark, sf), "label", "prediction", ["job_name"])


@query("ag19_cv_summary", with_views(f"""
SELECT round(avg(f1_score), 9) AS cv_f1_mean, round(stddev_pop(f1_score), 9) AS cv_f1_std,
  round(avg(precision), 9) AS cv_precision_mean, round(avg(recall), 9) AS cv_recall_mean,
  round(avg(accuracy), 9) AS cv_accuracy_mean
FROM (SELECT *, {_F1} AS f1_score FROM (SELECT {_SCORES} FROM (
  SELECT build_number % 5 AS fold, {_CELLS} FROM judged_builds GROUP BY 1)))"""))
def cv_summary(spark, sf):
    folds = M.scores(_verdicts(spark, sf).withColumn("fold", F.col("build_number") % 5), "label", "prediction", ["fold"])
    out = M.cv_summary(folds)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("ag20_classification_report", with_views("""
WITH cells AS (SELECT cast(cast(actual_failure AS integer) AS varchar) AS y, cast(cast(predicted_failure AS integer) AS varchar) AS p FROM judged_builds),
classes AS (SELECT y AS class FROM cells UNION SELECT p FROM cells),
rep AS (SELECT class, (SELECT count(*) FROM cells WHERE y = class) AS support,
  (SELECT count(*) FROM cells WHERE p = class) AS predicted, (SELECT count(*) FROM cells WHERE y = class AND p = class) AS ok FROM classes),
pr AS (SELECT *, coalesce(ok / nullif(predicted, 0), 0.0e0) AS precision, coalesce(ok / nullif(support, 0), 0.0e0) AS recall FROM rep),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0e0 ELSE 2.0e0 * precision * recall / (precision + recall) END AS f1_score FROM pr)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1_score, 9) AS f1_score, support FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1_score), 9), sum(support) :: bigint FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
  round(sum(f1_score * support) / sum(support), 9), sum(support) :: bigint FROM f
UNION ALL SELECT 'accuracy', round(sum(ok) / sum(support), 9), round(sum(ok) / sum(support), 9), round(sum(ok) / sum(support), 9), sum(support) :: bigint FROM f"""))
def classification_report(spark, sf):
    out = M.classification_report(_verdicts(spark, sf), "label", "prediction")
    return out.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1_score")], "support")


_HOURLY = """
  SELECT s.job, s.hour, coalesce(c.n, 0) :: bigint AS failures FROM
    (SELECT job, unnest(generate_series(min(date_trunc('hour', created_at)), max(date_trunc('hour', created_at)), INTERVAL 1 HOUR)) AS hour
     FROM (SELECT pipeline_id AS job, created_at FROM predictions) GROUP BY job) s
  LEFT JOIN (SELECT pipeline_id AS job, date_trunc('hour', created_at) AS hour, count_if(is_anomaly) AS n FROM predictions GROUP BY 1, 2) c
  USING (job, hour)"""


def _hourly(spark, sf) -> DataFrame:
    p = views.predictions(spark, sf).withColumnRenamed("pipeline_id", "job")
    return R.hourly_failures(p, "job", "created_at", F.col("is_anomaly"))


@query("ag21_hourly_failures", with_views(f"SELECT job, strftime(hour, '%Y-%m-%d %H') AS hour, failures FROM ({_HOURLY})"))
def hourly_failures(spark, sf):
    return _hourly(spark, sf).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query("ag23_job_count", with_views("SELECT job_name, count(*) AS n_builds, count(*) FILTER (status = 'IN_PROGRESS') AS n_running FROM builds GROUP BY 1"))
def job_count(spark, sf):
    return views.builds(spark, sf).groupBy("job_name").agg(
        F.count(F.lit(1)).alias("n_builds"), scoring.count_if(F.col("status") == "IN_PROGRESS").alias("n_running")
    )


@query("ag24_class_weights", with_views("""
SELECT is_anomaly, n, sum(n) OVER () / (count(*) OVER () * n) AS class_weight FROM (
  SELECT is_anomaly, count(*) AS n FROM labelled_lines GROUP BY 1)"""))
def class_weights(spark, sf):
    return R.class_balance(views.labelled_lines(spark, sf)).drop("percent")


# --- windows -------------------------------------------------------------------
@query("win1_seconds_since_previous", with_views("""
SELECT event_id, job, (epoch_us(t) - epoch_us(last_value(t IGNORE NULLS) OVER (PARTITION BY job ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) / 1000000.0e0 AS delta_sec
FROM (SELECT event_id, job, CASE WHEN event_id % 3 <> 0 THEN date_trunc('second', ts) END AS t FROM event_logs)"""))
def seconds_since_previous(spark, sf):
    """Every third line has lost its time stamp."""
    e = views.event_logs(spark, sf)
    line = F.when(F.col("event_id") % 3 == 0, F.col("msg")).otherwise(F.col("raw"))
    stamped = e.select("event_id", "job", logtext.timestamp(line).alias("t"))
    before = ordering.last_value_before(stamped, ["job"], "event_id", "t", "prev", chunk_rows=ordering.CHUNK_ROWS)
    return before.select("event_id", "job", times.seconds_between(F.col("t"), F.col("prev")).alias("delta_sec"))


@query("win2_latest_row", with_views("SELECT * FROM model_metrics ORDER BY created_at DESC LIMIT 1"))
def latest_row(spark, sf):
    return T.latest_row(views.model_metrics(spark, sf), "created_at")


@query("win3_best_of_run", with_views("""
SELECT training_run, created_seq, f1_score, f1_score >= max(f1_score) OVER (PARTITION BY training_run) AS is_best FROM model_runs"""))
def best_of_run(spark, sf):
    return R.best_of_run(views.model_runs(spark, sf)).select("training_run", "created_seq", "f1_score", "is_best")


@query("win7_stratified_split", with_views("""
SELECT id, is_anomaly, CASE WHEN (r - 1) % 5 = 0 THEN 'test' ELSE 'train' END AS part, cast((f - 1) % 5 AS integer) AS fold
FROM (SELECT id, is_anomaly, row_number() OVER (PARTITION BY is_anomaly ORDER BY md5('42|' || id), id) AS r,
  row_number() OVER (PARTITION BY is_anomaly ORDER BY md5('43|' || id), id) AS f FROM labelled_lines)"""))
def stratified_split(spark, sf):
    from buildlark.operators.models import stratified

    rows = views.labelled_lines(spark, sf).select("id", "is_anomaly")
    return stratified(stratified(rows, "is_anomaly", "id", 42, "r"), "is_anomaly", "id", 43, "fold").select(
        "id", "is_anomaly", F.when(F.col("r") == 0, "test").otherwise("train").alias("part"), "fold"
    )


@query("win8_first_differences", with_views(f"""
SELECT job, strftime(hour, '%Y-%m-%d %H') AS hour, failures - lag(failures) OVER (PARTITION BY job ORDER BY hour) AS diff FROM ({_HOURLY})"""))
def first_differences(spark, sf):
    # One row per hour and series by now, so a series is as long as its span in hours.
    w = Window.partitionBy("job").orderBy("hour")
    out = _hourly(spark, sf).withColumn("diff", F.col("failures") - F.lag("failures").over(w))
    return out.select("job", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "diff")


# --- top-k reports ----------------------------------------------------------------
@query("tk1_newest_predictions", with_views("""
SELECT id, pipeline_id, risk_level FROM predictions ORDER BY created_at DESC, id LIMIT 50"""))
def newest_predictions(spark, sf):
    return T.recent(views.predictions(spark, sf), "created_at", 50, "id").select("id", "pipeline_id", "risk_level")


@query("tk2_newest_alerts", with_views("""
SELECT prediction_id, line, severity, alert_type FROM alerts ORDER BY created_at DESC, prediction_id, line, alert_type, severity LIMIT 20"""))
def newest_alerts(spark, sf):
    a = T.recent(views.alerts(spark, sf), "created_at", 20, "prediction_id", "line", "alert_type", "severity")
    return a.select("prediction_id", "line", "severity", "alert_type")


@query("tk3_oldest_training_history", with_views("""
SELECT created_at, accuracy, f1_score, 0.001e0 AS learning_rate FROM model_metrics ORDER BY created_at LIMIT 50"""))
def oldest_history(spark, sf):
    h = views.model_metrics(spark, sf).withColumn("learning_rate", F.lit(None).cast("double"))
    return T.oldest(h, "created_at", 50).select(
        "created_at", "accuracy", "f1_score", F.coalesce("learning_rate", F.lit(0.001)).alias("learning_rate")
    )


@query("tk4_build_history", with_views("""
SELECT job_name, build_number, status FROM builds WHERE job_name = '5-LOW' ORDER BY build_timestamp DESC NULLS FIRST, job_name, build_number LIMIT 200"""))
def build_history(spark, sf):
    return B.history(views.builds(spark, sf), "5-LOW", 200).select("job_name", "build_number", "status")


_ORDER = "CASE model_name WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END"


@query("tk7_best_model", with_views(f"""
SELECT model_name, f1_score FROM (SELECT model_name, max(f1_score) AS f1_score FROM model_runs GROUP BY 1) ORDER BY f1_score DESC, {_ORDER}, model_name LIMIT 1"""))
def best_model(spark, sf):
    from buildlark.operators.models import best_model as best

    per_model = views.model_runs(spark, sf).groupBy("model_name").agg(F.max("f1_score").alias("cv_f1_mean"))
    out = best(per_model, ["ECONOMY", "STANDARD"])
    return out.select("model_name", F.col("cv_f1_mean").alias("f1_score"))


# --- sets --------------------------------------------------------------------------
@query("set1_labelled_batches", """
SELECT event_id AS id, props AS log_text, false AS is_anomaly, md5('42|' || event_id) AS shuffle_key FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, props, true, md5('42|' || event_id) FROM events WHERE event_type = 'error'""")
def labelled_batches(spark, sf):
    """Normal and anomalous batches put together, with a reproducible shuffle key."""
    e = views.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("props").alias("log_text"), "event_type")
    normal = e.where("event_type <> 'error'").withColumn("is_anomaly", F.lit(False))
    anomalous = e.where("event_type = 'error'").withColumn("is_anomaly", F.lit(True))
    both = ordering.hash_order(normal.unionByName(anomalous), [F.col("id")], 42, "shuffle_key")
    return both.select("id", "log_text", "is_anomaly", "shuffle_key")


# --- model comparison -----------------------------------------------------------------
@query("cmp1_model_comparison", with_views("""
WITH run AS (SELECT * FROM model_runs WHERE training_run = (SELECT arg_max(training_run, created_seq) FROM model_runs))
SELECT model_name AS name, training_run, created_seq, f1_score, 0.0e0 AS roc_auc, f1_score >= (SELECT max(f1_score) FROM run) AS is_best FROM run"""))
def model_comparison(spark, sf):
    rows = views.model_runs(spark, sf).withColumn("roc_auc", F.lit(None).cast("double"))
    return R.model_comparison(rows, ["roc_auc"])
