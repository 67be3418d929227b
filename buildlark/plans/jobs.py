"""Queries for models, forecasts, explanations, stored tables, whole jobs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlark import schemas
from buildlark.functions import logtext, scoring, times
from buildlark.operators import builds as B
from buildlark.operators import builds_model as BM
from buildlark.operators import explain as X
from buildlark.operators import forecast as FC
from buildlark.operators import models as ML
from buildlark.operators import predict as P
from buildlark.operators import rollups as R
from buildlark.operators import sequence_model as SM
from buildlark.operators import tables, training_run
from buildlark.plans import views
from buildlark.plans.mining_sql import sql_mined
from buildlark.plans.registry import query
from buildlark.plans.rollups import _HOURLY, _hourly
from buildlark.plans.views import with_views
from buildlark.session import new_table_path, settle
from buildlark.sources.tables import stored_table
from buildlark.streaming import streams as ST

RUN_AT = "2024-02-01 12:00:00"

_runs: dict[tuple[str, str], training_run.Run] = {}


def _at():
    return F.lit(RUN_AT).cast("timestamp")


def _build_labels(spark, sf) -> DataFrame:
    """A build failed if at least two of its last eight lines are anomalous."""
    bad = F.col("line").startswith("FATAL") | F.col("line").contains("refused")
    late = views.build_events(spark, sf).where("pos >= 12")
    return late.groupBy("build").agg((scoring.count_if(bad) >= 2).cast("int").alias("label"))


def _run(spark: SparkSession, sf: str) -> training_run.Run:
    """One training run per session and data set, shared by the queries that need a model."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _runs:
        _runs[key] = training_run.train_models(
            views.labelled_lines(spark, sf), _at(), ML.Settings(),
            settle(views.build_events(spark, sf), "build-lines"), settle(_build_labels(spark, sf), "build-labels"),
            root=new_table_path(spark, "metrics"),
        )
    return _runs[key]


# --- models -----------------------------------------------------------------------
@query("ml1_train")
def train(spark, sf):
    """Cross-validated figures of every model."""
    return _run(spark, sf).classifier.cv


@query("ml2_cross_validate")
def cross_validate(spark, sf):
    """Figures of every model on each of the five folds, templates included."""
    return _run(spark, sf).classifier.folds


@query("ml3_evaluate")
def evaluate(spark, sf):
    return _run(spark, sf).multi_model_metrics.drop("feature_importance")


_BUILD_LABELS = """
SELECT build, (count_if(starts_with(line, 'FATAL') OR contains(line, 'refused')) >= 2) :: int AS label FROM build_events WHERE pos >= 12 GROUP BY 1"""

_DEALT = f"""
dealt AS (SELECT is_anomaly, (row_number() OVER (PARTITION BY is_anomaly ORDER BY md5('7|' || id), id) - 1) % 5 AS part FROM labelled_lines),
build_labels AS ({_BUILD_LABELS}),
builds_dealt AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY md5('11|' || build), build) - 1) % 5 AS part FROM build_labels),
models(model_name) AS (VALUES {", ".join(f"('{m}')" for m in ML.MODEL_ORDER)}),
samples AS (
  SELECT model_name, count_if(part = 0) :: bigint AS test_samples, count_if(part <> 0) :: bigint AS training_samples, count_if(part = 0 AND is_anomaly) :: bigint AS positives
  FROM dealt, models GROUP BY 1
  UNION ALL SELECT '{training_run.SEQUENCE}', count_if(part = 0), count_if(part <> 0), count_if(part = 0 AND label = 1) FROM builds_dealt)"""


@query("ml3_evaluated_samples", with_views(f"WITH {_DEALT} SELECT * FROM samples"))
def evaluated_samples(spark, sf):
    """Rows every model was fitted and evaluated on; the confusion counts must add up to them."""
    m = _run(spark, sf).multi_model_metrics
    tp, fp, tn, fn = (F.col(f"{a}_{b}") for a, b in (("true", "positives"), ("false", "positives"), ("true", "negatives"), ("false", "negatives")))
    return m.select("model_name", (tp + fp + tn + fn).cast("long").alias("test_samples"), F.col("training_samples").cast("long").alias("training_samples"),
                    (tp + fn).cast("long").alias("positives"))


@query("ml4_score_lines")
def score_lines(spark, sf):
    lines = views.labelled_lines(spark, sf)
    return ML.score(_run(spark, sf).classifier, lines).drop("features")


@query("ml4_score_lines_by_rule", with_views("""
SELECT id, is_anomaly, anomaly_score, confidence, 'keyword_fallback' AS model_used FROM verdicts"""))
def score_by_rule(spark, sf):
    lines = views.event_logs(spark, sf).select(F.col("event_id").alias("id"), F.col("raw").alias("log_text"))
    return ML.score(None, lines).select("id", "is_anomaly", "anomaly_score", "confidence", "model_used")


@query("ml5_feature_importance")
def feature_importance(spark, sf):
    return ML.feature_importance(_run(spark, sf).classifier, 5000)


@query("tk5_top_importance")
def top_importance(spark, sf):
    return ML.feature_importance(_run(spark, sf).classifier, 20)


def _contributions(spark, sf) -> tuple[DataFrame, DataFrame]:
    clf = _run(spark, sf).classifier
    ready = ML.featurise(views.labelled_lines(spark, sf), "log_text", clf)
    trees = X._trees(X.node_table(spark, clf.models[ML.RF]))
    names = spark.createDataFrame(list(enumerate(clf.space.names)), "idx int, feature string")
    return X.contributions(ready, "id", trees), names


@query("jn6_feature_names")
def feature_name_join(spark, sf):
    """Mean size of each feature's contribution over all lines, by name."""
    contribs, names = _contributions(spark, sf)
    mean = contribs.groupBy("idx").agg(F.avg(F.abs("contribution")).alias("mean_size"), F.count(F.lit(1)).alias("n"))
    return mean.join(F.broadcast(names), "idx")


@query("tk6_top_contributions")
def top_contributions(spark, sf):
    out = X.explain(_run(spark, sf).classifier, views.labelled_lines(spark, sf), "id")
    return out.select("id", F.to_json("shap_explanation").alias("explanation"))


@query("xpl1_explain")
def explain(spark, sf):
    out = X.explain(_run(spark, sf).classifier, views.labelled_lines(spark, sf), "id")
    return out.select("id", "shap_explanation.base_value", F.explode("shap_explanation.features").alias("f")).select(
        "id", "base_value", "f.*"
    )


@query("xpl1_additivity", with_views("SELECT id, is_anomaly, 0.0e0 AS off FROM labelled_lines"))
def additivity(spark, sf):
    """How far the mean share plus all Shapley values of a line is from the forest's own score."""
    clf, lines = _run(spark, sf).classifier, views.labelled_lines(spark, sf)
    ready = settle(ML.featurise(lines, "log_text", clf).select("id", F.lit(0).alias("label"), "features"), "featurised")
    trees = X._trees(X.node_table(spark, clf.models[ML.RF]))
    total = X.contributions(ready, "id", trees).groupBy("id").agg((F.first("base_value") + F.sum("contribution")).alias("total"))
    own = ML.predictions(clf.models[ML.RF], ready, "id").select("id", "p1")
    off = F.abs(F.round(F.col("total") - F.col("p1"), 6))
    return lines.select("id", "is_anomaly").join(total, "id", "left").join(own, "id", "left").select("id", "is_anomaly", off.alias("off"))


@query("set2_stacked_vectors")
def stacked_vectors(spark, sf):
    """Width and filled cells of each line's stacked feature vector."""
    from pyspark.ml.functions import vector_to_array

    ready = ML.featurise(views.labelled_lines(spark, sf), "log_text", _run(spark, sf).classifier)
    v = ready.select("id", X._cells("features").alias("c"))
    return v.select("id", F.size("c.indices").alias("n_cells"), F.round(F.aggregate("c.values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# --- forecast -----------------------------------------------------------------------
@query("fc1_forecast")
def forecast(spark, sf):
    return FC.forecast(_hourly(spark, sf), "job")


@query("fc1_trend_check", with_views(f"""
WITH h AS ({_HOURLY}),
d AS (SELECT job, hour, failures - lag(failures) OVER w AS d FROM h WINDOW w AS (PARTITION BY job ORDER BY hour)),
b AS (SELECT job, d, lag(d) OVER (PARTITION BY job ORDER BY hour) AS before FROM d)
SELECT job, count(*) AS n, round(regr_slope(d, before), 9) AS slope, round(regr_intercept(d, before), 9) AS intercept FROM b WHERE before IS NOT NULL GROUP BY 1"""))
def trend_check(spark, sf):
    out = FC.trend_check(_hourly(spark, sf), "job")
    return out.select("job", "n", F.round("slope", 9).alias("slope"), F.round("intercept", 9).alias("intercept"))


# --- builds as sequences ---------------------------------------------------------------
@query("seq2_learning_curve")
def learning_curve(spark, sf):
    fitted = _run(spark, sf).build_model
    if fitted is None:  # fewer than fifty builds to train on
        return spark.createDataFrame([], SM.CURVE)
    return fitted.curve


@query("seq2_compare_models")
def compare_build_models(spark, sf):
    """Held-out figures of the model trained by epochs and of boosted trees over escalation figures, on the same builds."""
    lines, labels = views.build_events(spark, sf), settle(_build_labels(spark, sf), "build-labels")
    dealt = settle(ML.stratified(labels, "label", "build", 11, "part"), "dealt")
    fit, held = dealt.where("part <> 0").drop("part"), dealt.where("part = 0").drop("part")
    own = lines.join(held.select("build"), "build", "left_semi")
    out = []
    for name, kind, fitted in (("epochs", SM, _run(spark, sf).build_model), ("boosted", BM, BM.train(lines, fit))):
        if fitted is not None:
            out.append(kind.evaluate(fitted, own, held).select(F.lit(name).alias("kind"), "accuracy", "precision", "recall", "f1_score", "roc_auc"))
    if not out:
        return spark.createDataFrame([], "kind string, accuracy double, precision double, recall double, f1_score double, roc_auc double")
    return out[0].unionByName(out[1])


@query("seq3_score_builds")
def score_builds(spark, sf):
    return SM.score(_run(spark, sf).build_model, views.build_events(spark, sf))


# --- whole jobs ----------------------------------------------------------------------------
def _requests(spark, sf) -> DataFrame:
    """Scoring requests; views have no log."""
    e = views.event_logs(spark, sf)
    log = F.when(~F.col("msg").contains("Request processed"), F.col("raw"))
    return e.select(
        F.col("event_id").alias("id"), F.col("job").alias("pipeline_id"), log.alias("logs"),
        F.col("ts").alias("created_at"),
    )


_SCORED = f"""
req AS (SELECT event_id AS id, job AS pipeline_id, CASE WHEN contains(msg, 'Request processed') THEN 'Build log from ' || job ELSE raw END AS logs, ts AS created_at FROM event_logs),
hourly AS ({_HOURLY}),
differences AS (SELECT job, hour, failures AS y, failures - lag(failures) OVER (PARTITION BY job ORDER BY hour) AS d FROM hourly),
paired AS (SELECT *, lag(d) OVER (PARTITION BY job ORDER BY hour) AS b FROM differences),
sums AS (SELECT job, hour, y, d, count(*) OVER u AS n_points, count(b) OVER u :: double AS n, coalesce(sum(b) OVER u, 0) :: double AS sx,
  coalesce(sum(CASE WHEN b IS NOT NULL THEN d END) OVER u, 0) :: double AS sy, coalesce(sum(b * b) OVER u, 0) :: double AS sxx,
  coalesce(sum(d * b) OVER u, 0) :: double AS sxy, coalesce(sum(CASE WHEN b IS NOT NULL THEN d * d END) OVER u, 0) :: double AS syy
  FROM paired WINDOW u AS (PARTITION BY job ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sloped AS (SELECT *, CASE WHEN n * sxx - sx * sx > 0 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE 0e0 END AS slope FROM sums),
based AS (SELECT *, (sy - slope * sx) / greatest(n, 1e0) AS base FROM sloped),
fitted AS (SELECT *, y + base + slope * d AS mean, sqrt(greatest(0e0, (syy - base * sy - slope * sxy) / greatest(n, 1e0))) AS sigma FROM based),
ahead AS (SELECT job AS pipeline_id, hour + INTERVAL 1 HOUR AS valid_from,
  CASE WHEN n_points < 10 THEN 0 ELSE floor(greatest(0e0, round(mean, 6))) END :: integer AS predicted_failures,
  CASE WHEN n_points < 10 THEN 0 ELSE floor(greatest(0e0, round(mean - 1.96e0 * sigma, 6))) END :: integer AS failure_lower_bound,
  CASE WHEN n_points < 10 THEN 0 ELSE floor(greatest(0e0, round(mean + 1.96e0 * sigma, 6))) END :: integer AS failure_upper_bound FROM fitted),
v AS (SELECT req.*, coalesce(predicted_failures, 0) AS predicted_failures, failure_lower_bound, failure_upper_bound, {views.sql_error_matches('logs')} AS n
  FROM req ASOF LEFT JOIN ahead ON req.pipeline_id = ahead.pipeline_id AND req.created_at >= ahead.valid_from),
s AS (SELECT *, n > 0 AS is_anomaly, CASE WHEN n > 0 THEN n * (-0.5e0) ELSE 0.0e0 END AS anomaly_score,
  CASE WHEN n > 0 THEN least(0.9e0, 0.5e0 + 0.1e0 * n) ELSE 0.85e0 END AS confidence FROM v),
r AS (SELECT *, confidence * 0.6e0 + CASE WHEN predicted_failures > 3 THEN 0.4e0 ELSE 0.0e0 END AS raw_risk FROM s),
risked AS (SELECT *, CASE WHEN raw_risk > 0.7e0 THEN 'HIGH' WHEN raw_risk > 0.4e0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM r)"""


def _forecasts(spark, sf) -> DataFrame:
    """Forecasts as they are stored hour by hour, read back."""
    return settle(FC.rolling(_hourly(spark, sf), "job").withColumnRenamed("job", "pipeline_id"), "forecasts")


def _scored(spark, sf) -> DataFrame:
    return P.score_logs(_requests(spark, sf), None, _forecasts(spark, sf))


@query("fc1_rolling", with_views(f"""
WITH {_SCORED} SELECT pipeline_id AS job, strftime(valid_from, '%Y-%m-%d %H') AS valid_from, predicted_failures, failure_lower_bound AS lower_bound, failure_upper_bound AS upper_bound FROM ahead"""))
def rolling_forecasts(spark, sf):
    out = FC.rolling(_hourly(spark, sf), "job")
    return out.select("job", F.date_format("valid_from", "yyyy-MM-dd HH").alias("valid_from"), "predicted_failures", "lower_bound", "upper_bound")


@query("pip1_score_logs", with_views(f"""
WITH {_SCORED}
SELECT id, pipeline_id, logs, is_anomaly, anomaly_score, confidence, predicted_failures, failure_lower_bound, failure_upper_bound, raw_risk, risk_level, round(raw_risk, 2) AS risk_score,
  CASE split_part(substr(logs, 21), ' ', 1) WHEN 'WARN' THEN 'WARNING' WHEN 'from' THEN 'UNKNOWN' ELSE
    CASE WHEN starts_with(logs, 'Build') THEN 'UNKNOWN' ELSE split_part(substr(logs, 21), ' ', 1) END END AS log_level FROM risked"""))
def score_logs(spark, sf):
    out = P.parse_first_lines(_scored(spark, sf), "logs")
    return out.select("id", "pipeline_id", "logs", "is_anomaly", "anomaly_score", "confidence", "predicted_failures",
                      "failure_lower_bound", "failure_upper_bound", "raw_risk", "risk_level", "risk_score", F.col("parsed.log_level").alias("log_level"))


@query("pip1_score_logs_with_model")
def score_logs_with_model(spark, sf):
    """The whole job with a trained model and fitted forecasts: event ids, verdicts, risk and explanations."""
    clf = _run(spark, sf).classifier
    ahead = FC.forecast(_hourly(spark, sf), "job").withColumnRenamed("job", "pipeline_id")
    out = P.parse_first_lines(P.score_logs(_requests(spark, sf), clf, ahead), "logs", clf)
    return out.select("id", "pipeline_id", "is_anomaly", "confidence", "predicted_failures",
                      "failure_lower_bound", "failure_upper_bound", "risk_level", "model_used",
                      "parsed.event_id", "parsed.template", F.to_json("shap_explanation").alias("explanation"))


def _payloads(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Builds payloads and console logs made of the orders; a failed build logs its errors."""
    o = views.table(spark, sf, "orders")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    result = F.when(F.col("o_orderstatus") == "F", "FAILURE").when(F.col("o_orderstatus") == "P", "SUCCESS").otherwise("")
    one = F.struct(
        F.col("o_orderkey").alias("number"), result.alias("result"), ms.alias("timestamp"),
        F.floor("o_totalprice").cast("bigint").alias("duration"), F.concat(F.lit("u/"), F.col("o_orderkey").cast("string")).alias("url"),
    )
    body = F.to_json(F.struct(F.col("o_orderpriority").alias("job_name"), F.array(one).alias("builds")))
    log = F.when(F.col("o_totalprice") > 300000, F.concat(
        F.lit("Step 1 done\nERROR connection to db refused after "), F.col("o_custkey").cast("string"), F.lit("s\nBuild FAILED")
    )).otherwise(F.lit("All tests passed"))
    logs = o.select(F.col("o_orderpriority").alias("job_name"), F.col("o_orderkey").alias("build_number"), log.alias("log"))
    return o.select(body.alias("body")), logs


_SYNCED = """
SELECT o_orderpriority AS job_name, o_orderkey AS build_number,
  CASE o_orderstatus WHEN 'F' THEN 'FAILURE' WHEN 'P' THEN 'SUCCESS' ELSE 'IN_PROGRESS' END AS status,
  cast(floor(o_totalprice) AS bigint) AS duration_ms, 'u/' || o_orderkey AS build_url, false AS is_demo,
  CASE WHEN o_totalprice > 300000 THEN 'Step 1 done' || chr(10) || 'ERROR connection to db refused after ' || o_custkey || 's' || chr(10) || 'Build FAILED' ELSE 'All tests passed' END AS log_snippet,
  o_totalprice > 300000 AS predicted_failure, CASE WHEN o_totalprice > 300000 THEN 0.8e0 ELSE 0.85e0 END AS prediction_confidence,
  'MEDIUM' AS risk_level, CASE WHEN o_totalprice > 300000 THEN 0.48e0 ELSE 0.51e0 END AS risk_score,
  o_orderstatus = 'F' AS actual_failure, CASE WHEN o_orderstatus IN ('F', 'P') THEN (o_totalprice > 300000) = (o_orderstatus = 'F') END AS prediction_correct,
  epoch_us(o_orderdate) AS build_epoch FROM orders"""


@query("pip2_sync_builds", _SYNCED)
def sync_builds(spark, sf):
    payload, logs = _payloads(spark, sf)
    rows = tables.build_rows(P.sync_builds(payload, logs, _at()))
    merged = tables.upsert_builds(rows.limit(0), rows)
    return merged.withColumn("build_epoch", F.unix_micros("build_timestamp")).drop(
        "id", "recommendation", "build_timestamp", "synced_at"
    )


@query("pip3_training_run")
def training_rows(spark, sf):
    return _run(spark, sf).training_history


# --- stored tables -----------------------------------------------------------------------------
@query("snk1_append_predictions", with_views(f"""
WITH {_SCORED} SELECT id, pipeline_id, left(logs, 500) AS log_snippet, is_anomaly, confidence AS anomaly_confidence, predicted_failures, failure_lower_bound, failure_upper_bound, risk_level FROM risked"""))
def append_predictions(spark, sf):
    root = new_table_path(spark, "store")
    tables.store_predictions(_scored(spark, sf), root)
    return stored_table(spark, root, "predictions").select(
        "id", "pipeline_id", "log_snippet", "is_anomaly", "anomaly_confidence", "predicted_failures", "failure_lower_bound", "failure_upper_bound", "risk_level"
    )


@query("snk2_append_alerts", with_views(f"""
WITH {_SCORED} SELECT id AS prediction_id, pipeline_id, 'ANOMALY' AS alert_type, CASE risk_level WHEN 'HIGH' THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
  false AS is_resolved FROM risked WHERE risk_level <> 'LOW'"""))
def append_alerts(spark, sf):
    root = new_table_path(spark, "store")
    tables.store_predictions(_scored(spark, sf), root)
    tables.append(tables.alert_rows(stored_table(spark, root, "predictions")), root, "alerts")
    return stored_table(spark, root, "alerts").select("prediction_id", "pipeline_id", "alert_type", "severity", "is_resolved")


@query("snk3_upsert_builds", """
SELECT o_orderpriority AS job_name, o_orderkey AS build_number,
  CASE WHEN o_orderstatus = 'O' THEN 'SUCCESS' WHEN o_orderstatus = 'F' THEN 'FAILURE' ELSE 'SUCCESS' END AS status,
  'first/' || o_orderkey AS build_url, o_orderstatus = 'P' AS is_demo,
  CASE WHEN o_orderstatus = 'O' THEN cast(floor(o_totalprice) AS bigint) * 2 ELSE cast(floor(o_totalprice) AS bigint) END AS duration_ms FROM orders""")
def upsert_builds(spark, sf):
    """All orders stored once, in buckets; the open ones come in again finished, twice, with another URL."""
    o = views.table(spark, sf, "orders")

    def rows(of, status, url, factor, demo, at):
        return tables.conform(of.select(
            F.col("o_orderpriority").alias("job_name"), F.col("o_orderkey").alias("build_number"), status.alias("status"),
            (F.floor("o_totalprice").cast("bigint") * factor).alias("duration_ms"),
            F.concat(F.lit(url), F.col("o_orderkey").cast("string")).alias("build_url"), demo.alias("is_demo"),
            F.col("o_orderdate").cast("timestamp").alias("build_timestamp"), F.lit(at).cast("timestamp").alias("synced_at"),
        ), schemas.TABLES["builds"])

    state = F.when(F.col("o_orderstatus") == "F", "FAILURE").when(F.col("o_orderstatus") == "P", "SUCCESS").otherwise("IN_PROGRESS")
    stored = rows(o, state, "first/", 1, F.col("o_orderstatus") == "P", "2024-01-01 00:00:00")
    again = o.where("o_orderstatus = 'O'")
    late = rows(again, F.lit("SUCCESS"), "second/", 2, F.lit(True), "2024-01-03 00:00:00")
    early = rows(again, F.lit("ABORTED"), "second/", 3, F.lit(True), "2024-01-02 00:00:00")
    root = new_table_path(spark, "builds")
    tables.store_builds(stored, root, 16)
    tables.merge_builds(late.unionByName(early), root, 16)
    return tables.stored_builds(spark, root).select("job_name", "build_number", "status", "build_url", "is_demo", "duration_ms")


@query("snk3_upsert_touches", """
SELECT o_orderpriority AS job_name, o_orderkey AS build_number, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 'ABORTED' ELSE 'SUCCESS' END AS status,
  o_orderkey <> (SELECT min(o_orderkey) FROM orders) AS synced_before,
  (SELECT count(*) FROM orders) > 0 AS one_bucket FROM orders""")
def upsert_touches(spark, sf):
    """The build of the lowest number comes in again: one of 16 buckets is rewritten, all rows are still there."""
    o = views.table(spark, sf, "orders")
    root = new_table_path(spark, "builds")

    def rows(of, status, at):
        return of.select(
            F.col("o_orderpriority").alias("job_name"), F.col("o_orderkey").alias("build_number"), F.lit(status).alias("status"),
            F.lit(at).cast("timestamp").alias("synced_at"), F.col("o_orderdate").cast("timestamp").alias("build_timestamp"))

    tables.store_builds(rows(o, "SUCCESS", "2024-01-01 00:00:00"), root, 16)
    lowest = o.agg(F.min("o_orderkey")).first()[0]
    touched = tables.merge_builds(rows(o.where(F.col("o_orderkey") == lowest), "ABORTED", "2024-01-02 00:00:00"), root, 16)
    return tables.stored_builds(spark, root).select(
        "job_name", "build_number", "status", (F.col("synced_at") < F.lit("2024-01-02").cast("timestamp")).alias("synced_before"),
        F.lit(len(touched) == 1).alias("one_bucket"))


@query("snk4_metrics_rows")
def metrics_rows(spark, sf):
    """Rows of the run for each metrics table, appended and read back."""
    run, root = _run(spark, sf), new_table_path(spark, "store")
    out = None
    for name in ("multi_model_metrics", "model_metrics", "training_history"):
        tables.append(getattr(run, name), root, name)
        got = stored_table(spark, root, name).select(F.lit(name).alias("table_name"), "accuracy", "f1_score", "training_samples")
        out = got if out is None else out.unionByName(got)
    return out


@query("snk4_stored_samples", with_views(f"""
WITH {_DEALT}, n AS (SELECT any_value(training_samples) AS lines FROM samples WHERE model_name <> '{training_run.SEQUENCE}'),
b AS (SELECT training_samples AS builds FROM samples WHERE model_name = '{training_run.SEQUENCE}')
SELECT 'multi_model_metrics' AS table_name, {len(ML.MODEL_ORDER) + 1} :: bigint AS n_rows, lines * {len(ML.MODEL_ORDER)} + builds AS training_samples FROM n, b
UNION ALL SELECT 'model_metrics', 1, lines FROM n
UNION ALL SELECT 'training_history', {len(ML.MODEL_ORDER) + SM.EPOCHS}, lines * {len(ML.MODEL_ORDER)} + builds * {SM.EPOCHS} FROM n, b"""))
def stored_samples(spark, sf):
    """Rows of each metrics table of the run, read back, and the training samples they name."""
    return metrics_rows(spark, sf).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("training_samples").cast("long").alias("training_samples"))


@query("snk5_replace", with_views("SELECT id, log_text, is_anomaly FROM labelled_lines"))
def replace(spark, sf):
    """Loading twice leaves one copy."""
    root = new_table_path(spark, "store")
    lines = views.labelled_lines(spark, sf)
    tables.replace(lines, root, "training_data")
    tables.replace(lines, root, "training_data")
    return stored_table(spark, root, "training_data").select("id", "log_text", "is_anomaly")


@query("snk7_save_and_load")
def save_and_load(spark, sf):
    """Scores of a stored and reloaded classifier next to those of the original."""
    clf, path = _run(spark, sf).classifier, new_table_path(spark, "model")
    ML.save(clf, path)
    lines = views.labelled_lines(spark, sf)
    a = ML.score(clf, lines).select("id", F.col("anomaly_score").alias("before"))
    b = ML.score(ML.load(path), lines).select("id", F.col("anomaly_score").alias("after"))
    return a.join(b, "id")


@query("snk7_scores_survive", with_views("SELECT id, true AS same FROM labelled_lines"))
def scores_survive(spark, sf):
    """Whether a stored and reloaded classifier gives a line the score it had."""
    return save_and_load(spark, sf).select("id", (F.abs(F.col("before") - F.col("after")) < 1e-12).alias("same"))


@query("snk8_add_missing_column", with_views("""
SELECT id, pipeline_id, is_anomaly, risk_level, cast(NULL AS varchar) AS shap_explanation FROM predictions"""))
def add_missing_column(spark, sf):
    """A predictions table from before explanations were stored, read as today's."""
    root = new_table_path(spark, "old")
    views.predictions(spark, sf).select("id", "pipeline_id", "is_anomaly", "risk_level").write.parquet(root)
    now = tables.conform(spark.read.parquet(root), schemas.TABLES["predictions"])
    return now.select("id", "pipeline_id", "is_anomaly", "risk_level", F.to_json("shap_explanation").alias("shap_explanation"))


@query("snk9_backfill_explanations")
def backfill_explanations(spark, sf):
    lines = views.labelled_lines(spark, sf).select("id", F.col("log_text").alias("log_snippet"))
    rows = tables.conform(lines, schemas.TABLES["predictions"])
    out = tables.backfill_explanations(rows, _run(spark, sf).classifier)
    return out.select("id", F.to_json("shap_explanation").alias("explanation"))


@query("snk9_backfilled", with_views("SELECT id, log_text AS log_snippet, true AS filled FROM labelled_lines"))
def backfilled(spark, sf):
    """Predictions without an explanation have one afterwards, and nothing else has changed."""
    lines = views.labelled_lines(spark, sf).select("id", F.col("log_text").alias("log_snippet"))
    rows = tables.conform(lines, schemas.TABLES["predictions"])
    out = tables.backfill_explanations(rows, _run(spark, sf).classifier)
    return out.select("id", "log_snippet", (F.size("shap_explanation.features") > 0).alias("filled"))


@query("snk10_acknowledge", with_views("""
SELECT prediction_id AS id, line, severity, prediction_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AS acknowledged FROM alerts"""))
def acknowledge(spark, sf):
    """Alerts of urgent orders acknowledged."""
    a = views.alerts(spark, sf).select(F.col("prediction_id").alias("id"), "line", "severity")
    acks = views.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    return tables.acknowledge(a, acks)


@query("snk11_row_as_json", with_views("""
SELECT job_name, build_number, '{"job_name":"' || job_name || '","build_number":' || build_number || ',"status":"' || status || '","duration_ms":' || duration_ms
  || ',"build_timestamp":"' || strftime(build_timestamp, '%Y-%m-%dT%H:%M:%S') || '","predicted_failure":' || predicted_failure
  || ',"actual_failure":' || actual_failure || ',"prediction_correct":' || coalesce(cast(prediction_correct AS varchar), 'null') || '}' AS payload FROM judged_builds"""))
def row_as_json(spark, sf):
    return ST.as_events(B.judged(views.builds(spark, sf)))


# --- streams ---------------------------------------------------------------------------------------
def _fed(spark, parts: list[DataFrame], start):
    """Land the parts one after the other as JSON files; the stream is stopped after each and goes on from its checkpoint.

    ``start(folder)`` starts it; the last query is returned."""
    folder = new_table_path(spark, "landing")
    q = None
    for part in parts:
        part.write.mode("append").json(folder)
        q = start(folder)
        q.awaitTermination()
    return q


def _thirds(rows: DataFrame, by: str) -> list[DataFrame]:
    return [rows.where(F.pmod(F.col(by), F.lit(3)) == k) for k in range(3)]


def _build_events(spark, sf) -> DataFrame:
    _, logs = _payloads(spark, sf)
    b = views.builds(spark, sf).join(logs, ["job_name", "build_number"])
    return b.select(
        "job_name", "build_number", "status", "duration_ms", times.iso(F.col("build_timestamp")).alias("timestamp"),
        F.concat(F.lit("u/"), F.col("build_number").cast("string")).alias("url"), "log", F.lit(False).alias("demo"),
    )


_SENT = f"{schemas.BUILD_EVENT}, sent_at timestamp"
_EVENT_KEYS = ("job_name", "build_number", "status", "timestamp")


def _sent(events: DataFrame, minute: int) -> DataFrame:
    """Events as sent in one minute of an hour."""
    return events.withColumn("sent_at", F.lit(f"2024-01-01 10:{minute:02d}:00").cast("timestamp"))


@query("src8_stream_scan", with_views("""
SELECT job_name, build_number, status, duration_ms, strftime(build_timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM builds"""))
def stream_scan(spark, sf):
    """Three lots of files, taken up in three runs."""
    out, cp = new_table_path(spark, "table"), new_table_path(spark, "checkpoint")
    _fed(spark, _thirds(_build_events(spark, sf), "build_number"), lambda folder: ST.store(ST.read_json(spark, folder), out, cp))
    return spark.read.parquet(out).select("job_name", "build_number", "status", "duration_ms", "timestamp")


@query("st1_follow_builds", with_views("""
SELECT b.job_name, b.build_number, b.status, o_totalprice > 300000 AS predicted_failure,
  CASE b.build_number % 3 WHEN 0 THEN 'first/' ELSE 'u/' END || b.build_number AS build_url, b.build_number % 3 = 0 AS is_demo,
  status NOT IN ('SUCCESS', 'IN_PROGRESS') AS actual_failure,
  CASE WHEN status <> 'IN_PROGRESS' THEN (o_totalprice > 300000) = (status NOT IN ('SUCCESS', 'IN_PROGRESS')) END AS prediction_correct
FROM builds b JOIN orders ON o_orderkey = b.build_number"""))
def follow_builds(spark, sf):
    """A third of the builds comes while it runs, then all as they end, then what came first once more.

    The events that are sent again have another URL and are told by job, number, status and time; were they taken
    up, a third of the builds would be running again."""
    events = _build_events(spark, sf)
    number = F.col("build_number")
    begun = events.where(number % 3 == 0).withColumns({
        "status": F.lit("QUEUED"), "url": F.concat(F.lit("first/"), number.cast("string")), "demo": F.lit(True)})
    again = begun.withColumn("url", F.lit("again/"))
    root, cp = new_table_path(spark, "builds"), new_table_path(spark, "checkpoint")

    def start(folder: str):
        return ST.follow_builds(ST.once(ST.read_json(spark, folder, _SENT), _EVENT_KEYS, "sent_at"), root, cp)

    _fed(spark, [_sent(begun, 1), _sent(events, 2), _sent(again, 3)], start)
    return ST.current_builds(spark, root).select(
        "job_name", "build_number", "status", "predicted_failure", "build_url", "is_demo", "actual_failure", "prediction_correct"
    )


@query("st2_mine_stream", with_views(f"WITH {sql_mined('msg')} SELECT pos, event_id, template_online FROM mined"))
def mine_stream(spark, sf):
    """Lines in three lots: those of each third of the log, but every seventh comes a lot late."""
    lines = views.event_logs(spark, sf).select(F.col("event_id").alias("pos"), F.col("msg").alias("raw"))
    n = lines.agg((F.max("pos") - F.min("pos") + 1).alias("n"), F.min("pos").alias("low")).first()
    third, low = -(-n["n"] // 3), n["low"]
    lot = F.least(F.lit(2), F.floor((F.col("pos") - low) / F.lit(third)) + F.when(F.col("pos") % 7 == 3, 1).otherwise(0))
    root, cp = new_table_path(spark, "mined"), new_table_path(spark, "checkpoint")

    def start(folder: str):
        return ST.mine_lines(ST.read_json(spark, folder, "pos long, raw string"), root, cp, lag=2 * third)

    q = _fed(spark, [lines.where(lot == k) for k in range(3)], start)
    return ST.mined_lines(spark, root, q.lastProgress["batchId"])


@query("st3_job_figures", with_views("""
SELECT job_name, count(*) AS total_builds, count_if(actual_failure) :: bigint AS actual_failures,
  count_if(predicted_failure) :: bigint AS predicted_failures, count_if(prediction_correct) :: bigint AS correct_predictions FROM judged_builds GROUP BY 1"""))
def job_figures(spark, sf):
    ddl = "job_name string, build_number long, status string, duration_ms long, predicted_failure boolean"
    out, cp = new_table_path(spark, "figures"), new_table_path(spark, "checkpoint")
    q = _fed(spark, _thirds(views.builds(spark, sf), "build_number"),
             lambda folder: ST.refresh(ST.job_figures(ST.read_json(spark, folder, ddl)), out, cp))
    return spark.read.parquet(f"{out}/{q.lastProgress['batchId']}")


@query("st4_hourly_counts", with_views("""
SELECT pipeline_id AS job, strftime(date_trunc('hour', created_at), '%Y-%m-%d %H') AS hour, count_if(is_anomaly) :: bigint AS failures
FROM predictions GROUP BY 1, 2, date_trunc('hour', created_at)
HAVING date_trunc('hour', created_at) + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM predictions) - INTERVAL 1 HOUR"""))
def hourly_counts(spark, sf):
    """The older half of the rows, the newer half, and then rows of closed hours once more, which come too late."""
    rows = views.predictions(spark, sf).select(F.col("pipeline_id").alias("job"), F.col("created_at").cast("timestamp").alias("created_at"), "is_anomaly")
    t = rows.agg(F.percentile_approx("created_at", 0.5).alias("middle"), F.max("created_at").alias("last")).first()
    older = rows.where(F.col("created_at") < F.lit(t["middle"]))
    late = older.where(F.col("created_at") < F.lit(t["last"]) - F.expr("INTERVAL 3 HOURS"))
    out, cp = new_table_path(spark, "hours"), new_table_path(spark, "checkpoint")

    def start(folder: str):
        events = ST.read_json(spark, folder, "job string, created_at timestamp, is_anomaly boolean")
        return ST.store(ST.hourly_counts(events, "job", "created_at", F.col("is_anomaly")), out, cp)

    _fed(spark, [older, rows.where(F.col("created_at") >= F.lit(t["middle"])), late], start)
    got = spark.read.schema("job string, hour timestamp, failures long").parquet(out)
    return got.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query("tk8_latest_events", with_views("""
SELECT job_name, build_number, status FROM builds ORDER BY build_timestamp DESC, job_name, build_number LIMIT 50"""))
def latest_events(spark, sf):
    """Three lots of events, and the first lot once more, which must not take places twice."""
    lots = _thirds(_build_events(spark, sf), "build_number")
    root, cp = new_table_path(spark, "latest"), new_table_path(spark, "checkpoint")

    def start(folder: str):
        return ST.keep_latest(ST.once(ST.read_json(spark, folder, _SENT), _EVENT_KEYS, "sent_at"), root, cp)

    q = _fed(spark, [_sent(part, k) for k, part in enumerate([*lots, lots[0]])], start)
    return spark.read.parquet(f"{root}/{q.lastProgress['batchId']}").select("job_name", "build_number", "status")
