"""The library's inputs, derived from the given tables, as DataFrames and as DuckDB text.

``with_views("SELECT …")`` prefixes a DuckDB query with every view it needs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlark.functions import logtext, scoring
from buildlark.sources.tables import scan

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return scan(spark, f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and text of every document."""
    return table(spark, sf, "documents").select("doc_id", "text")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def event_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines: event_id (line number), ts, job, msg, raw = time stamp + msg."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "props")
    num = F.get_json_object("props", "$.k")
    kind, eid = F.col("event_type"), F.col("event_id")
    level = (
        F.when(kind == "error", F.when(eid % 3 == 0, "FATAL").otherwise("ERROR"))
        .when(kind == "signup", "WARN")
        .when(kind == "purchase", "DEBUG")
        .otherwise("INFO")
    )
    is_error = kind == "error"
    body = (
        F.when(is_error & (eid % 4 == 0), F.concat(F.lit("Database connection timeout after "), num, F.lit("s")))
        .when(is_error & (eid % 4 == 1), F.concat(F.lit("Connection refused by host 10.0.0."), num))
        .when(is_error & (eid % 4 == 2), F.concat(F.lit("Test suite FAILED after "), num, F.lit("ms")))
        .when(is_error, F.concat(F.lit("Worker restarted on node n"), num))
        .when(kind == "signup", F.concat(F.lit("Slow database query ("), num, F.lit("ms)")))
        .when(kind == "view", F.concat(F.lit("Request processed in "), num, F.lit("ms")))
        .when(kind == "click", F.concat(F.lit("Build started for branch b"), num))
        .otherwise(F.concat(F.lit("Cache key hit: user_"), num))
    )
    msg = F.concat(level, F.lit(" [svc-"), (F.col("user_id") % 15).cast("string"), F.lit("] "), body)
    return e.select(
        "event_id",
        "ts",
        F.concat(F.lit("job-"), (F.col("user_id") % 5).cast("string")).alias("job"),
        msg.alias("msg"),
    ).withColumn("raw", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.col("msg")))


def builds(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    status = (
        F.when(F.col("o_orderstatus") == "F", "FAILURE")
        .when(F.col("o_orderstatus") == "P", "SUCCESS")
        .otherwise(F.when(F.col("o_orderkey") % 7 == 0, "ABORTED").otherwise("IN_PROGRESS"))
    )
    return o.select(
        F.col("o_orderpriority").alias("job_name"),
        F.col("o_orderkey").alias("build_number"),
        status.alias("status"),
        F.floor("o_totalprice").cast("bigint").alias("duration_ms"),
        F.col("o_orderdate").alias("build_timestamp"),
        (F.col("o_totalprice") > 300000).alias("predicted_failure"),
    )


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem")
    done = F.col("l_linestatus") == "F"
    return x.select(
        F.col("l_orderkey").alias("prediction_id"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_returnflag") == "A", "CRITICAL")
        .when(F.col("l_returnflag") == "N", "WARNING")
        .otherwise("INFO")
        .alias("severity"),
        F.when(F.col("l_partkey") % 3 == 0, "FORECAST")
        .when(F.col("l_partkey") % 3 == 1, "ANOMALY")
        .otherwise("BOTH")
        .alias("alert_type"),
        done.alias("is_resolved"),
        F.col("l_shipdate").alias("created_at"),
        F.when(
            done,
            F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.col("l_quantity").cast("int")),
        ).alias("resolved_at"),
    )


def model_runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("training_run"),
        F.col("p_type").alias("model_name"),
        (F.col("p_size").cast("double") / 50).alias("f1_score"),
        F.col("p_partkey").alias("created_seq"),
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(lab, "doc_id").select(
        "doc_id", F.col("toxic").alias("label"), F.col("n_chars").cast("double").alias("score")
    )


def training(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("log_text"),
        (F.col("quality") == 0).alias("is_anomaly"),
    )


def labelled_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines with a label that is not a function of the keyword rule alone: FATAL or refused."""
    return event_logs(spark, sf).select(
        F.col("event_id").alias("id"),
        F.col("msg").alias("log_text"),
        (F.col("msg").startswith("FATAL") | F.col("msg").contains("refused")).alias("is_anomaly"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Stored predictions: the event log scored by the keyword rule."""
    logs = event_logs(spark, sf).select(
        F.col("event_id").alias("id"),
        F.col("job").alias("pipeline_id"),
        F.col("raw").alias("log_text"),
        F.col("ts").alias("created_at"),
    )
    risk = scoring.raw_risk(F.col("confidence"), F.col("predicted_failures"))
    return (
        scoring.keyword_verdict(logs, "log_text")
        .withColumn("predicted_failures", F.lit(0))
        .withColumn("raw_risk", risk)
        .withColumn("risk_level", scoring.risk_level(F.col("raw_risk")))
        .withColumn("risk_score", F.round("raw_risk", 2))
    )


def build_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Build sequences: one row per (build, pos) with its text; every conversation is a build."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("build"), F.col("turn").alias("pos"), F.col("text").alias("line")
    )


def build_events(spark: SparkSession, sf: str) -> DataFrame:
    """Builds of 20 consecutive log lines each."""
    return event_logs(spark, sf).select(
        F.expr("event_id div 20").alias("build"), F.expr("event_id % 20").alias("pos"),
        F.col("msg").alias("line"),
    )


def model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("created_at"),
        (size / F.lit(50.0)).alias("accuracy"),
        (size / F.lit(60.0)).alias("f1_score"),
        (F.col("p_partkey") * 10).alias("test_samples"),
        size.cast("bigint").alias("tp"), (size + 1).cast("bigint").alias("tn"),
        (size % 7).cast("bigint").alias("fp"), (size % 5).cast("bigint").alias("fn"),
    )


def system_metrics(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("created_at"),
        F.floor(F.abs("c_acctbal")).cast("bigint").alias("successful_predictions"),
        F.col("c_nationkey").cast("bigint").alias("failed_predictions"),
        (F.col("c_nationkey") * F.lit(1.5)).alias("avg_prediction_time_ms"),
    )


def prediction_analytics(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions checked later: the outcome of an open order is still unknown."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("prediction_id"),
        (F.col("o_totalprice") > 300000).alias("predicted_anomaly"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False).alias("actual_anomaly"),
        F.col("o_orderdate").alias("predicted_at"),
    )


# ---------------------------------------------------------------------------
# The same views for DuckDB.
# ---------------------------------------------------------------------------
def sql_error_matches(col: str) -> str:
    return " + ".join(
        f"len(regexp_extract_all({col}, '(?i){p}'))" for p in logtext.ERROR_PATTERNS
    )


_VIEWS = {
    "event_logs": """
  SELECT *, concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ', msg) AS raw FROM (
    SELECT event_id, ts, concat('job-', cast(user_id % 5 AS varchar)) AS job,
      concat(CASE event_type WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'FATAL' ELSE 'ERROR' END
                  WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'DEBUG' ELSE 'INFO' END,
        ' [svc-', cast(user_id % 15 AS varchar), '] ',
        CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN concat('Database connection timeout after ', json_extract_string(props, '$.k'), 's')
             WHEN event_type = 'error' AND event_id % 4 = 1 THEN concat('Connection refused by host 10.0.0.', json_extract_string(props, '$.k'))
             WHEN event_type = 'error' AND event_id % 4 = 2 THEN concat('Test suite FAILED after ', json_extract_string(props, '$.k'), 'ms')
             WHEN event_type = 'error' THEN concat('Worker restarted on node n', json_extract_string(props, '$.k'))
             WHEN event_type = 'signup' THEN concat('Slow database query (', json_extract_string(props, '$.k'), 'ms)')
             WHEN event_type = 'view' THEN concat('Request processed in ', json_extract_string(props, '$.k'), 'ms')
             WHEN event_type = 'click' THEN concat('Build started for branch b', json_extract_string(props, '$.k'))
             ELSE concat('Cache key hit: user_', json_extract_string(props, '$.k')) END) AS msg
    FROM events)""",
    "builds": """
  SELECT o_orderpriority AS job_name, o_orderkey AS build_number,
    CASE o_orderstatus WHEN 'F' THEN 'FAILURE' WHEN 'P' THEN 'SUCCESS'
         ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'ABORTED' ELSE 'IN_PROGRESS' END END AS status,
    cast(floor(o_totalprice) AS bigint) AS duration_ms, o_orderdate AS build_timestamp,
    (o_totalprice > 300000) AS predicted_failure
  FROM orders""",
    "judged_builds": """
  SELECT *, status NOT IN ('SUCCESS', 'IN_PROGRESS') AS actual_failure,
    CASE WHEN status <> 'IN_PROGRESS'
         THEN predicted_failure = (status NOT IN ('SUCCESS', 'IN_PROGRESS')) END AS prediction_correct
  FROM builds""",
    "alerts": """
  SELECT l_orderkey AS prediction_id, l_linenumber AS line,
    CASE l_returnflag WHEN 'A' THEN 'CRITICAL' WHEN 'N' THEN 'WARNING' ELSE 'INFO' END AS severity,
    CASE WHEN l_partkey % 3 = 0 THEN 'FORECAST' WHEN l_partkey % 3 = 1 THEN 'ANOMALY' ELSE 'BOTH' END AS alert_type,
    (l_linestatus = 'F') AS is_resolved, l_shipdate AS created_at,
    CASE WHEN l_linestatus = 'F' THEN l_shipdate + to_hours(cast(l_quantity AS int)) END AS resolved_at
  FROM lineitem""",
    "model_runs": """
  SELECT p_brand AS training_run, p_type AS model_name, cast(p_size AS double) / 50 AS f1_score,
    p_partkey AS created_seq FROM part""",
    "scored": """
  SELECT d.doc_id, l.toxic AS label, cast(d.n_chars AS double) AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "labelled_lines": """
  SELECT event_id AS id, msg AS log_text,
    (starts_with(msg, 'FATAL') OR contains(msg, 'refused')) AS is_anomaly FROM event_logs""",
    "verdicts": f"""
  SELECT *, n_matches > 0 AS is_anomaly,
    CASE WHEN n_matches > 0 THEN n_matches * (-0.5e0) ELSE 0.0e0 END AS anomaly_score,
    CASE WHEN n_matches > 0 THEN least(0.9e0, 0.5e0 + 0.1e0 * n_matches) ELSE 0.85e0 END AS confidence
  FROM (SELECT event_id AS id, job AS pipeline_id, raw AS log_text, ts AS created_at,
          cast({sql_error_matches('raw')} AS integer) AS n_matches FROM event_logs)""",
    "predictions": """
  SELECT *, CASE WHEN raw_risk > 0.7e0 THEN 'HIGH' WHEN raw_risk > 0.4e0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    round(raw_risk, 2) AS risk_score
  FROM (SELECT *, 0 AS predicted_failures, confidence * 0.6e0 + 0.0e0 AS raw_risk FROM verdicts)""",
    "build_events": """
  SELECT event_id // 20 AS build, event_id % 20 AS pos, msg AS line FROM event_logs""",
    "model_metrics": """
  SELECT p_partkey AS created_at, p_size / 50.0e0 AS accuracy, p_size / 60.0e0 AS f1_score,
    p_partkey * 10 AS test_samples, cast(p_size AS bigint) AS tp, cast(p_size + 1 AS bigint) AS tn,
    cast(p_size % 7 AS bigint) AS fp, cast(p_size % 5 AS bigint) AS fn FROM part""",
    "system_metrics": """
  SELECT c_custkey AS created_at, cast(floor(abs(c_acctbal)) AS bigint) AS successful_predictions,
    cast(c_nationkey AS bigint) AS failed_predictions, c_nationkey * 1.5e0 AS avg_prediction_time_ms FROM customer""",
    "prediction_analytics": """
  SELECT o_orderkey AS prediction_id, o_totalprice > 300000 AS predicted_anomaly,
    CASE o_orderstatus WHEN 'F' THEN true WHEN 'P' THEN false END AS actual_anomaly, o_orderdate AS predicted_at FROM orders""",
    "build_lines": "SELECT conv_id AS build, turn AS pos, text AS line FROM conversations",
}


def with_views(sql: str) -> str:
    """``sql`` with a WITH clause for the views it names, and for those these name."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _VIEWS:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(_VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
