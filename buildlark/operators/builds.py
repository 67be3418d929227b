"""Derivations and roll-ups over builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlark.functions import times
from buildlark.functions.scoring import count_if, ratio


def actual_failure(status: Column) -> Column:
    """Everything finished other than SUCCESS is a failure."""
    return ~status.isin("SUCCESS", "IN_PROGRESS")


def prediction_correct(status: Column, predicted: Column) -> Column:
    """Whether the prediction held; NULL while the build runs."""
    return F.when(status != "IN_PROGRESS", predicted == actual_failure(status))


def judged(builds: DataFrame) -> DataFrame:
    status, predicted = F.col("status"), F.col("predicted_failure")
    return builds.withColumn("actual_failure", actual_failure(status)).withColumn(
        "prediction_correct", prediction_correct(status, predicted)
    )


def _counts() -> dict[str, Column]:
    actual, predicted = F.col("actual_failure"), F.col("predicted_failure")
    no_actual = ~F.coalesce(actual, F.lit(False))
    no_predicted = ~F.coalesce(predicted, F.lit(False))
    return {
        "total_builds": F.count(F.lit(1)),
        "actual_failures": count_if(actual),
        "predicted_failures": count_if(predicted),
        "correct_predictions": count_if(F.col("prediction_correct")),
        "false_positives": count_if(predicted & no_actual),
        "false_negatives": count_if(no_predicted & actual),
    }


def comparison(builds: DataFrame, job_name: str | None = None) -> DataFrame:
    """Predicted against actual failures per job, over finished builds."""
    rows = builds.where(F.col("status") != "IN_PROGRESS")
    if job_name is not None:
        rows = rows.where(F.col("job_name") == job_name)
    per_job = rows.groupBy("job_name").agg(*[c.alias(n) for n, c in _counts().items()])
    acc = ratio(F.col("correct_predictions"), F.col("total_builds"))
    return per_job.withColumn("accuracy", F.round(acc, 3))


def overview(builds: DataFrame) -> DataFrame:
    """Key figures over all builds, running ones included in the total."""
    c = _counts()
    agg = builds.agg(
        *[c[n].alias(n) for n in ("total_builds", "actual_failures", "predicted_failures", "correct_predictions")],
        count_if(F.col("risk_level") == "HIGH").alias("high_risk_builds"),
    )
    acc = ratio(F.col("correct_predictions"), F.col("total_builds"))
    return agg.withColumn("overall_accuracy", F.round(acc, 3))


def history(builds: DataFrame, job_name: str | None = None, limit: int = 50) -> DataFrame:
    """Newest builds first, unknown times before all others."""
    rows = builds if job_name is None else builds.where(F.col("job_name") == job_name)
    return rows.orderBy(F.desc_nulls_first("build_timestamp"), "job_name", "build_number").limit(limit)


def as_document(builds: DataFrame) -> DataFrame:
    """Rows with ISO time stamps, ready to be served."""
    for c, t in builds.dtypes:
        if t.startswith("timestamp"):
            builds = builds.withColumn(c, times.iso(F.col(c)))
    return builds


def as_json(rows: DataFrame, *keys: str) -> DataFrame:
    """Each row as one JSON document, NULL fields kept."""
    doc = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return as_document(rows).select(*keys, doc.alias("payload"))
