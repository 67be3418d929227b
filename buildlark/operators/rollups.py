"""Roll-ups over stored predictions, alerts and metrics.

Each is one partial + final hash aggregate per table. Single-row results of several tables are
brought together by a union of aligned rows and one more aggregate, never by a cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlark.functions import scoring, times
from buildlark.functions.scoring import count_if, ratio
from buildlark.sources.tables import newer_than


def side_by_side(*singles: DataFrame) -> DataFrame:
    """One row holding the columns of several one-row DataFrames."""
    out = singles[0]
    for d in singles[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def analytics_summary(predictions: DataFrame, alerts: DataFrame, metrics: DataFrame) -> DataFrame:
    """Counts over predictions and alerts with the newest model's figures."""
    p = predictions.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        count_if(F.col("is_anomaly")).alias("total_anomalies"),
    )
    a = alerts.agg(F.count(F.lit(1)).alias("total_alerts"))
    newest = F.max_by(F.struct("accuracy", "f1_score", "test_samples"), "created_at")
    m = metrics.agg(newest.alias("m")).select(
        F.col("m.accuracy").alias("model_accuracy"),
        F.col("m.f1_score").alias("model_f1"),
        F.col("m.test_samples").cast("bigint").alias("test_samples"),
    )
    rate = F.col("total_anomalies") / F.greatest("total_predictions", F.lit(1)) * F.lit(100)
    return side_by_side(p, a, m).withColumn("anomaly_rate", rate)


def dashboard(alerts: DataFrame, metrics: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Recent alerts, unresolved criticals and the newest accuracy."""
    a = alerts.agg(
        count_if(times.within_days(F.col("created_at"), as_of, days)).alias("total_alerts"),
        count_if((F.col("severity") == "CRITICAL") & ~F.col("is_resolved")).alias("critical_issues"),
    )
    m = metrics.agg(F.max_by("accuracy", "created_at").alias("model_accuracy"))
    return side_by_side(a, m)


def weekday_trend(predictions: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Anomalies per weekday of the last ``days`` days, Monday to Sunday, zero-filled."""
    calendar = predictions.sparkSession.createDataFrame(
        [(i, d) for i, d in enumerate(times.WEEKDAYS)], "day_no int, date string"
    )
    recent = predictions.where(times.within_days(F.col("created_at"), as_of, days))
    counted = recent.groupBy(times.weekday(F.col("created_at")).alias("date")).agg(
        count_if(F.col("is_anomaly")).alias("count")
    )
    return (
        calendar.join(counted, "date", "left")
        .select("day_no", "date", F.coalesce("count", F.lit(0)).alias("count"))
        .orderBy("day_no")
    )


#: Days that the trends look back.
TREND_DAYS = 30


def accuracy_trend(verified: DataFrame, as_of: Column | None = None, days: int = TREND_DAYS) -> DataFrame:
    """Correct share per day; precision and recall from the verified rows.

    With ``as_of``, of the ``days`` days up to it; otherwise of all days.
    ``precision_ref`` and ``recall_ref`` are fixed multiples of the accuracy, kept for parity.
    """
    if as_of is not None:
        verified = newer_than(verified, "predicted_at", as_of, days)
    pred, actual = F.col("predicted_anomaly"), F.col("actual_anomaly")
    daily = verified.groupBy(times.day_key(F.col("predicted_at")).alias("day")).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        count_if(pred == actual).alias("correct_predictions"),
        count_if(pred & actual).alias("_tp"),
        count_if(pred & ~actual).alias("_fp"),
        count_if(~pred & actual).alias("_fn"),
    )
    acc = ratio(F.col("correct_predictions"), F.col("total_predictions"))
    return daily.select(
        "day",
        acc.alias("accuracy"),
        (acc * 1.05).alias("precision_ref"),
        (acc * 0.95).alias("recall_ref"),
        ratio(F.col("_tp"), F.col("_tp") + F.col("_fp")).alias("precision"),
        ratio(F.col("_tp"), F.col("_tp") + F.col("_fn")).alias("recall"),
        "total_predictions",
        "correct_predictions",
    ).orderBy("day")


def anomaly_rate_trend(predictions: DataFrame, as_of: Column | None = None, days: int = TREND_DAYS) -> DataFrame:
    """Share of anomalies per day; with ``as_of``, of the ``days`` days up to it, otherwise of all days."""
    if as_of is not None:
        predictions = newer_than(predictions, "created_at", as_of, days)
    daily = predictions.groupBy(times.day_key(F.col("created_at")).alias("day")).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        count_if(F.col("is_anomaly")).alias("anomalies_detected"),
    )
    rate = F.col("anomalies_detected") / F.col("total_predictions") * F.lit(100)
    return daily.withColumn("anomaly_rate", rate).orderBy("day")


def alert_effectiveness(alerts: DataFrame) -> DataFrame:
    """Resolution figures; the mean time covers every row with a resolution time."""
    micros = F.unix_micros(F.col("resolved_at").cast("timestamp")) - F.unix_micros(
        F.col("created_at").cast("timestamp")
    )
    # Summing whole microseconds keeps the mean independent of the order of the rows.
    agg = alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        count_if(F.col("is_resolved")).alias("resolved_alerts"),
        count_if(F.col("severity") == "CRITICAL").alias("critical_alerts"),
        F.sum(micros.cast("decimal(38,0)")).alias("_micros"),
        F.count(micros).alias("_timed"),
        count_if(F.col("alert_type") == "ANOMALY").alias("anomaly_alerts"),
        count_if(F.col("alert_type") == "FORECAST").alias("forecast_alerts"),
    )
    return agg.select(
        "total_alerts",
        "resolved_alerts",
        "critical_alerts",
        (ratio(F.col("resolved_alerts"), F.col("total_alerts")) * F.lit(100)).alias("resolution_rate"),
        ratio(F.col("_micros") , F.col("_timed") * F.lit(3_600_000_000)).alias("avg_resolution_time_hours"),
        "anomaly_alerts",
        "forecast_alerts",
    )


def system_health(metrics: DataFrame) -> DataFrame:
    """The newest system row with its success rate."""
    fields = [c for c in metrics.columns if c != "created_at"]
    row = metrics.agg(F.max_by(F.struct(*fields), "created_at").alias("r")).where("r IS NOT NULL").select("r.*")
    done, failed = F.col("successful_predictions"), F.col("failed_predictions")
    return row.withColumn("success_rate", ratio(done, done + failed) * F.lit(100))


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        *[count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "WARNING", "INFO")]
    )


def class_balance(rows: DataFrame, label: str = "is_anomaly") -> DataFrame:
    """Rows, share and balanced weight of each class."""
    by_class = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(1))  # one row per class from here on
    total, classes = F.sum("n").over(whole), F.count(F.lit(1)).over(whole)
    return by_class.select(
        label,
        "n",
        (F.lit(100.0) * F.col("n") / total).alias("percent"),
        (total / (classes * F.col("n"))).alias("class_weight"),
    )


def table_inventory(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row count, smallest key and the row that has it, as JSON; ``tables`` maps name to (table, key).

    Only the key is read of every row; the whole row is read where the key is the smallest. Of rows
    that share it the first in order of the JSON is shown. A table without rows has no sample.
    """
    rows = []
    for name, (df, key) in tables.items():
        first = df.where(F.col(key) == df.agg(F.min(F.col(key))).scalar())
        sample = first.agg(F.min(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))).scalar()
        counted = df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.col(key)).cast("string").alias("sample_key"))
        rows.append(counted.select(
            F.lit(name).alias("table_name"), "n_rows", "sample_key", sample.alias("sample_row")
        ))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def hourly_failures(events: DataFrame, series: str, ts: str, failed: Column) -> DataFrame:
    """Failures per hour and series from its first to its last hour, gaps filled with 0."""
    hour = F.date_trunc("hour", F.col(ts).cast("timestamp"))
    counted = events.groupBy(series, hour.alias("hour")).agg(count_if(failed).alias("failures"))
    span = counted.groupBy(series).agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    spine = span.select(series, F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("hour"))
    return spine.join(counted, [series, "hour"], "left").select(
        series, "hour", F.coalesce("failures", F.lit(0)).alias("failures")
    )


def batch_summary(parsed: DataFrame) -> DataFrame:
    return parsed.agg(
        F.count(F.lit(1)).alias("n_lines"), F.countDistinct("event_id").alias("n_unique_templates")
    )


def top_services(lines: DataFrame, service: str, top: int = 32) -> DataFrame:
    """Most frequent services, first seen wins ties; lines without one count as ``__NONE__``."""
    named = F.coalesce(F.col(service), F.lit("__NONE__"))
    counted = lines.groupBy(named.alias("service")).agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")
    )
    return counted.orderBy(F.desc("n"), "first_pos").limit(top)


def latest_run(rows: DataFrame, run: str = "training_run", by: str = "created_seq") -> DataFrame:
    """Rows of the newest run; the run id is one scalar, so the filter needs no join."""
    newest = rows.agg(F.max_by(run, by).alias("run")).scalar()
    return rows.where(F.col(run) == newest)


def best_of_run(rows: DataFrame, run: str = "training_run") -> DataFrame:
    """Flag the rows that reach the best f1 of their run."""
    best = rows.groupBy(run).agg(F.max("f1_score").alias("best_f1"))
    return rows.join(best, run).select("*", (F.col("f1_score") >= F.col("best_f1")).alias("is_best"))


def model_comparison(rows: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """The newest run's models, best first; missing figures count as 0."""
    run = latest_run(rows)
    best = run.agg(F.max("f1_score").alias("best_f1")).scalar()
    filled = [F.coalesce(c, F.lit(0.0)).alias(c) for c in columns]
    return run.select(
        F.col("model_name").alias("name"), "training_run", "created_seq", "f1_score", *filled,
        (F.col("f1_score") >= best).alias("is_best"),
    ).orderBy(F.desc("f1_score"), "created_seq")


def alerts_from_predictions(predictions: DataFrame) -> DataFrame:
    """One alert per prediction at MEDIUM or HIGH risk."""
    sev = scoring.alert_severity(F.col("risk_level"))
    return predictions.where(sev.isNotNull()).select(
        F.col("id").alias("prediction_id"),
        "pipeline_id",
        F.lit("ANOMALY").alias("alert_type"),
        sev.alias("severity"),
        scoring.recommendation(F.col("risk_level")).alias("message"),
        F.lit(False).alias("is_resolved"),
        "created_at",
    )
