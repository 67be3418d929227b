"""Declared schemas of the stored tables and of the payloads the jobs accept, as DDL text."""

from __future__ import annotations


# ---------------------------------------------------------------------------
# Table and payload layouts.
# ---------------------------------------------------------------------------
EXPLANATION = (
    "struct<model: string, base_value: double, features: array<struct<"
    "feature: string, shap_value: double, direction: string, tfidf: double>>>"
)

TABLES: dict[str, str] = {
    "training_data": (
        "id bigint, log_text string, is_anomaly boolean, created_at timestamp"
    ),
    "predictions": (
        "id bigint, pipeline_id string, log_snippet string, is_anomaly boolean, "
        "anomaly_score double, anomaly_confidence double, predicted_failures int, "
        "failure_upper_bound int, failure_lower_bound int, risk_level string, risk_score double, "
        f"recommendation string, shap_explanation {EXPLANATION}, created_at timestamp"
    ),
    "alerts": (
        "id bigint, prediction_id bigint, pipeline_id string, alert_type string, severity string, "
        "message string, is_resolved boolean, created_at timestamp, resolved_at timestamp"
    ),
    "model_metrics": (
        "id bigint, accuracy double, precision double, recall double, f1_score double, "
        "test_samples int, true_positives int, true_negatives int, false_positives int, "
        "false_negatives int, training_samples int, model_version string, created_at timestamp"
    ),
    "training_history": (
        "id bigint, model_version string, epoch int, accuracy double, precision double, "
        "recall double, f1_score double, train_loss double, val_loss double, learning_rate double, "
        "training_samples int, batch_size int, created_at timestamp"
    ),
    "prediction_analytics": (
        "id bigint, prediction_id bigint, pipeline_id string, predicted_anomaly boolean, "
        "actual_anomaly boolean, prediction_confidence double, false_positive boolean, "
        "false_negative boolean, predicted_at timestamp, verified_at timestamp"
    ),
    "system_metrics": (
        "id bigint, avg_prediction_time_ms double, avg_request_time_ms double, "
        "total_predictions int, successful_predictions int, failed_predictions int, "
        "db_size_mb double, db_query_time_ms double, alerts_generated int, critical_alerts int, "
        "created_at timestamp"
    ),
    "multi_model_metrics": (
        "id bigint, model_name string, training_run string, cv_f1_mean double, cv_f1_std double, "
        "cv_precision_mean double, cv_recall_mean double, cv_accuracy_mean double, "
        "accuracy double, precision double, recall double, f1_score double, roc_auc double, "
        "true_positives int, true_negatives int, false_positives int, false_negatives int, "
        "training_samples int, test_samples int, "
        "feature_importance struct<features: array<string>, importance: array<double>>, "
        "created_at timestamp"
    ),
    "builds": (
        "id bigint, job_name string, build_number bigint, status string, duration_ms bigint, "
        "build_url string, log_snippet string, is_demo boolean, predicted_failure boolean, "
        "prediction_confidence double, risk_level string, risk_score double, "
        "recommendation string, actual_failure boolean, prediction_correct boolean, "
        "build_timestamp timestamp, synced_at timestamp"
    ),
}

JOBS_PAYLOAD = (
    "jobs array<struct<name: string, color: string, lastBuild: struct<number: bigint, result: string>>>"
)
BUILDS_PAYLOAD = (
    "job_name string, builds array<struct<number: bigint, result: string, timestamp: bigint, "
    "duration: bigint, url: string>>"
)
BUILD_EVENT = (
    "job_name string, build_number bigint, status string, duration_ms bigint, timestamp string, "
    "url string, log string, demo boolean"
)

CONTRACTS: dict[str, str] = {
    "prediction_request": ("pipeline_id string NOT NULL, logs string"),
    "prediction_response": (
        "id bigint NOT NULL, pipeline_id string NOT NULL, risk_level string NOT NULL, "
        "anomaly_score double NOT NULL, predicted_failures int NOT NULL, created_at timestamp NOT NULL"
    ),
    "analytics_summary": (
        "total_predictions bigint NOT NULL, total_anomalies bigint NOT NULL, "
        "anomaly_rate double NOT NULL, total_alerts bigint NOT NULL, model_accuracy double NOT NULL, "
        "model_f1 double NOT NULL, test_samples bigint NOT NULL"
    ),
    "roc_curve": (
        "fpr array<double> NOT NULL, tpr array<double> NOT NULL, auc double NOT NULL, "
        "thresholds array<double> NOT NULL"
    ),
    "confusion_matrix": (
        "tp bigint NOT NULL, tn bigint NOT NULL, fp bigint NOT NULL, fn bigint NOT NULL, "
        "tpr double NOT NULL, fpr double NOT NULL, specificity double NOT NULL"
    ),
    "precision_recall": (
        "precision array<double> NOT NULL, recall array<double> NOT NULL, "
        "f1_scores array<double> NOT NULL, average_precision double NOT NULL"
    ),
    "feature_importance": (
        "features array<string> NOT NULL, importance array<double> NOT NULL"
    ),
    "model_version": (
        "version string NOT NULL, accuracy double NOT NULL, precision double NOT NULL, "
        "recall double NOT NULL, f1_score double NOT NULL"
    ),
    "anomaly_trend": ("date string NOT NULL, count bigint NOT NULL"),
    "dashboard_stats": (
        "total_alerts bigint NOT NULL, model_accuracy double NOT NULL, avg_lead_time string NOT NULL, "
        "critical_issues bigint NOT NULL, anomalies_trend array<struct<date: string, count: bigint>> NOT NULL"
    ),
    "alert_source": (
        "timestamp string NOT NULL, pipeline_id string NOT NULL, severity string NOT NULL, "
        "message string NOT NULL, is_resolved boolean NOT NULL"
    ),
    "metrics_response": (
        "accuracy double NOT NULL, precision double NOT NULL, recall double NOT NULL, "
        "f1_score double NOT NULL, test_samples bigint NOT NULL, true_positives bigint NOT NULL, "
        "false_positives bigint NOT NULL, model_version string NOT NULL, trained_at timestamp NOT NULL"
    ),
    "training_response": (
        "status string NOT NULL, message string NOT NULL, timestamp timestamp NOT NULL"
    ),
}
