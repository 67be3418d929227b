"""Verdict, risk and scaling expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlark.functions import logtext

# ---------------------------------------------------------------------------
# Weights, limits and texts that define the results.
# ---------------------------------------------------------------------------
CONFIDENCE_WEIGHT = 0.6
FORECAST_WEIGHT = 0.4
FORECAST_LIMIT = 3
HIGH_ABOVE = 0.7
MEDIUM_ABOVE = 0.4
RECOMMENDATIONS = {
    "HIGH": "🔴 КРИТИЧНО: виявлено аномалію та високий прогноз збоїв. Негайно перевірте логи!",
    "MEDIUM": "🟡 УВАГА: виявлено підвищений ризик. Уважно стежте.",
    "LOW": "🟢 OK: система працює нормально.",
}
SNIPPET_CHARS = 500
BUILD_LOG_CHARS = 2000
CONSOLE_TAIL_CHARS = 2048
# ---------------------------------------------------------------------------


#: Columns of a verdict.
VERDICT = ("is_anomaly", "anomaly_score", "confidence", "reason", "model_used")


def keyword_verdict(df: DataFrame, text: str) -> DataFrame:
    """Add the verdict of the rule used while no model is trained.

    Adds n_matches, is_anomaly, anomaly_score, confidence, reason and model_used; input columns of
    these names are replaced.
    """
    df = df.drop("n_matches", *VERDICT)
    counted = logtext.count_error_matches(df, text)
    n = F.col("n_matches")
    hit = n > 0
    return counted.select(
        "*",
        hit.alias("is_anomaly"),
        F.when(hit, n * F.lit(-0.5)).otherwise(F.lit(0.0)).alias("anomaly_score"),
        F.when(hit, F.least(F.lit(0.9), F.lit(0.5) + F.lit(0.1) * n))
        .otherwise(F.lit(0.85))
        .alias("confidence"),
        F.concat(
            F.lit("Keyword fallback — "), n.cast("string"), F.lit(" error pattern(s) matched")
        ).alias("reason"),
        F.lit("keyword_fallback").alias("model_used"),
    )


def raw_risk(
    confidence: Column, predicted_failures: Column, is_anomaly: Column | None = None
) -> Column:
    """Unrounded risk score.

    By default the confidence counts whatever the verdict was, so a confidently clean line
    gets MEDIUM. Pass ``is_anomaly`` to count confidence only for anomalous lines.
    """
    base = F.coalesce(confidence, F.lit(0.0)) * F.lit(CONFIDENCE_WEIGHT)
    if is_anomaly is not None:
        base = F.when(F.coalesce(is_anomaly, F.lit(False)), base).otherwise(F.lit(0.0))
    extra = F.when(predicted_failures > FORECAST_LIMIT, F.lit(FORECAST_WEIGHT)).otherwise(F.lit(0.0))
    return base + extra


def risk_level(raw: Column) -> Column:
    return (
        F.when(raw > HIGH_ABOVE, F.lit("HIGH"))
        .when(raw > MEDIUM_ABOVE, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def recommendation(risk: Column) -> Column:
    out = None
    for name, text in RECOMMENDATIONS.items():
        out = F.when(risk == name, F.lit(text)) if out is None else out.when(risk == name, F.lit(text))
    return out


def alert_severity(risk: Column) -> Column:
    """CRITICAL for HIGH, WARNING for MEDIUM, NULL (no alert) otherwise."""
    return F.when(risk == "HIGH", F.lit("CRITICAL")).when(risk == "MEDIUM", F.lit("WARNING"))


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(F.lit(2.0) * precision * recall, precision + recall)


def above(score: Column, threshold: float = 0.5) -> Column:
    return F.when(score > threshold, 1).otherwise(0)


def count_if(cond: Column) -> Column:
    """Rows where the condition holds; NULL counts as no."""
    return F.count_if(F.coalesce(cond, F.lit(False)))
