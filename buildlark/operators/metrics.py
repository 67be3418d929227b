"""Classifier metrics from labels, predictions and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlark.functions.scoring import count_if, f1, ratio


def confusion_counts(label: Column, prediction: Column) -> dict[str, Column]:
    return {
        "tp": count_if((label == 1) & (prediction == 1)),
        "tn": count_if((label == 0) & (prediction == 0)),
        "fp": count_if((label == 0) & (prediction == 1)),
        "fn": count_if((label == 1) & (prediction == 0)),
    }


def with_rates(counts: DataFrame) -> DataFrame:
    """Add tpr, fpr and specificity to rows with tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.select(
        "*",
        ratio(tp, tp + fn).alias("tpr"),
        ratio(fp, fp + tn).alias("fpr"),
        ratio(tn, tn + fp).alias("specificity"),
    )


def with_scores(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall and f1 to rows with tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.select(
        "*",
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        p.alias("precision"),
        r.alias("recall"),
        f1(p, r).alias("f1_score"),
    )


def confusion(rows: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    cells = [c.alias(n) for n, c in confusion_counts(F.col(label), F.col(prediction)).items()]
    return with_rates(rows.groupBy(*by).agg(*cells))


def scores(rows: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    cells = [c.alias(n) for n, c in confusion_counts(F.col(label), F.col(prediction)).items()]
    return with_scores(rows.groupBy(*by).agg(*cells))


def cv_summary(folds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over folds and population deviation of f1."""
    return folds.groupBy(*by).agg(
        F.avg("f1_score").alias("cv_f1_mean"),
        F.stddev_pop("f1_score").alias("cv_f1_std"),
        F.avg("precision").alias("cv_precision_mean"),
        F.avg("recall").alias("cv_recall_mean"),
        F.avg("accuracy").alias("cv_accuracy_mean"),
    )


def classification_report(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, f1 and support per class, with macro and weighted means and accuracy."""
    hit = F.col(label) == F.col(prediction)
    # One row per (label, prediction) pair; everything after works on class-by-class cells.
    cells = rows.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"), F.first(hit).alias("hit"))
    as_label = cells.select(
        F.col(label).cast("string").alias("class"), F.col("n").alias("support"),
        F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("hit"), F.col("n")).otherwise(0).alias("right"),
    )
    as_prediction = cells.select(
        F.col(prediction).cast("string").alias("class"), F.lit(0).cast("bigint").alias("support"),
        F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("right"),
    )
    per_class = (
        as_label.unionByName(as_prediction).groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("right").alias("right"))
    )
    p, r = ratio(F.col("right"), F.col("predicted")), ratio(F.col("right"), F.col("support"))
    per_class = per_class.select(
        "class", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1_score"), "support", "right"
    )
    names = ("precision", "recall", "f1_score")
    macro = per_class.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = per_class.agg(
        *[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names],
        F.sum("support").alias("support"),
    )
    acc = ratio(F.sum("right"), F.sum("support"))
    accuracy = per_class.agg(*[acc.alias(c) for c in names], F.sum("support").alias("support"))
    out = per_class.select("class", *names, "support")
    for title, row in (("macro avg", macro), ("weighted avg", weighted), ("accuracy", accuracy)):
        out = out.unionByName(row.select(F.lit(title).alias("class"), *names, "support"))
    return out


def enough(df: DataFrame, group: Sequence[str], n: int) -> DataFrame:
    """Keep the groups with at least ``n`` rows; an empty result stands for "too few"."""
    sized = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).drop("_n")
    return df.join(sized, list(group), "left_semi")


def min_max(df: DataFrame, col: str, out: str, scale: float = 1.0, constant: float = 0.5) -> DataFrame:
    """Scale ``col`` to 0..scale over the whole table; ``constant`` if all values are equal."""
    lo = df.agg(F.min(col)).scalar()
    hi = df.agg(F.max(col)).scalar()
    spread = F.lit(scale) * (F.col(col) - lo) / (hi - lo)
    return df.withColumn(out, F.when(hi > lo, spread).otherwise(F.lit(constant)))


def importance_percent(df: DataFrame, col: str = "importance") -> DataFrame:
    """Importances scaled to 0..100, highest first."""
    return min_max(df, col, "importance_pct", 100.0, 50.0).orderBy(F.desc("importance_pct"), "feature")
