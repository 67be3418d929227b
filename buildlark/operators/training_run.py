"""One training run: split, train, evaluate, and rows for the metrics tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlark.functions import logtext, times
from buildlark.operators import models
from buildlark.operators import sequence_model as SM
from buildlark.operators import tables
from buildlark.operators.boosting import each
from buildlark.session import settle

SEQUENCE = "Sequence"


@dataclass
class Run:
    classifier: models.Classifier
    multi_model_metrics: DataFrame
    model_metrics: DataFrame
    training_history: DataFrame
    build_model: SM.SequenceModel | None = None


def join_cv(test: DataFrame, cv: DataFrame, by: tuple[str, ...] = ("model_name",)) -> DataFrame:
    """Held-out figures with the cross-validation figures; NULL where a model has none."""
    return test.join(cv, list(by), "left")


def _numbered(order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model_name")).cast("int")


def train_models(
    rows: DataFrame,
    at: Column,
    settings: models.Settings | None = None,
    build_lines: DataFrame | None = None,
    build_labels: DataFrame | None = None,
    root: str | None = None,
) -> Run | None:
    """Train on four fifths of rows (id, log_text, is_anomaly), evaluate on the rest.

    With ``root`` the metrics rows are appended to the stored tables. ``at`` is the run's time.
    """
    # Read once by every step of the run, so it is dealt once.
    dealt = settle(models.stratified(rows, "is_anomaly", "id", 7, "_part"), "dealt")
    fit, held = dealt.where("_part <> 0").drop("_part"), dealt.where("_part = 0").drop("_part")
    n_fit, n_held = fit.count(), held.count()
    if n_fit < models.MIN_SAMPLES:
        return None
    run_id = times.run_id(at)

    def of_lines() -> tuple[models.Classifier, DataFrame]:
        fitted = models.train(fit, settings=settings)
        return fitted, models.evaluate(fitted, held)

    def of_builds() -> tuple | None:
        return None if build_lines is None else _sequence_model(build_lines, build_labels, run_id, at)

    # The model of builds needs nothing of the others.
    (clf, test), sequence = each([of_lines, of_builds], lambda fn: fn(), 2)
    top = models.feature_importance(clf)
    per_model = join_cv(test, clf.cv).select(
        "model_name", run_id.alias("training_run"),
        "cv_f1_mean", "cv_f1_std", "cv_precision_mean", "cv_recall_mean", "cv_accuracy_mean",
        "accuracy", "precision", "recall", "f1_score", "roc_auc",
        F.col("tp").alias("true_positives"), F.col("tn").alias("true_negatives"),
        F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"),
        F.lit(n_fit).alias("training_samples"), F.lit(n_held).alias("test_samples"), at.alias("created_at"),
    )
    if top is not None:
        # At most twenty rows: the report's feature list.
        listed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("o"), "idx", "feature", "importance"))).alias("t"))
        fi = listed.select(F.lit(models.RF).alias("model_name"), F.struct(
            F.transform("t", lambda x: x["feature"]).alias("features"),
            F.transform("t", lambda x: x["importance"]).alias("importance")).alias("feature_importance"))
        per_model = per_model.join(fi, "model_name", "left")
    per_model = settle(per_model, "figures")
    best = per_model.where(F.col("model_name") == clf.best).withColumn("model_version", F.col("training_run"))
    version = F.concat_ws("_", "training_run", logtext.slug(F.col("model_name")))
    history = per_model.select(
        version.alias("model_version"), _numbered(models.MODEL_ORDER).alias("epoch"),
        "accuracy", "precision", "recall", "f1_score",
        (1 - F.coalesce("cv_f1_mean", F.lit(0.0))).alias("train_loss"), (1 - F.col("f1_score")).alias("val_loss"),
        F.lit(0.001).alias("learning_rate"), "training_samples", F.lit(256).alias("batch_size"), "created_at",
    )
    out = Run(clf, per_model, best, history)
    if sequence is not None:
        out.build_model, row, curve = sequence
        out.multi_model_metrics = out.multi_model_metrics.unionByName(row, allowMissingColumns=True)
        out.training_history = out.training_history.unionByName(curve, allowMissingColumns=True)
    if root is not None:
        for name in ("multi_model_metrics", "model_metrics", "training_history"):
            keyed = getattr(out, name)
            tables.append(keyed, root, name)
    return out


def _sequence_model(lines: DataFrame, labels: DataFrame, run_id: Column, at: Column) -> tuple[SM.SequenceModel, DataFrame, DataFrame] | None:
    """The model of builds, its row of figures and its rows of history; None with too few builds."""
    dealt = settle(models.stratified(labels, "label", "build", 11, "_part"), "builds-dealt")
    fit, held = dealt.where("_part <> 0").drop("_part"), dealt.where("_part = 0").drop("_part")
    fitted = SM.train(lines, fit)
    if fitted is None:
        return None
    n_fit, n_held = fit.count(), held.count()
    curve = fitted.curve.select(
        F.concat(run_id, F.format_string("_sequence_ep%02d", "epoch")).alias("model_version"), "epoch",
        "accuracy", "precision", "recall", "f1_score", "train_loss", "val_loss", "learning_rate",
        F.lit(n_fit).alias("training_samples"), F.lit(SM.BATCH_SIZE).alias("batch_size"), at.alias("created_at"),
    )
    row = SM.evaluate(fitted, lines.join(held.select("build"), "build", "left_semi"), held).select(
        F.lit(SEQUENCE).alias("model_name"), run_id.alias("training_run"),
        "accuracy", "precision", "recall", "f1_score", "roc_auc",
        F.col("tp").alias("true_positives"), F.col("tn").alias("true_negatives"),
        F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"),
        F.lit(n_fit).alias("training_samples"), F.lit(n_held).alias("test_samples"), at.alias("created_at"),
    )
    return fitted, settle(row, "build-figures"), curve
