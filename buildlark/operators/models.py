"""Line classifiers on Spark ML: split, cross-validate, train, evaluate, score, store."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassificationModel,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from buildlark.functions import logtext, scoring
from buildlark.operators import boosting
from buildlark.operators import features as FT
from buildlark.operators import metrics as M
from buildlark.operators import templates as TM
from buildlark.operators.boosting import each
from buildlark.operators.curves import auc
from buildlark.operators.ordering import hash_order, number_rows
from buildlark.session import settle

# Model names in the order that breaks ties, and training limits.
LR, RF, GBT = "Logistic Regression", "Random Forest", "Gradient Boosted Trees"
MODEL_ORDER = (LR, RF, GBT)
MIN_SAMPLES = 50
FOLDS = 5
SEED = 42
SLOW_FIRST = (GBT, RF, LR)  # by the length of a fit
FIGURES = "model_name string, fold int, accuracy double, precision double, recall double, f1_score double"


@dataclass
class Settings:
    """Estimator parameters; the defaults are the published ones where Spark allows them."""

    models: tuple[str, ...] = MODEL_ORDER
    lr_c: float = 1.0
    lr_iterations: int = 1000
    rf_trees: int = 200
    rf_depth: int = 12
    gbt_rounds: int = 200
    gbt_depth: int = 6
    gbt_step: float = 0.1
    use_templates: bool = True
    max_terms: int = FT.MAX_TERMS
    parallelism: int = FOLDS + 1  # fits running side by side: a model's folds and its fit on all rows


@dataclass
class Classifier:
    """Fitted feature space and models."""

    space: FT.FeatureSpace
    models: dict[str, Model]
    best: str
    templates: DataFrame | None = None
    branches: DataFrame | None = None
    cv: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)
    folds: DataFrame | None = None


def stratified(rows: DataFrame, label: str, key: str, seed: int, out: str, parts: int = FOLDS) -> DataFrame:
    """Deal the rows of each class in hash order to ``parts`` parts of equal size, 0..parts-1.

    A class may be most of the table; ranks are counted per hash bucket, not per class.
    """
    keyed = hash_order(rows, [F.col(key)], seed)
    ranked = number_rows(keyed, [label], "_hash_bucket", [F.col("_hash"), F.col(key)], "_rank")
    part = ((F.col("_rank") - 1) % parts).cast("int")
    return ranked.withColumn(out, part).drop("_hash", "_hash_bucket", "_rank")


def best_model(cv: DataFrame, order=MODEL_ORDER) -> DataFrame:
    """The model with the highest mean f1; the earlier one in ``order`` on a tie."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model_name"))
    known = F.when(place > 0, place).otherwise(len(order) + 1)
    return cv.orderBy(F.desc("cv_f1_mean"), known, "model_name").limit(1)


# ---------------------------------------------------------------------------
# Features of labelled or new lines
# ---------------------------------------------------------------------------
def _described(lines: DataFrame, text: str, template: Column) -> DataFrame:
    """Add service, level and the numeric features to lines that know their template."""
    line = F.col(text)
    params = logtext.parameters(F.split(template, " "), F.split("masked", " "))
    out = lines.withColumn("log_level", logtext.level(line)).withColumn("service", logtext.service(line))
    out = out.withColumn("_params", F.coalesce(params, F.array().cast("array<string>")))
    ts = logtext.timestamp(line)
    nums = logtext.numeric_features(line, F.col("log_level"), F.col("_params"), ts)
    return out.select("*", *[c.alias(n) for n, c in nums.items()]).drop("_params")


def fit_features(train: DataFrame, text: str, settings: Settings) -> tuple[FT.FeatureSpace, DataFrame | None, DataFrame | None]:
    """Vocabulary, templates and slots of the training lines (id unique, text)."""
    if not settings.use_templates:
        return FT.feature_space(train, text, None, settings.max_terms), None, None
    lines = train.select(F.col("id").alias("pos"), F.col(text).alias("raw"))
    mined = TM.mine(lines, carry=["raw"])
    parsed = mined.lines.select("pos", "event_id", logtext.service(F.col("raw")).alias("service"))
    slot_table = settle(FT.slots(parsed), "slots")
    space = FT.feature_space(train, text, slot_table, settings.max_terms)
    return space, mined.templates, mined.branches


def featurise(rows: DataFrame, text: str, clf: Classifier) -> DataFrame:
    """Add ``features``; lines of unseen templates take the OTHER slot."""
    if not clf.settings.use_templates:
        return FT.vectors(rows, text, clf.space)
    masked = rows.withColumn("masked", TM.masked_line(F.col(text)))
    with_event = TM.assign(masked, clf.templates, clf.branches, unseen=FT.OTHER)
    # Templates can be many on free text: no hint, Spark broadcasts them only if they are small.
    named = with_event.join(clf.templates.select("event_id", "template"), "event_id", "left")
    described = _described(named, text, F.col("template"))
    out = FT.vectors(described, text, clf.space)
    return out.select(*rows.columns, "features")


# ---------------------------------------------------------------------------
# Training
# ---------------------------------------------------------------------------
def _estimator(name: str, s: Settings, n: int):
    if name == LR:
        return LogisticRegression(
            maxIter=s.lr_iterations, regParam=1.0 / (s.lr_c * n), standardization=False, weightCol="weight"
        )
    if name == RF:
        return RandomForestClassifier(
            numTrees=s.rf_trees, maxDepth=s.rf_depth, featureSubsetStrategy="sqrt", seed=SEED, weightCol="weight"
        )
    raise ValueError(f"no estimator of its own: {name}")


def _weighted(rows: DataFrame) -> tuple[DataFrame, int]:
    """Add balanced class weights n / (2 n_class)."""
    pos, n = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
    n_pos, n_neg = int(pos or 0), int(n - (pos or 0))
    w = F.when(F.col("label") == 1, n / (2.0 * max(n_pos, 1))).otherwise(n / (2.0 * max(n_neg, 1)))
    return rows.withColumn("weight", w), n


def _fit(name: str, rows: DataFrame, s: Settings) -> Model:
    weighted, n = _weighted(rows)
    return _estimator(name, s, n).fit(weighted)


def predictions(model: Model, rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, label, prediction, p1) of a model."""
    out = model.transform(rows)
    return out.select(
        *keep, "label", F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("p1"),
    )


def _held_out(model: Model, rows: DataFrame, name: str, k: int) -> Row:
    """The figures of a model that was fitted without fold ``k`` on that fold, one row."""
    held = predictions(model, rows.where(F.col("fold") == k))
    return M.scores(held, "label", "prediction").select(
        F.lit(name).alias("model_name"), F.lit(k).alias("fold"), "accuracy", "precision", "recall", "f1_score"
    ).first()


def fit_all(rows: DataFrame, names, s: Settings, folds: int = FOLDS, whole: bool = True) -> tuple[DataFrame, dict[str, Model]]:
    """Figures of every model on each fold, and with ``whole`` the models fitted on all rows.

    No fit waits for another: all are put into one queue, those of many short jobs first. The boosted trees of
    all folds and of the whole table are grown together, in shared passes over the rows.
    """
    left_out = [*[None] * whole, *range(folds)]
    slow_first = sorted(names, key=lambda name: SLOW_FIRST.index(name) if name in SLOW_FIRST else len(SLOW_FIRST))
    tasks = [(name, some) for name in slow_first for some in ([left_out] if name == GBT else [[k] for k in left_out])]

    def work(task: tuple[str, list[int | None]]) -> list[tuple]:
        name, some = task
        if name == GBT:
            fitted = boosting.fit(rows, some, s.gbt_rounds, s.gbt_depth, s.gbt_step, SEED)
        else:
            fitted = [_fit(name, rows if k is None else rows.where(F.col("fold") != k), s) for k in some]
        told = each(list(zip(fitted, some)), lambda m: m[0] if m[1] is None else _held_out(m[0], rows, name, m[1]), s.parallelism)
        return [((name, k), got) for k, got in zip(some, told)]

    done = dict(pair for out in each(tasks, work, s.parallelism) for pair in out)
    figures = [done[name, k] for name in names for k in range(folds)]
    return rows.sparkSession.createDataFrame(figures, FIGURES), {name: done[name, None] for name in names if whole}


def cross_validate(rows: DataFrame, names, s: Settings, folds: int = FOLDS) -> DataFrame:
    """(model_name, fold, accuracy, precision, recall, f1_score) over stratified folds."""
    return fit_all(rows, names, s, folds, whole=False)[0]


def train(rows: DataFrame, text: str = "log_text", settings: Settings | None = None) -> Classifier | None:
    """Fit features and all models on rows (id, text, is_anomaly); None below 50 rows."""
    s = settings or Settings()
    if rows.limit(MIN_SAMPLES).count() < MIN_SAMPLES:
        return None
    labelled = rows.withColumn("label", F.col("is_anomaly").cast("int"))
    space, templates, branches = fit_features(labelled, text, s)
    clf = Classifier(space, {}, "", templates, branches, None, s)
    dealt = stratified(labelled, "label", "id", SEED, "fold")
    # Every fit reads the vectors again, so they are written once.
    ready = settle(featurise(dealt, text, clf).select("id", "label", "fold", "features"), "vectors")
    figures, clf.models = fit_all(ready, s.models, s)
    clf.folds = settle(figures, "folds")
    clf.cv = M.cv_summary(clf.folds, ["model_name"])
    clf.best = best_model(clf.cv).first()["model_name"]
    return clf


def evaluate(clf: Classifier, rows: DataFrame, text: str = "log_text") -> DataFrame:
    """Held-out metrics of every model: confusion cells, scores and ROC AUC."""
    labelled = rows.withColumn("label", F.col("is_anomaly").cast("int"))
    ready = settle(featurise(labelled, text, clf).select("id", "label", "features"), "test-vectors")

    def of_model(name: str) -> DataFrame:
        p = settle(predictions(clf.models[name], ready, "id"), "predictions")
        score = M.scores(p, "label", "prediction")
        area = auc(p, "label", "p1").scalar()
        return settle(score.select(F.lit(name).alias("model_name"), "*", area.alias("roc_auc")), "held-out")

    return reduce(DataFrame.unionByName, each(list(clf.models), of_model, clf.settings.parallelism))


def score(clf: Classifier | None, rows: DataFrame, text: str = "log_text") -> DataFrame:
    """Add is_anomaly, anomaly_score, confidence, reason and model_used.

    Input columns of these names, such as a label, are replaced. Without a classifier the keyword
    rule judges.
    """
    rows = rows.drop(*scoring.VERDICT)
    if clf is None:
        return scoring.keyword_verdict(rows, text).drop("n_matches")
    label = "TF-IDF + templates" if clf.settings.use_templates else "TF-IDF"
    out = clf.models[clf.best].transform(featurise(rows, text, clf))
    p1 = vector_to_array("probability")[1]
    p0 = vector_to_array("probability")[0]
    hit = F.col("prediction") == 1
    return out.select(
        *rows.columns, "features",
        hit.alias("is_anomaly"),
        (p1 - p0).alias("anomaly_score"),
        F.when(hit, p1).otherwise(p0).alias("confidence"),
        F.lit(f"Classified by {clf.best} ({label})").alias("reason"),
        F.lit(clf.best).alias("model_used"),
    )


def feature_importance(clf: Classifier, top_n: int = 20) -> DataFrame | None:
    """(feature, idx, importance) of the forest, highest first; None without a forest."""
    forest = clf.models.get(RF)
    if forest is None:
        return None
    spark = SparkSession.getActiveSession()
    v = forest.featureImportances  # one number per column of the feature space
    by_index = spark.createDataFrame(
        [(int(i), float(x)) for i, x in zip(v.indices, v.values)], "idx int, importance double"
    )
    names = spark.createDataFrame(list(enumerate(clf.space.names)), "idx int, feature string")
    return names.join(by_index, "idx", "left").select(
        "feature", "idx", F.coalesce("importance", F.lit(0.0)).alias("importance")
    ).orderBy(F.desc("importance"), "idx").limit(top_n)


# ---------------------------------------------------------------------------
# Storing
# ---------------------------------------------------------------------------
_READERS = {LR: LogisticRegressionModel, RF: RandomForestClassificationModel, GBT: GBTClassificationModel}


def _file_name(name: str) -> str:
    return name.lower().replace(" ", "_")


def save(clf: Classifier, path: str) -> None:
    """Write models, feature space, templates and figures below ``path``."""
    spark = SparkSession.getActiveSession()
    for name, model in clf.models.items():
        model.write().overwrite().save(f"{path}/models/{_file_name(name)}")
    words = [(i, w, float(x)) for i, (w, x) in enumerate(zip(clf.space.terms, clf.space.idf))]
    spark.createDataFrame(words, "idx int, term string, idf double").write.mode("overwrite").parquet(f"{path}/terms")
    names = spark.createDataFrame(list(enumerate(clf.space.names)), "idx int, name string")
    names.write.mode("overwrite").parquet(f"{path}/names")
    for part, df in (("slots", clf.space.slots), ("templates", clf.templates), ("branches", clf.branches), ("cv", clf.cv)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{part}")
    about = json.dumps({"best": clf.best, "models": list(clf.models), "settings": vars(clf.settings) | {"models": list(clf.settings.models)}})
    spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(path: str) -> Classifier:
    """Read a stored classifier; one without templates comes back as TF-IDF only."""
    spark = SparkSession.getActiveSession()
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    saved = about.get("settings", {})
    s = Settings(**{k: tuple(v) if k == "models" else v for k, v in saved.items()})

    def part(name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{path}/{name}")
        except Exception as exc:  # noqa: BLE001 - older bundles lack some parts
            if "PATH_NOT_FOUND" in str(exc):
                return None
            raise

    words = part("terms").orderBy("idx").collect()
    names = [r["name"] for r in part("names").orderBy("idx").collect()]
    templates = part("templates")
    s.use_templates = s.use_templates and templates is not None
    space = FT.FeatureSpace([r.term for r in words], [r.idf for r in words], names, part("slots") if s.use_templates else None)
    models = {n: _READERS[n].load(f"{path}/models/{_file_name(n)}") for n in about["models"]}
    return Classifier(space, models, about["best"], templates, part("branches"), part("cv"), s)
