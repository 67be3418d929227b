"""Boosted trees grown for all folds in shared passes, next to Spark's own fits."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, SparseVector
from pyspark.sql import functions as F

from buildlark.operators import boosting, models

OUT = [None, 0, 2]


def table(spark, n=600, size=12, dense=False):
    """Rows whose label hangs on several features and on chance; the last feature is the same everywhere."""
    rng, rows = np.random.default_rng(3), []
    for i in range(n):
        cols = sorted(rng.choice(size - 2, rng.integers(0, 6), replace=False).tolist())
        vals = [float(v) for v in (rng.integers(-2, 3, len(cols)) if i % 2 else rng.normal(0, 1, len(cols)))]
        x = SparseVector(size, [*cols, size - 1], [*vals, 1.5])
        y = int((vals[0] if vals else 0.3) + (0.8 if 4 in cols else 0.0) + rng.normal(0, 0.5) > 0.4)
        rows.append((i, y, i % 5, DenseVector(x.toArray()) if dense and i % 3 else x))
    return spark.createDataFrame(rows, ["id", "label", "fold", "features"]).withColumn(
        "label", F.col("label").cast("int")).withColumn("fold", F.col("fold").cast("int")).repartition(3).cache()


def raw(model, rows):
    return dict(model.transform(rows).select("id", vector_to_array("rawPrediction")[1]).collect())


@pytest.mark.parametrize("dense", [False, True])
def test_equals_sparks_fit(spark, dense):
    rows = table(spark, dense=dense)
    got = boosting.fit(rows, OUT, rounds=6, depth=4, step=0.1, seed=42)
    for out, model in zip(OUT, got):
        own = rows if out is None else rows.where(F.col("fold") != out)
        want = GBTClassifier(maxIter=6, maxDepth=4, stepSize=0.1, seed=42).fit(own)
        a, b = raw(model, own), raw(want, own)  # rows held out may differ where splits tie on the own ones
        assert len(a) == own.count() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in b)
        assert model.treeWeights == want.treeWeights and model.numFeatures == want.numFeatures == 12
        assert model.getMaxDepth() == 4 and model.getMaxIter() == 6 and model.getStepSize() == 0.1
        assert model.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=0.02)


def test_small_blocks_and_bounds_give_the_same_trees(spark, monkeypatch):
    rows = table(spark)
    want = [raw(m, rows) for m in boosting.fit(rows, OUT, 4, 4, 0.1, 42)]
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    monkeypatch.setattr(boosting, "BLOCK_CELLS", 90)
    monkeypatch.setattr(boosting, "PASS_BINS", 1)
    monkeypatch.setattr(boosting, "HELD_BINS", 0)
    monkeypatch.setattr(boosting, "PARTIAL", 2)
    for got, old in zip(boosting.fit(rows, OUT, 4, 4, 0.1, 42), want):
        assert raw(got, rows) == pytest.approx(old, abs=1e-9)


def test_all_folds_share_the_passes(spark, monkeypatch):
    """The passes do not grow with the folds: a level of a round is one pass for all fits."""
    rows, passes, ask = table(spark), [], boosting.Rows.ask
    monkeypatch.setattr(boosting.Rows, "ask", lambda self, asked: passes.append(len(asked)) or ask(self, asked))
    s = models.Settings(models=(models.GBT,), gbt_rounds=3, gbt_depth=2)
    figures, fitted = models.fit_all(rows, s.models, s)
    assert len(passes) == 3 * 2 and max(passes) == models.FOLDS + 1
    assert sorted((r.model_name, r.fold) for r in figures.collect()) == [(models.GBT, k) for k in range(models.FOLDS)]
    assert fitted[models.GBT].getNumTrees == 3


def test_margins_are_kept_and_checkpoints_go(spark, monkeypatch):
    rows = table(spark, 200)
    plain = raw(boosting.fit(rows, [None], 7, 2, 0.1, 42)[0], rows)
    monkeypatch.setattr(boosting, "CHECKPOINT_EVERY", 2)
    deleted, delete = [], boosting.Rows._delete
    monkeypatch.setattr(boosting.Rows, "_delete", lambda self, file: deleted.append(file) or delete(self, file))
    assert raw(boosting.fit(rows, [None], 7, 2, 0.1, 42)[0], rows) == pytest.approx(plain, abs=1e-12)
    assert len(deleted) == 3 and not any(Path(f.removeprefix("file:")).exists() for f in deleted)


def test_nothing_to_split(spark):
    """One class, and no feature that differs: a tree is one leaf, where Spark may still split what is rounding."""
    one = table(spark, 60).withColumn("label", F.lit(1))
    flat = table(spark, 60).withColumn("features", F.lit(None)).drop("features").crossJoin(spark.createDataFrame([(SparseVector(3, [1], [2.0]),)], ["features"]))
    for rows in (one, flat):
        got = boosting.fit(rows, [None], 3, 3, 0.1, 42)[0]
        want = GBTClassifier(maxIter=3, maxDepth=3, stepSize=0.1, seed=42).fit(rows)
        assert got.totalNumNodes == 3
        assert raw(got, rows) == pytest.approx(raw(want, rows), abs=1e-12)


def test_labels_must_be_told(spark):
    rows = table(spark, 60)
    for bad in (F.lit(2), F.when(F.col("id") > 5, 1)):
        with pytest.raises(ValueError, match="labels"):
            boosting.fit(rows.withColumn("label", bad), [None], 2, 2, 0.1, 42)


def test_thresholds():
    assert boosting.thresholds(np.array([]), np.array([]), 10).tolist() == []
    assert boosting.thresholds(np.array([2.0]), np.array([10]), 10).tolist() == []
    assert boosting.thresholds(np.array([3.0, -1.0]), np.array([2, 3]), 10).tolist() == [-0.5, 1.5]
    many = boosting.thresholds(np.arange(1.0, 1001.0), np.ones(1000, int), 1000)
    assert len(many) == 31 and many[0] == pytest.approx(1000 / 32, abs=1) and all(math.isclose(v % 1, 0.5) for v in many)
