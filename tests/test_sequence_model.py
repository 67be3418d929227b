"""The build classifier that is trained by epochs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from buildlark.operators import sequence_model as sm


def cells(rows):
    ids = [[line + [0] * (sm.S.MAX_TOKENS - len(line)) for line in r] + [[0] * sm.S.MAX_TOKENS] * (sm.S.SEQ_LEN - len(r)) for r in rows]
    return sm._cells(pa.array(ids, pa.list_(pa.list_(pa.int32()))))


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    rows = [[[5, 6, 5], [], [7]], [[6]] * 20, [], [[4096 + 5, 9]]]
    label = np.array([1.0, 0.0, 1.0, 0.0])
    slots, share = cells(rows)
    w = sm.Weights.of(rng.normal(0, 0.5, len(sm.Weights.start().flat())))

    def loss(flat):
        p = sm.forward(sm.Weights.of(flat), slots, share)[1]
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).sum()

    got, flat = sm.gradient(w, slots, share, label), w.flat()
    used = [5 * 16 + 3, 6 * 16, 7 * 16 + 15, 9 * 16 + 1, 8 * 16, 4096 * 16, 4096 * 16 + 40, len(flat) - 1]
    for at in used:
        move = np.zeros_like(flat)
        move[at] = 1e-5
        assert got[at] == pytest.approx((loss(flat + move) - loss(flat - move)) / 2e-5, abs=1e-6)


@pytest.fixture(scope="module")
def builds(spark):
    """Builds of 20 lines; the label hangs on what the late lines say, not on what the build says at all."""
    b = spark.range(300).select(F.col("id").alias("build"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    rows = b.select("build", "label", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("pos"))
    bad = F.when(F.col("label") == 1, F.col("pos") >= 14).otherwise(F.col("pos") < 6) & (F.xxhash64("build", "pos") % 2 == 0)
    line = F.when(bad, "ERROR connection refused by host").otherwise(F.concat(F.lit("INFO step "), (F.xxhash64("pos", "build") % 5).cast("string"), F.lit(" done")))
    lines = rows.select("build", F.col("pos").cast("long").alias("pos"), line.alias("line"))
    return lines, b


def test_learns_when_things_are_said(spark, builds):
    lines, labels = builds
    fitted = sm.train(lines, labels)
    curve = fitted.curve.orderBy("epoch").collect()
    assert [r.epoch for r in curve] == list(range(1, 16))
    assert [r.learning_rate for r in curve] == [0.05] * 5 + [0.025] * 5 + [0.0125] * 5
    assert curve[-1].train_loss < curve[0].train_loss / 2 and curve[-1].val_loss < curve[0].val_loss
    assert curve[-1].f1_score > 0.95
    got = {r.build: r for r in sm.score(fitted, lines).collect()}
    want = {r.build: r.label for r in labels.collect()}
    assert len(got) == 300 and sum(got[k].is_failure == bool(v) for k, v in want.items()) > 285
    assert all(r.confidence >= 0.5 and r.model == "sequence" for r in got.values())
    row = sm.evaluate(fitted, lines, labels).first()
    assert row.tp + row.tn + row.fp + row.fn == 300 and row.roc_auc > 0.97


def test_few_tasks_are_summed_without_a_shuffle(spark):
    rows = [([[5 + i % 7, 6, 0, 0]] + [[0] * 4] * 2, i % 2) for i in range(40)]
    full = [[line + [0] * (sm.S.MAX_TOKENS - 4) for line in ids] + [[0] * sm.S.MAX_TOKENS] * (sm.S.SEQ_LEN - 3) for ids, _ in rows]
    df = spark.createDataFrame([(ids, y) for ids, (_, y) in zip(full, rows)], "ids array<array<int>>, label int").repartition(3)
    w = sm.Weights.start()
    (n, few), (m, many) = (sm._summed(spark, df, w, tasks) for tasks in (3, sm.PARTIAL + 1))
    assert n == m == 40 and few == pytest.approx(many, abs=1e-12) and few.any()


def test_too_few_builds(builds):
    lines, labels = builds
    assert sm.train(lines, labels.where("build < 49")) is None
    assert sm.score(None, lines).select("failure_probability", "confidence", "model").distinct().collect() == [(0.0, 0.5, "sequence_disabled")]
