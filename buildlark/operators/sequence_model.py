"""A classifier of whole builds trained epoch by epoch on their token ids.

A line is the mean of its tokens' vectors, and a build's score a weighted sum over its leading lines with
weights of their own for each place, so the model knows what was said and when. It is
fitted by mini-batch gradients: an epoch deals the builds to a fixed number of batches, every task sums
the gradient of its rows of a batch, the sums are added up in two levels, and the driver, which holds the
weights only, takes one Adam step. The learning rate falls by steps of epochs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlark.functions.scoring import ratio
from buildlark.operators import metrics as M
from buildlark.operators import sequences as S
from buildlark.operators.curves import auc
from buildlark.operators.models import MIN_SAMPLES, SEED, stratified
from buildlark.session import new_table_path, settle

# Fixed values.
EPOCHS = 15
BATCH_SIZE = 64
FALL_EVERY, FALL_TO = 5, 0.5  # the learning rate is halved every five epochs
CLIP = 1.0

RATE = 0.05
SLOTS = 4096  # rows of the token table; ids beyond share them
WIDTH = 16
#: Mini-batches of an epoch at most: each is a Spark job. Beyond that many times BATCH_SIZE builds, batches grow.
STEPS = 8
#: Sums of gradients that reach the driver from one batch.
PARTIAL = 8
CURVE = (
    "epoch int, train_loss double, val_loss double, accuracy double, precision double, recall double, "
    "f1_score double, learning_rate double"
)


@dataclass
class Weights:
    """``tokens``: SLOTS x WIDTH; ``places``: lines x WIDTH; ``bias``."""

    tokens: np.ndarray
    places: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(seed: int = SEED) -> Weights:
        rng = np.random.default_rng(seed)
        return Weights(rng.normal(0, 0.1, (SLOTS, WIDTH)), rng.normal(0, 0.1, (S.SEQ_LEN, WIDTH)), np.zeros(1))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.tokens.ravel(), self.places.ravel(), self.bias])

    @staticmethod
    def of(flat: np.ndarray) -> Weights:
        a, b = SLOTS * WIDTH, S.SEQ_LEN * WIDTH
        return Weights(flat[:a].reshape(SLOTS, WIDTH), flat[a:a + b].reshape(S.SEQ_LEN, WIDTH), flat[a + b:])


def _cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots (rows x lines x tokens) and the share each token has in its line, 0 for padding."""
    flat = column.flatten().flatten().to_numpy(zero_copy_only=False)
    ids = flat.reshape(len(column), S.SEQ_LEN, S.MAX_TOKENS).astype(np.int64)
    real = ids != S.PAD
    share = real / np.maximum(1, real.sum(axis=2, keepdims=True))
    return ids % SLOTS, share


def forward(w: Weights, slots: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line vectors and failure probabilities."""
    lines = np.einsum("nlt,nltw->nlw", share, w.tokens[slots])
    return lines, 1 / (1 + np.exp(-np.clip(np.einsum("nlw,lw->n", lines, w.places) + w.bias, -30, 30)))


def gradient(w: Weights, slots: np.ndarray, share: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Gradient of the summed log loss, flat."""
    lines, p = forward(w, slots, share)
    off = p - label
    tokens = np.zeros_like(w.tokens)
    n, k, t = np.nonzero(share)
    np.add.at(tokens, slots[n, k, t], (off[n] * share[n, k, t])[:, None] * w.places[k])
    return np.concatenate([tokens.ravel(), np.einsum("n,nlw->lw", off, lines).ravel(), [off.sum()]])


def _summed(spark: SparkSession, rows: DataFrame, w: Weights, tasks: int) -> tuple[int, np.ndarray]:
    """Number of builds in ``rows`` and the sum of their gradients; two levels of sums before the driver.

    ``tasks`` read the rows; ``PARTIAL`` or fewer have no more sums than the second level would leave.
    """
    shared = spark.sparkContext.broadcast(w)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                slots, share = _cells(batch.column("ids"))
                g = gradient(shared.value, slots, share, batch.column("label").to_numpy().astype(float))
                n, total = n + batch.num_rows, g if total is None else total + g
        if n:
            part = TaskContext.get().partitionId() % PARTIAL
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "n", "g"])

    def together(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column("g"))
        return pa.table({"n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "g": pa.array([total.tobytes()], pa.binary())})

    sums = rows.select("ids", "label").mapInArrow(of_task, "part int, n long, g binary")
    got = (sums if tasks <= PARTIAL else sums.groupBy("part").applyInArrow(together, "n long, g binary")).collect()
    shared.unpersist()
    return sum(r["n"] for r in got), sum((np.frombuffer(r["g"]) for r in got), np.zeros(len(w.flat())))


def _scored(rows: DataFrame, w: Weights, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``p`` of rows with ``ids``."""
    shared = rows.sparkSession.sparkContext.broadcast(w)
    types = dict(rows.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = forward(shared.value, *_cells(batch.column("ids")))[1] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p, pa.float64())], [*keep, "p"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return rows.select(*keep, "ids").mapInArrow(work, f"{schema}, p double")


def _figures(rows: DataFrame, w: Weights) -> dict[str, float]:
    """Loss on the rows to fit and on the held-out ones, and scores on the latter."""
    p, y = F.col("p"), F.col("label") == 1
    loss = -F.log(F.greatest(F.when(y, p).otherwise(1 - p), F.lit(1e-15)))
    said, held = p >= 0.5, F.col("held")
    def count(c):
        return F.count(F.when(c, 1))

    got = _scored(rows, w, ["label", "held"]).agg(
        F.avg(F.when(~held, loss)).alias("train_loss"), F.avg(F.when(held, loss)).alias("val_loss"),
        count(held & y & said).alias("tp"), count(held & ~y & said).alias("fp"), count(held & y & ~said).alias("fn"), count(held).alias("n"),
        count(held & (y == said)).alias("right"),
    )
    share = got.select(
        "train_loss", "val_loss", ratio(F.col("right"), F.col("n")).alias("accuracy"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1_score"),
    )
    return share.first().asDict()


@dataclass
class SequenceModel:
    weights: Weights
    vocabulary: DataFrame
    curve: DataFrame


def train(lines: DataFrame, labels: DataFrame, epochs: int = EPOCHS, rate: float = RATE) -> SequenceModel | None:
    """Fit on builds (lines: build, pos, line; labels: build, label); None below 50 builds.

    The vocabulary is that of the builds to fit. ``curve`` has a row per epoch: loss on both parts, scores on the
    held-out fifth, and the learning rate of the epoch.
    """
    if labels.limit(MIN_SAMPLES).count() < MIN_SAMPLES:
        return None
    spark = lines.sparkSession
    dealt = settle(stratified(labels, "label", "build", SEED, "fold"), "dealt")
    fit = dealt.where("fold <> 0")
    toks = settle(S.tokenised(lines.join(dealt.select("build"), "build", "left_semi")), "tokens")
    vocab = settle(S.vocabulary(toks.join(fit.select("build"), "build", "left_semi")), "vocabulary")
    steps = max(1, min(STEPS, fit.count() // BATCH_SIZE))
    step = F.when(F.col("fold") == 0, -1).otherwise(F.pmod(F.xxhash64("build", F.lit(SEED)), F.lit(steps))).cast("int")
    rows = S.encode(toks, vocab).join(dealt, "build").select(
        "build", "ids", F.col("label").cast("int").alias("label"), (F.col("fold") == 0).alias("held"), step.alias("step"))
    path = new_table_path(spark, "sequences")
    rows.write.partitionBy("step").parquet(path)  # a batch reads its own folder only
    rows = spark.read.schema(rows.schema).parquet(path)
    batches = [rows.where(F.col("step") == k) for k in range(steps)]
    tasks = [batch.rdd.getNumPartitions() for batch in batches]

    w, curve = Weights.start().flat(), []
    mean, square, taken = np.zeros_like(w), np.zeros_like(w), 0
    for epoch in range(1, epochs + 1):
        now = rate * FALL_TO ** ((epoch - 1) // FALL_EVERY)
        for k in range(steps):
            n, g = _summed(spark, batches[k], Weights.of(w), tasks[k])
            if not n:
                continue
            g = g / n
            g = g * min(1.0, CLIP / (np.linalg.norm(g) + 1e-12))
            taken += 1
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            w = w - now * (mean / (1 - 0.9 ** taken)) / (np.sqrt(square / (1 - 0.999 ** taken)) + 1e-8)
        f = _figures(rows, Weights.of(w))
        curve.append((epoch, *(f[c] for c in ("train_loss", "val_loss", "accuracy", "precision", "recall", "f1_score")), now))
    return SequenceModel(Weights.of(w), vocab, spark.createDataFrame(curve, CURVE))


def score(fitted: SequenceModel | None, lines: DataFrame) -> DataFrame:
    """(build, failure_probability, is_failure, confidence, model) per build."""
    if fitted is None:
        return lines.select("build").distinct().select(
            "build", F.lit(0.0).alias("failure_probability"), F.lit(False).alias("is_failure"),
            F.lit(0.5).alias("confidence"), F.lit("sequence_disabled").alias("model"),
        )
    scored = _scored(S.encode(S.tokenised(lines), fitted.vocabulary), fitted.weights, ["build"])
    q = F.col("p")
    return scored.select(
        "build", q.alias("failure_probability"), (q >= 0.5).alias("is_failure"), F.greatest(q, 1 - q).alias("confidence"),
        F.lit("sequence").alias("model"))


def evaluate(fitted: SequenceModel, lines: DataFrame, labels: DataFrame) -> DataFrame:
    scored = settle(score(fitted, lines).join(labels, "build"), "build-scores")
    row = M.scores(scored.withColumn("y", F.col("is_failure").cast("int")), "label", "y")
    return row.withColumn("roc_auc", auc(scored, "label", "failure_probability").scalar())
