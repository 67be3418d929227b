"""ROC and precision-recall curves.

Rows are first summed per distinct score (map-side), so ties share a point; running counts over
the distinct scores come from ``ordering.running_sums``, which never sorts them in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlark.functions.scoring import count_if, f1, ratio
from buildlark.operators.ordering import neighbour_before, running_sums


def _cumulative(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score: how many positives (tps) and negatives (fps) score at least as high."""
    per_score = rows.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        count_if(F.col(label) == 1).alias("tps"), count_if(F.col(label) != 1).alias("fps")
    )
    return running_sums(per_score, "threshold", ["tps", "fps"])


def roc_points(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, tps, fps, tpr, fpr) by falling threshold.

    The leading point (0, 0) lies above every score; its threshold is NULL.
    """
    cum = _cumulative(rows, label, score)
    pos = rows.agg(count_if(F.col(label) == 1)).scalar()
    neg = rows.agg(count_if(F.col(label) != 1)).scalar()
    spark = rows.sparkSession
    origin = spark.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0).cast("bigint").alias("tps"),
        F.lit(0).cast("bigint").alias("fps"),
    )
    return cum.unionByName(origin).select(
        "threshold", "tps", "fps", ratio(F.col("tps"), pos).alias("tpr"), ratio(F.col("fps"), neg).alias("fpr")
    )


def auc(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve by the trapezoid rule, from whole counts."""
    cum = _cumulative(rows, label, score)
    seg = neighbour_before(cum, "threshold", ["tps", "fps"])
    prev_t, prev_f = F.coalesce("prev_tps", F.lit(0)), F.coalesce("prev_fps", F.lit(0))
    # Twice the area in units of one positive times one negative: exact in whole numbers.
    twice = (F.col("fps") - prev_f).cast("decimal(38,0)") * (F.col("tps") + prev_t).cast("decimal(20,0)")
    total = seg.agg(
        F.sum(twice).alias("a"), F.max("tps").alias("p"), F.max("fps").alias("n")
    )
    den = F.lit(2.0) * F.col("p").cast("double") * F.col("n").cast("double")
    return total.select(F.try_divide(F.col("a").cast("double"), den).alias("auc"))


def drop_collinear(points: DataFrame) -> DataFrame:
    """ROC points without those on a straight line between their neighbours."""
    body = points.where("threshold IS NOT NULL")
    back = neighbour_before(body, "threshold", ["tps", "fps"])
    both = neighbour_before(
        back.withColumnRenamed("prev_tps", "b_tps").withColumnRenamed("prev_fps", "b_fps"),
        "threshold", ["tps", "fps"], descending=False,
    )
    bend = lambda c: (F.col(f"prev_{c}") - F.col(c)) != (F.col(c) - F.coalesce(f"b_{c}", F.lit(0)))
    last = F.col("prev_tps").isNull()
    keep = both.where(last | bend("tps") | bend("fps")).select(points.columns)
    return keep.unionByName(points.where("threshold IS NULL"))


def pr_points(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, precision, recall, f1) per distinct score plus the end point (1, 0)."""
    cum = _cumulative(rows, label, score)
    pos = rows.agg(count_if(F.col(label) == 1)).scalar()
    p = ratio(F.col("tps"), F.col("tps") + F.col("fps"))
    r = F.when(pos > 0, ratio(F.col("tps"), pos)).otherwise(F.lit(1.0))
    body = cum.select("threshold", p.alias("precision"), r.alias("recall"))
    end = rows.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
    )
    return body.unionByName(end).withColumn("f1_score", f1(F.col("precision"), F.col("recall")))


def precision_means(points: DataFrame) -> DataFrame:
    """Plain mean of the precision column, and the step-wise average precision."""
    body = points.where("threshold IS NOT NULL")
    steps = neighbour_before(body, "threshold", ["recall"]).select(
        ((F.col("recall") - F.coalesce("prev_recall", F.lit(0.0))) * F.col("precision")).alias("step"),
        "precision",
    )
    out = steps.agg(
        F.sum("precision").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("step").alias("average_precision")
    )
    # The end point (precision 1, recall 0) counts in the mean and adds no step.
    return out.select(
        ((F.col("s") + F.lit(1.0)) / (F.col("n") + F.lit(1))).alias("mean_precision"), "average_precision"
    )


def zip_points(curves: DataFrame, *columns: str) -> DataFrame:
    """Parallel array columns to one row per point, in array order."""
    keys = [c for c in curves.columns if c not in columns]
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    return curves.select(*keys, F.posexplode(zipped).alias("point", "p")).select(
        *keys, "point", *[F.col(f"p.{c}").alias(c) for c in columns]
    )
