"""Queries for scaling and for the ROC and precision-recall curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildlark.operators import curves, metrics
from buildlark.plans import views
from buildlark.plans.registry import query
from buildlark.plans.views import with_views

# Cumulative counts per distinct score of the alert times, and of the labelled documents.
_CUM = """
cum AS (SELECT threshold, cast(sum(p) OVER w AS bigint) AS tps, cast(sum(n) OVER w AS bigint) AS fps FROM (
    SELECT score AS threshold, count_if(label = 1) AS p, count_if(label <> 1) AS n FROM scored GROUP BY 1)
  WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
tot AS (SELECT count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM scored)"""


@query("fn23_min_max", with_views("""
SELECT id, CASE WHEN hi > lo THEN 1.0e0 * (anomaly_score - lo) / (hi - lo) ELSE 0.5e0 END AS scaled
FROM predictions, (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM predictions)"""))
def min_max(spark, sf):
    p = views.predictions(spark, sf).select("id", "anomaly_score")
    return metrics.min_max(p, "anomaly_score", "scaled").select("id", "scaled")


@query("fn24_importance_percent", """
SELECT feature, 100.0e0 * (importance - lo) / (hi - lo) AS importance_pct FROM
  (SELECT p_name || '-' || p_partkey AS feature, cast(p_size AS double) AS importance FROM part),
  (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)""")
def importance_percent(spark, sf):
    p = views.table(spark, sf, "part").select(
        F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("feature"),
        F.col("p_size").cast("double").alias("importance"),
    )
    return metrics.importance_percent(p).select("feature", "importance_pct")


@query("crv1_roc_points", with_views(f"""
WITH {_CUM}
SELECT threshold, tps, fps, cast(tps AS double) / pos AS tpr, cast(fps AS double) / neg AS fpr FROM cum, tot
UNION ALL SELECT NULL, 0, 0, 0.0e0, 0.0e0"""))
def roc_points(spark, sf):
    return curves.roc_points(views.scored(spark, sf))


@query("crv1_roc_auc", with_views(f"""
WITH {_CUM}
SELECT sum((fps - pf) * (tps + pt)) / (2.0e0 * max(pos) * max(neg)) AS auc FROM
  (SELECT tps, fps, coalesce(lag(tps) OVER w, 0) AS pt, coalesce(lag(fps) OVER w, 0) AS pf FROM cum WINDOW w AS (ORDER BY threshold DESC)), tot"""))
def roc_auc(spark, sf):
    return curves.auc(views.scored(spark, sf))


@query("crv1_roc_without_collinear", with_views(f"""
WITH {_CUM}
SELECT threshold, tps, fps, cast(tps AS double) / pos AS tpr, cast(fps AS double) / neg AS fpr FROM (
  SELECT *, coalesce(lag(tps) OVER w, 0) AS bt, coalesce(lag(fps) OVER w, 0) AS bf, lead(tps) OVER w AS nt, lead(fps) OVER w AS nf
  FROM cum WINDOW w AS (ORDER BY threshold DESC)), tot
WHERE nt IS NULL OR nt - tps <> tps - bt OR nf - fps <> fps - bf
UNION ALL SELECT NULL, 0, 0, 0.0e0, 0.0e0"""))
def roc_without_collinear(spark, sf):
    return curves.drop_collinear(curves.roc_points(views.scored(spark, sf)))


@query("crv2_precision_recall", with_views(f"""
WITH {_CUM},
pr AS (SELECT threshold, cast(tps AS double) / (tps + fps) AS precision, cast(tps AS double) / pos AS recall FROM cum, tot
  UNION ALL SELECT NULL, 1.0e0, 0.0e0)
SELECT *, CASE WHEN precision + recall = 0 THEN 0.0e0 ELSE 2.0e0 * precision * recall / (precision + recall) END AS f1_score FROM pr"""))
def precision_recall(spark, sf):
    return curves.pr_points(views.scored(spark, sf))


@query("ag22_mean_precision", with_views(f"""
WITH {_CUM},
pr AS (SELECT threshold, cast(tps AS double) / (tps + fps) AS precision, cast(tps AS double) / pos AS recall FROM cum, tot)
SELECT round((sum(precision) + 1) / (count(*) + 1), 9) AS mean_precision, round(sum(step), 9) AS average_precision FROM (
  SELECT precision, (recall - coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0)) * precision AS step FROM pr)"""))
def mean_precision(spark, sf):
    out = curves.precision_means(curves.pr_points(views.scored(spark, sf)))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])
