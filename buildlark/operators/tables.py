"""Writing the stored tables: append, replace, upsert, fill in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from buildlark import schemas
from buildlark.functions import logtext, scoring
from buildlark.operators import explain as X
from buildlark.operators.models import Classifier
from buildlark.operators.rollups import alerts_from_predictions
from buildlark.session import settle

BUILD_KEYS = ("job_name", "build_number")
FIRST_SEEN = ("build_url", "is_demo")
BUCKETS = 64  # folders of a builds table
FILE_ROWS = 2_000_000


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The declared columns in order; one that is missing (an older table) is added as NULL."""
    cols = []
    for f in StructType.fromDDL(ddl).fields:
        col = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(col.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def append(df: DataFrame, root: str, name: str) -> None:
    conform(df, schemas.TABLES[name]).write.mode("append").parquet(f"{root}/{name}")


def replace(df: DataFrame, root: str, name: str) -> None:
    """Truncate and load."""
    conform(df, schemas.TABLES[name]).write.mode("overwrite").parquet(f"{root}/{name}")


def row_id(*cols: str):
    """Key of a new row from what identifies it, known before anything is written."""
    return F.xxhash64(*cols)


def prediction_rows(scored: DataFrame) -> DataFrame:
    """Scored logs as rows of the predictions table; the snippet is the log's head."""
    keyed = scored if "id" in scored.columns else scored.withColumn("id", row_id("pipeline_id", "created_at", "logs"))
    return keyed.withColumn("log_snippet", logtext.head(F.col("logs"), scoring.SNIPPET_CHARS)).withColumnRenamed(
        "confidence", "anomaly_confidence"
    )


def store_predictions(scored: DataFrame, root: str) -> None:
    """Append predictions, then the alerts they call for, read back from what was stored."""
    rows = prediction_rows(scored)
    append(rows, root, "predictions")


def alert_rows(predictions: DataFrame) -> DataFrame:
    return alerts_from_predictions(predictions).withColumn("id", row_id("prediction_id", "severity"))


def upsert_builds(
    stored: DataFrame, incoming: DataFrame, order: tuple[str, ...] = ("synced_at", "build_timestamp")
) -> DataFrame:
    """Stored builds with the incoming ones merged in by (job_name, build_number).

    Per key the last row by ``order`` wins, incoming after stored, but URL and demo flag stay as
    first seen. One aggregation with map-side combining; no join.
    """
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    later = F.struct("_new", *order)
    rest = [c for c in stored.columns if c not in BUILD_KEYS and c not in FIRST_SEEN]
    merged = both.groupBy(*BUILD_KEYS).agg(
        F.min_by(F.struct(*FIRST_SEEN), later).alias("f"), F.max_by(F.struct(*rest), later).alias("r")
    )
    return merged.select(*BUILD_KEYS, "f.*", "r.*").select(*stored.columns)


# ---------------------------------------------------------------------------
# A builds table in hash buckets
# ---------------------------------------------------------------------------
def _bucketed(builds: DataFrame, buckets: int) -> DataFrame:
    return conform(builds, schemas.TABLES["builds"]).withColumn("bucket", F.pmod(F.xxhash64(*BUILD_KEYS), F.lit(buckets)).cast("int"))


def _write_buckets(rows: DataFrame, path: str) -> None:
    """Replace the buckets that ``rows`` hold; one task per bucket writes it, in files of bounded length."""
    (
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", FILE_ROWS).partitionBy("bucket").parquet(path)
    )


def stored_builds(spark: SparkSession, path: str) -> DataFrame:
    """The builds of a table in buckets, with their ``bucket``; a filter on it reads only those folders."""
    return spark.read.schema(f"{schemas.TABLES['builds']}, bucket int").parquet(path)


def store_builds(builds: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Begin a table of builds, one row per key, dealt to ``buckets`` folders by the hash of the key.

    Take so many that a bucket fits a task: an upsert rewrites every bucket it has a key in. The number must stay
    the same for a table; ``merge_builds`` has to be told it."""
    first = upsert_builds(conform(builds, schemas.TABLES["builds"]).limit(0), conform(builds, schemas.TABLES["builds"]))
    _write_buckets(_bucketed(first, buckets), path)


def merge_builds(
    incoming: DataFrame, path: str, buckets: int = BUCKETS, order: tuple[str, ...] = ("synced_at", "build_timestamp")
) -> list[int]:
    """Merge builds into the table at ``path`` as ``upsert_builds`` does; returns the buckets that were touched.

    Only the buckets that incoming keys fall into are read, shuffled and written. The merged buckets are written aside
    first and then put in place bucket by bucket: should that be cut short, doing the same merge again ends in
    the same table, as a row that is merged already changes nothing. No rows touch no bucket.
    """
    spark = incoming.sparkSession
    new = settle(_bucketed(incoming, buckets), "incoming")
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most ``buckets``
    if not touched:
        return []
    old = stored_builds(spark, path).where(F.col("bucket").isin(touched))
    merged = upsert_builds(old.drop("bucket"), new.drop("bucket"), order)
    _write_buckets(settle(_bucketed(merged, buckets), "merged"), path)
    return touched


def build_rows(scored_builds: DataFrame) -> DataFrame:
    """Scored builds as rows of the builds table; the snippet is the log's head."""
    out = scored_builds.withColumn("log_snippet", logtext.head(F.coalesce("log", F.lit("")), scoring.BUILD_LOG_CHARS))
    return conform(out.withColumn("id", row_id(*BUILD_KEYS)), schemas.TABLES["builds"])


def acknowledge(alerts: DataFrame, acks: DataFrame, key: str = "id") -> DataFrame:
    """Alerts with ``acknowledged`` set where their id was acknowledged."""
    marks = acks.select(key).distinct().withColumn("_ack", F.lit(True))
    seen = F.col("acknowledged") if "acknowledged" in alerts.columns else F.lit(False)
    return alerts.join(marks, key, "left").withColumn("acknowledged", F.coalesce("_ack", seen)).drop("_ack")


def backfill_explanations(predictions: DataFrame, clf: Classifier) -> DataFrame:
    """Predictions with missing explanations computed from their snippet."""
    lacking = F.col("shap_explanation").isNull() & F.col("log_snippet").isNotNull()
    todo = predictions.where(lacking).select("id", F.col("log_snippet").alias("log_text"))
    made = X.explain(clf, todo, "id").withColumnRenamed("shap_explanation", "_made")
    return predictions.join(made, "id", "left").withColumn(
        "shap_explanation", F.coalesce("shap_explanation", "_made")
    ).drop("_made").select(*predictions.columns)
