"""Structured Streaming jobs over build events and log lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from buildlark import schemas
from buildlark.functions import times
from buildlark.functions.scoring import count_if
from buildlark.operators import builds as B
from buildlark.operators import models, predict, tables
from buildlark.operators import templates as TM

LATEST_ROWS = 50


def read_json(
    spark: SparkSession, folder: str, ddl: str = schemas.BUILD_EVENT, files_per_batch: int | None = None
) -> DataFrame:
    """Events landing as JSON files in a folder, oldest files first; all there are in one batch unless limited."""
    reader = spark.readStream.schema(ddl)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def once(events: DataFrame, keys: Sequence[str], at: str, late: str = "1 hour") -> DataFrame:
    """Each event the first time it comes, by ``keys``, across batches and restarts.

    An event is remembered until the watermark, the newest ``at`` less ``late``, has passed its own ``at`` by
    ``late``; that bounds the state. One that comes after the watermark is dropped. Events without ``at``
    cannot be placed in time and are passed on, repeats included.
    """
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    dated = timed.where(F.col("_at").isNotNull()).withWatermark("_at", late).dropDuplicatesWithinWatermark(list(keys))
    return dated.drop("_at").unionByName(timed.where(F.col("_at").isNull()).drop("_at"))


def _start(writer, checkpoint: str, interval: str | None) -> StreamingQuery:
    """Run on an interval, or once over everything there is."""
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return trigger.start()


def store(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append a stream to a Parquet table."""
    return _start(stream.writeStream.format("parquet").option("path", path), checkpoint, interval)


# ---------------------------------------------------------------------------
# Builds
# ---------------------------------------------------------------------------
def score_events(events: DataFrame, synced_at: Column, clf: models.Classifier | None = None) -> DataFrame:
    """Build events as rows of the builds table."""
    rows = events.select(
        F.xxhash64("job_name", "build_number").alias("id"), "job_name", "build_number", "status", "duration_ms",
        times.parse_iso(F.col("timestamp")).alias("build_timestamp"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("log", F.lit("")).alias("logs"), F.coalesce("demo", F.lit(False)).alias("demo"),
    )
    return tables.build_rows(predict.score_builds(rows, synced_at, clf))


def follow_builds(
    events: DataFrame, root: str, checkpoint: str, clf: models.Classifier | None = None, interval: str | None = None
) -> StreamingQuery:
    """Score each arriving build and keep it: one folder of changes per batch.

    A batch writes only its own rows, under a name made of its number, so running it again after
    a failure replaces the same folder. ``current_builds`` merges on reading.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        scored = score_events(batch, F.current_timestamp(), clf)
        merged = tables.upsert_builds(scored.limit(0), scored)
        merged.write.mode("overwrite").parquet(f"{root}/changes/batch_id={batch_id}")

    return _start(events.writeStream.foreachBatch(take), checkpoint, interval)


def current_builds(spark: SparkSession, root: str) -> DataFrame:
    """The newest state of every build, with its first URL and demo flag."""
    ddl = f"{schemas.TABLES['builds']}, batch_id bigint"
    changes = spark.read.schema(ddl).parquet(f"{root}/changes")
    # Batch numbers order the changes, whatever the clocks of the machines say.
    return tables.upsert_builds(changes.limit(0), changes, ("batch_id", "build_timestamp")).drop("batch_id")


def compact_builds(spark: SparkSession, root: str, to: str) -> None:
    """Write the current state as the first change of a new root."""
    current_builds(spark, root).write.mode("overwrite").parquet(f"{to}/changes/batch_id=0")


def as_events(builds: DataFrame) -> DataFrame:
    """Each build as the JSON text the event stream sends."""
    return B.as_json(builds, "job_name", "build_number")


def keep_latest(
    events: DataFrame, root: str, checkpoint: str, n: int = LATEST_ROWS, interval: str | None = None
) -> StreamingQuery:
    """Keep the newest ``n`` events; each batch replaces the list by its own numbered copy."""

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch
        if batch_id > 0:
            newest = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{root}/{batch_id - 1}"))
        top = newest.orderBy(F.desc("timestamp"), "job_name", "build_number").limit(n)
        top.write.mode("overwrite").parquet(f"{root}/{batch_id}")

    return _start(events.writeStream.foreachBatch(take), checkpoint, interval)


# ---------------------------------------------------------------------------
# Key figures and hourly counts
# ---------------------------------------------------------------------------
def job_figures(events: DataFrame) -> DataFrame:
    """Running counts per job; builds are judged by status and prediction."""
    rows = B.judged(events)
    return rows.groupBy("job_name").agg(
        F.count(F.lit(1)).alias("total_builds"),
        count_if(F.col("actual_failure")).alias("actual_failures"),
        count_if(F.col("predicted_failure")).alias("predicted_failures"),
        count_if(F.col("prediction_correct")).alias("correct_predictions"),
    )


def refresh(figures: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Write the complete figures after every batch, each to its numbered folder."""

    def take(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{batch_id}")

    return _start(figures.writeStream.outputMode("complete").foreachBatch(take), checkpoint, interval)


def hourly_counts(events: DataFrame, series: str, ts: str, failed: Column, late: str = "1 hour") -> DataFrame:
    """Failures per hour and series, given out once the watermark has passed the hour.

    Rows later than ``late`` are dropped; a batch roll-up would still count them.
    """
    timed = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(series, F.window("_t", "1 hour").alias("w")).agg(count_if(failed).alias("failures")).select(
        series, F.col("w.start").alias("hour"), "failures"
    )


# ---------------------------------------------------------------------------
# Templates
# ---------------------------------------------------------------------------
STATE = {
    "steps": "leaf string, pos long, masked string",
    "branches": "level int, node string, key string, first_pos long",
    "templates": "leaf string, cluster int, template string, first_pos long, event_id string",
}
_LINE = "pos long, raw string"
_MARK = "mark long, mined long"


def _mark(spark: SparkSession, root: str, batch_id: int) -> tuple[int | None, int | None]:
    """Position up to which lines are mined after a batch, and the batch that last mined any."""
    if batch_id < 0:
        return None, None
    row = spark.read.schema(_MARK).parquet(f"{root}/state/{batch_id}/mark").first()
    return row["mark"], row["mined"]


def _prior(spark: SparkSession, root: str, mined: int | None) -> tuple[DataFrame, DataFrame] | None:
    if mined is None:
        return None
    return tuple(spark.read.schema(STATE[n]).parquet(f"{root}/state/{mined}/{n}") for n in ("steps", "branches"))


def mine_batch(batch: DataFrame, batch_id: int, root: str, lag: int = 0, **options) -> None:
    """Take up one batch of lines and mine those that no earlier line can precede any more.

    Lines wait until their position lies at least ``lag`` below the highest one seen. Everything a batch
    leaves behind is in folders of its number and is made from those of the batch before, so that running it
    again after a failure replaces it. A line that comes when its place is mined already is put into ``late``.
    """
    spark = batch.sparkSession
    before, mined = _mark(spark, root, batch_id - 1)
    state = f"{root}/state/{batch_id}"
    new = batch.select(F.col("pos").cast("long").alias("pos"), F.col("raw").cast("string").alias("raw"))
    if before is not None:
        in_time = F.col("pos") > before
        new.where(~in_time).write.mode("overwrite").parquet(f"{root}/late/batch_id={batch_id}")
        held = spark.read.schema(_LINE).parquet(f"{root}/state/{batch_id - 1}/waiting").where(in_time)
        new = new.where(in_time).unionByName(held)
    elif batch_id > 0:
        new = new.unionByName(spark.read.schema(_LINE).parquet(f"{root}/state/{batch_id - 1}/waiting"))
    # What waits after this batch is what lies above its mark; the reader applies that, nothing is copied.
    new.write.mode("overwrite").parquet(f"{state}/waiting")
    waiting = spark.read.schema(_LINE).parquet(f"{state}/waiting")
    highest = waiting.agg(F.max("pos")).first()[0]
    mark = before if highest is None else max(highest - lag, highest - lag if before is None else before)
    ready = waiting.where(F.col("pos") <= mark) if mark is not None else waiting.limit(0)
    if not ready.isEmpty():
        out = TM.mine(ready, prior=_prior(spark, root, mined), **options)
        out.lines.select("pos", "event_id", "template_online").write.mode("overwrite").parquet(f"{root}/lines/batch_id={batch_id}")
        for name in STATE:
            getattr(out, name).write.mode("overwrite").parquet(f"{state}/{name}")
        mined = batch_id
    spark.createDataFrame([(mark, mined)], _MARK).write.mode("overwrite").parquet(f"{state}/mark")


def mine_lines(
    lines: DataFrame, root: str, checkpoint: str, interval: str | None = None, lag: int = 0, **options
) -> StreamingQuery:
    """Mine templates as lines (pos, raw) arrive, in order of pos across batches.

    Batches may hold lines in any order as long as a line comes before the highest position seen lies
    ``lag`` above its own; results are then those of mining all lines at once. The state is the lines that
    wait, at most those of the last ``lag`` positions, and the steps and branch keys so far, both as small as the
    template table. A leaf that gets most of a batch is still split into chunks, which keyed
    state in one task could not do.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        mine_batch(batch, batch_id, root, lag, **options)

    return _start(lines.writeStream.foreachBatch(take), checkpoint, interval)


def mined_lines(spark: SparkSession, root: str, batch_id: int, **options) -> DataFrame:
    """(pos, event_id, template_online) of all lines that came up to a batch, those that still wait included:
    they are mined here as if nothing below them came any more, and the stream is left as it is."""
    ddl = "pos long, event_id string, template_online string, batch_id long"
    mark, mined = _mark(spark, root, batch_id)
    waiting = spark.read.schema(_LINE).parquet(f"{root}/state/{batch_id}/waiting")
    if mark is not None:
        waiting = waiting.where(F.col("pos") > mark)
    rest = TM.mine(waiting, prior=_prior(spark, root, mined), **options).lines.select("pos", "event_id", "template_online")
    if mined is None:
        return rest
    done = spark.read.schema(ddl).option("basePath", f"{root}/lines").parquet(f"{root}/lines")
    return done.where(F.col("batch_id") <= batch_id).drop("batch_id").unionByName(rest)
