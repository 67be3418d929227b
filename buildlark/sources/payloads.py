"""Normalise build-server payloads landed as JSON, log blobs and request bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from buildlark import schemas
from buildlark.functions import logtext, scoring, times


def jobs(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row per job of each jobs payload (a JSON string column)."""
    parsed = F.from_json(body, schemas.JOBS_PAYLOAD)
    j = payloads.select(F.explode(parsed["jobs"]).alias("j"))
    return j.select(
        F.col("j.name").alias("name"),
        F.coalesce("j.color", F.lit("notbuilt")).alias("color"),
        F.col("j.lastBuild.number").alias("last_build_number"),
        F.col("j.lastBuild.result").alias("last_build_result"),
        F.lit(False).alias("demo"),
    )


def builds(payloads: DataFrame, body: str = "body", count: int = 10) -> DataFrame:
    """The first ``count`` builds of each builds payload, newest first as the server sends them."""
    parsed = payloads.select(F.from_json(body, schemas.BUILDS_PAYLOAD).alias("p"))
    b = parsed.select(
        F.col("p.job_name").alias("job_name"),
        F.posexplode(F.slice("p.builds", 1, count)).alias("rank", "b"),
    )
    return b.select(
        "job_name",
        F.col("b.number").alias("build_number"),
        F.coalesce(F.nullif("b.result", F.lit("")), F.lit("IN_PROGRESS")).alias("status"),
        F.coalesce("b.duration", F.lit(0)).cast("bigint").alias("duration_ms"),
        times.from_epoch_ms(F.col("b.timestamp")).alias("build_timestamp"),
        F.coalesce("b.url", F.lit("")).alias("url"),
        F.lit(False).alias("demo"),
    )


def console_tail(logs: DataFrame, log: str = "log") -> DataFrame:
    """Replace the console log by its last characters."""
    return logs.withColumn(log, logtext.tail(F.col(log), scoring.CONSOLE_TAIL_CHARS))


def blob_lines(blobs: DataFrame, blob: str, *keys: str) -> DataFrame:
    """One row per non-blank line of each blob, numbered from 0."""
    return blobs.select(
        *keys, F.posexplode(logtext.content_lines(F.col(blob))).alias("pos", "line")
    )


def validate(bodies: DataFrame, body: str, contract: str) -> DataFrame:
    """Parse JSON bodies against a contract (DDL text); adds the parsed ``record`` and ``is_valid``.

    A body is valid if it is readable JSON of the declared types with every required field.
    """
    declared = StructType.fromDDL(contract)
    fields = [StructField(f.name, f.dataType, True) for f in declared.fields]
    read_as = StructType([*fields, StructField("_corrupt", StringType(), True)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    out = bodies.withColumn("record", F.from_json(body, read_as, options))
    ok = F.col("record").isNotNull() & F.col("record._corrupt").isNull()
    for f in declared.fields:
        if not f.nullable:
            ok = ok & F.col(f"record.{f.name}").isNotNull()
    return out.withColumn("is_valid", ok)
