"""Typed table scans and the "latest documents" read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlark import schemas


def scan(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet scan; with a schema no footer has to be read to find the columns."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def stored_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the nine stored tables under ``root``, with its declared schema."""
    return scan(spark, f"{root}/{name}", schemas.TABLES[name])


def recent(df: DataFrame, by: str, n: int, *ties: str | Column) -> DataFrame:
    """The ``n`` newest rows; ``ties`` make the order total."""
    return df.orderBy(F.col(by).desc_nulls_first(), *ties).limit(n)


def oldest(df: DataFrame, by: str, n: int, *ties: str | Column) -> DataFrame:
    return df.orderBy(F.col(by).asc(), *ties).limit(n)


def latest_row(df: DataFrame, by: str, *ties: str) -> DataFrame:
    """The single newest row, by a partial maximum per task rather than a sort."""
    cols = [c for c in df.columns]
    key = F.struct(by, *ties)
    return df.agg(F.max_by(F.struct(*cols), key).alias("r")).where("r IS NOT NULL").select("r.*")


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Rows with this id; an empty DataFrame stands for "not found"."""
    return df.where(F.col(key) == F.lit(value))


def newer_than(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days; the bound is constant, so it reaches the scan."""
    return df.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def matching(df: DataFrame, **equal) -> DataFrame:
    """Equality filters; a value of None means the filter was not asked for."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df
