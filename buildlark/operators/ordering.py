"""Exact running results over one long order, without putting that order into one task.

A plain window over a whole table, or over a source that holds a third of it, sorts that
group in a single task. Here the order is cut into buckets that follow it: rows are ranked or
summed inside their bucket, one small row per bucket is carried across buckets, and the two
are joined on the bucket, on which the rows are partitioned already. Results do not depend on
where the cuts fall.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlark.session import settle

CUTS = 512
CHUNK_ROWS = 1_000_000


def quantile_buckets(df: DataFrame, col: str, out: str, cuts: int = CUTS) -> DataFrame:
    """Add ``out``: a bucket number that grows with ``col``, about equally many rows in each.

    At most ``cuts`` boundaries come to the driver.
    """
    probs = [i / cuts for i in range(1, cuts)]
    numeric = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL")
    found = numeric.approxQuantile("v", probs, 1.0 / (4 * cuts))
    splits = [float("-inf"), *sorted(set(found)), float("inf")]
    keyed = df.withColumn("_cut_on", F.col(col).cast("double"))
    if len(splits) < 3:
        return keyed.withColumn(out, F.lit(0)).drop("_cut_on")
    cut = Bucketizer(splits=splits, inputCol="_cut_on", outputCol=out, handleInvalid="keep")
    return cut.transform(keyed).withColumn(out, F.col(out).cast("int")).drop("_cut_on")


def range_buckets(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: the number of the range of ``order`` a row lies in, which never decreases along it.

    For keys of any orderable type. The rows are written, as the ranges come from a sample.
    """
    return settle(df.repartitionByRange(*order).withColumn(out, F.spark_partition_id()), "ranges")


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    bucket: str,
    order: Sequence[Column],
    out: str,
) -> DataFrame:
    """1-based position of each row within ``group`` under ``order``.

    ``bucket`` must not decrease along ``order``; group and bucket must not be NULL.
    """
    group = list(group)
    keys = [*group, bucket]
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_inside", F.row_number().over(inside))
        .join(starts, keys)
        .withColumn(out, F.col("_inside") + F.col("_start"))
        .drop("_inside", "_start")
    )


def number_globally(df: DataFrame, col: str, out: str, cuts: int = CUTS) -> DataFrame:
    """1-based position of each row by a unique numeric column.

    ``df`` is written first: finding the cuts, counting and numbering each read it.
    """
    cut = quantile_buckets(settle(df, "number"), col, "_bucket", cuts)
    return number_rows(cut, [], "_bucket", [F.col(col)], out).drop("_bucket")


def hash_order(df: DataFrame, key: Sequence[Column], seed: int, out: str = "_hash") -> DataFrame:
    """Add a reproducible pseudo-random sort key and the even bucket it falls in."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))
    return df.withColumn(out, h).withColumn(f"{out}_bucket", F.substring(F.col(out), 1, 4))


def running_sums(
    df: DataFrame, order: str, sums: Sequence[str], descending: bool = True, cuts: int = CUTS
) -> DataFrame:
    """Replace each column of ``sums`` by its inclusive running sum along ``order``.

    ``order`` must be unique (group by it first). ``df`` is written first: finding the cuts, the
    totals and the sums each read it.
    """
    cut = quantile_buckets(settle(df, "running"), order, "_bucket", cuts)
    way = F.desc if descending else F.asc
    inside = Window.partitionBy("_bucket").orderBy(way(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.orderBy(way("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    starts = totals.select(
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums],
    )
    out = cut.select(
        "*", *[F.sum(c).over(inside).alias(f"_i_{c}") for c in sums]
    ).join(starts, "_bucket")
    for c in sums:
        out = out.withColumn(c, F.col(f"_i_{c}") + F.col(f"_s_{c}"))
    return out.select(*df.columns)


def neighbour_before(
    df: DataFrame, order: str, cols: Sequence[str], descending: bool = True, cuts: int = CUTS
) -> DataFrame:
    """Add ``prev_<c>``: the value of each column on the preceding row along unique ``order``."""
    cut = quantile_buckets(settle(df, "neighbours"), order, "_bucket", cuts)
    way = F.desc if descending else F.asc
    last_of = F.min_by if descending else F.max_by
    inside = Window.partitionBy("_bucket").orderBy(way(order))
    across = Window.orderBy(way("_bucket"))
    edge = cut.groupBy("_bucket").agg(*[last_of(c, order).alias(f"_e_{c}") for c in cols])
    edge = edge.select("_bucket", *[F.lag(f"_e_{c}").over(across).alias(f"_p_{c}") for c in cols])
    first = F.row_number().over(inside) == 1
    out = cut.select(
        "*",
        first.alias("_first"),
        *[F.lag(c).over(inside).alias(f"_l_{c}") for c in cols],
    ).join(edge, "_bucket")
    for c in cols:
        out = out.withColumn(
            f"prev_{c}", F.when(F.col("_first"), F.col(f"_p_{c}")).otherwise(F.col(f"_l_{c}"))
        )
    return out.select(*df.columns, *[f"prev_{c}" for c in cols])


def last_value_before(
    df: DataFrame,
    group: Sequence[str],
    pos: str,
    value: str,
    out: str,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Latest non-null ``value`` on an earlier row of the group, in order of integer ``pos``.

    A group of any size is cut into chunks of ``chunk_rows`` positions; only one row per chunk
    is ordered across the group.
    """
    group = list(group)
    keys = [*group, "_chunk"]
    cut = df.withColumn("_chunk", F.floor(F.col(pos) / F.lit(chunk_rows)).cast("long"))
    inside = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    across = (
        Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    ends = (
        cut.groupBy(*keys)
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(pos))).alias("_end"))
        .withColumn("_carried", F.last("_end", ignorenulls=True).over(across))
        .drop("_end")
    )
    return (
        cut.withColumn("_near", F.last(value, ignorenulls=True).over(inside))
        .join(ends, keys)
        .withColumn(out, F.coalesce("_near", "_carried"))
        .drop("_chunk", "_near", "_carried")
    )


def salted_join(
    big: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    spread: Column,
    how: str = "inner",
    salts: int = 32,
) -> DataFrame:
    """Join ``big`` with one row per key, the rows of a hot key dealt to ``salts`` tasks."""
    keys = list(keys)
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")
