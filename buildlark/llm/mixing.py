"""Mixing sources to target weights, with DataFrame functions only.

Each row gets a hash-random key; within its source the rows are in order of the key. The order is
cut into ranges of equal key width, rows are summed inside their range and the ranges' totals are
summed along the source, so a source of any size spreads over all ranges. The prefix sum then tells
how much of the last, incomplete epoch falls on each row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlark.llm.words import numbered, quoted

#: Hex digits of the key that make up a range: 16 ** 3 ranges in each source.
RANGE_DIGITS = 3

WORD = r"[^\x20\x09-\x0D]+"

OUT = ("size", "source_size", "target", "taken")


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _targets(ranges: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``_sid, source_size, target`` of each source, from the sizes of its ranges.

    Shares by weight fill up sources in order of limit / weight; a source whose share at that point
    is above its limit gets the limit, and what is left is shared anew among the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("_limit") / F.col("_weight"), "_rank")
    per = (
        ranges.groupBy("source").agg(F.sum("_size").alias("source_size"))
        .withColumn("_rank", F.row_number().over(by_name))
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("_limit", F.col("source_size") * most)
        .withColumn("_all", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_weights", F.sum("_weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_fits", F.col("_left") * F.col("_weight") <= F.col("_limit") * F.col("_weights"))
        .withColumn("_place", F.row_number().over(fill))
    )
    level = F.min(F.when(F.col("_fits"), F.struct("_place", (F.col("_left") / F.col("_weights")).alias("level")))).over(Window.partitionBy())
    below = F.col("_place") < F.col("_level._place")
    return per.withColumn("_level", level).select(
        "source", "source_size",
        F.when(below, F.col("_limit").cast("double")).otherwise(F.col("_level.level") * F.col("_weight")).alias("target"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` and ``taken`` words of each row.

    Sources by code point, NULL last, weigh ``weights`` in turn and share the words of all; no target
    is above ``most`` times its source's size. ``taken`` is the size times the complete epochs, plus
    what of the last epoch falls on the row up to the whole part of the target; one row per source
    may be taken in part. Sources' sums of ``taken`` therefore equal the whole part of their target.

    NULL or empty text: size 0, taken 0. NULL source: a source of its own. NULL doc_id and repeated
    rows count as rows; rows alike in doc_id and size are interchangeable. An empty table gives no
    rows. Columns of the input that have the name of a result column are replaced.
    """
    kept = [c for c in docs.columns if c not in OUT]
    out = _taken(docs.select(*map(quoted, kept)), weights, most, seed)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *OUT)


def _taken(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 42) -> DataFrame:
    """The columns of ``docs`` as ``c0``, ``c1``, ..., and those of the mix."""
    names = docs.columns
    doc_id, text, own = (f"c{names.index(c)}" for c in ("doc_id", "text", "source"))
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    sized = (
        numbered(docs).withColumn("size", words_in(F.col(text).cast("string")))
        .withColumn("_key", key)
        .withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
    )
    ranges = sized.groupBy(F.col(own).alias("source"), "_range").agg(F.sum("size").alias("_size"))
    along = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    targets = _targets(ranges, weights, most)
    starts = (
        ranges.withColumn("_start", F.coalesce(F.sum("_size").over(along), F.lit(0))).alias("a")
        .join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
        .select(F.col("a.source").alias("_source"), F.col("a._range").alias("_r"), "_start", "source_size", "target")
    )
    inside = Window.partitionBy(own, "_range").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    before = F.col("_start") + F.coalesce(F.col("_inside"), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return (
        sized.withColumn("_inside", F.sum("size").over(inside))
        .join(starts, F.col(own).eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")))
        .withColumn("taken", (epochs * F.col("size") + part).cast("long"))
    )


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix itself, with the columns of ``docs``.

    A row is repeated once per complete epoch; the row cut by the budget follows with the words it
    was cut to, joined by one space. Rows of which nothing is taken are left out, except those
    without any words, which take nothing from the budget and stay once. Columns keep their values
    whatever their names, but for ``n_chars``, which follows the text. NULL ids and sources, repeated
    rows and an empty table are as in ``mix``; a text of any length is one row.
    """
    names = docs.columns
    out = _taken(docs, **options)
    text = F.col(f"c{names.index('text')}")
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)).cast("int")
    words = F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), F.lit(1), rest)
    texts = F.concat(
        F.when(whole > 0, F.array_repeat(text, whole)).otherwise(F.array().cast("array<string>")),
        F.when(rest > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>")),
    )
    out = out.withColumn("_text", F.explode(texts))
    now = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[now.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
