"""Stated queries against all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries that one task holds, about.
BLOCK, PART = 4_096, 1_024


def usable(rows: DataFrame, vector: str = "embedding", zero: bool = True) -> DataFrame:
    """``vec_id long, v array<double>`` of the rows that take part, each different one once.

    Left out: NULL ids and vectors, vectors with a NULL or non-finite component and, unless ``zero``,
    those without a component other than zero.
    """
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    out = out.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite)
    return out if zero else out.where(F.exists("v", lambda x: x != 0))


def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a group, which have one length; repeated rows once, by id."""
    ids = table.column("vec_id").to_numpy()
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    v = np.ascontiguousarray(flat, np.float64).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    seen, keep = set(), []
    for k, (i, x) in enumerate(zip(ids.tolist(), v)):
        key = (i, x.tobytes())
        if key not in seen:
            seen.add(key)
            keep.append(k)
    return ids[keep], v[keep]


def against_all(
    rows: DataFrame, queries: Column, work: Callable[[pa.Table, pa.Table], pa.Table], score: str
) -> DataFrame:
    """``query_id, vec_id, score`` that ``work(vectors, queries)`` finds in each block of vectors of one
    length for each part of the queries. Both sides are copied to the blocks they meet in."""
    chosen = rows.where(queries)
    n, m = rows.count(), chosen.count()
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-m // PART))

    def number(k: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int")

    def every(k: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    sized = rows.withColumn("dim", F.size("v"))
    left = sized.withColumn("block", number(blocks)).withColumn("part", every(parts))
    right = sized.where(queries).withColumn("part", number(parts)).withColumn("block", every(blocks))
    keys = ["dim", "block", "part"]

    def both(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        if vectors.num_rows and asked.num_rows:
            return work(vectors, asked)
        return as_table([], [], [], pa.int64() if score == "long" else pa.float64())

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(both, f"query_id long, vec_id long, score {score}")


def best(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest of each query, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def as_table(query_ids: list[np.ndarray], vec_ids: list[np.ndarray], scores: list[np.ndarray], kind: pa.DataType) -> pa.Table:
    def joined(parts: list[np.ndarray], t: pa.DataType) -> pa.Array:
        return pa.array(np.concatenate(parts) if parts else [], t)

    return pa.table({
        "query_id": joined(query_ids, pa.int64()), "vec_id": joined(vec_ids, pa.int64()), "score": joined(scores, kind),
    })
