"""Hard negatives of anchors from exact scores computed in a residue number system.

Rows are packed into blocks, anchors into parts, and every part meets every block. There the
components are taken modulo small primes, the matrices of residues are multiplied in float32, where
all sums stay below 2 ** 24 and are therefore exact, and the signed score is put together from its
residues by Chinese remaindering. A block hands on, for each anchor, the few rows that can be among
the first; windows over the anchor choose among the blocks. That is done twice: positives first, then
the negatives inside the window that each positive's score opens.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlark.session import settle

#: Components that a block and a part hold, about: 4 096 rows and 16 384 anchors of 64 components.
BLOCK, PART = 1 << 18, 1 << 20
#: Anchors multiplied at once.
COLUMNS = 512
LONG = (1 << 63) - 1
#: float32 holds whole numbers up to here.
EXACT = 1 << 24
#: Largest modulus; residues are balanced, -125 to 125, so 1 073 products fit below ``EXACT``.
LARGEST = 251


def moduli(bound: int) -> list[int]:
    """Primes whose product is above twice ``bound``: from ``LARGEST`` down, then, for huge components, from there up."""
    out, product = [], 1
    for n in itertools.chain(range(LARGEST, 2, -2), itertools.count(LARGEST + 2, 2)):
        if product > 2 * bound:
            return out
        if all(n % k for k in range(3, int(n ** 0.5) + 1, 2)):
            out.append(n)
            product *= n


def _residues(q: np.ndarray, p: int) -> np.ndarray:
    r = np.asarray(np.mod(q, p), np.float32)
    return np.where(r > p // 2, r - p, r)


def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b modulo p, from 0 on; so few columns at a time that float32 stays exact."""
    at_once = EXACT // (p // 2) ** 2 - 1
    out = np.zeros((a.shape[0], b.shape[1]), np.float32)
    for low in range(0, a.shape[1], at_once):
        out = np.mod(out + np.mod(a[:, low:low + at_once] @ b[low:low + at_once], np.float32(p)), np.float32(p))
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the whole-numbered rows of ``a`` with those of ``b``.

    As int64 where 100 times any of them fits into it, else as Python integers."""
    most = [int(abs(x).max()) if x.size else 0 for x in (a, b)]
    bound = a.shape[1] * most[0] * most[1]
    kind = np.int64 if 1_000 * bound < 1 << 62 else object
    primes = moduli(bound)
    total, step = np.zeros((len(a), len(b)), kind), 1
    for p in primes:
        r = _product(_residues(a, p), _residues(b, p).T, p).astype(np.int64).astype(kind)
        # Mixed radix: the next digit makes the total right modulo p, too.
        digit = (r - total % p) * pow(step, -1, p) % p
        total = total + digit * step
        step *= p
    return np.where(total > step // 2, total - step, total)


def _whole(v: np.ndarray, steps: int) -> np.ndarray:
    """floor(steps * x) as doubles, or as Python integers beyond 2 ** 52."""
    q = np.floor(steps * v)
    if not q.size or np.abs(q).max() < 1 << 52:
        return q
    out = np.empty(q.size, object)
    out[:] = [int(x) for x in q.ravel().tolist()]
    return out.reshape(q.shape)


def _pack(table: pa.Table) -> pa.Table:
    """The rows of a block in order of id."""
    ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    v = np.ascontiguousarray(flat, np.float64).reshape(len(ids), -1)
    order = np.argsort(ids)
    return pa.table({
        "dim": table.column("dim")[:1].cast(pa.int32()), "block": table.column("block")[:1].cast(pa.int32()),
        "ids": pa.array([ids[order].tobytes()], pa.binary()), "labels": pa.array([labels[order].tobytes()], pa.binary()),
        "v": pa.array([v[order].tobytes()], pa.binary()),
    })


PACKED = "dim int, block int, ids binary, labels binary, v binary"


def _unpacked(row: dict, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
    return ids, labels, _whole(np.frombuffer(row["v"]).reshape(len(ids), -1), steps)


def _first(order_scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest, highest first; equal ones in order of place."""
    n = len(order_scores)
    if n > k:
        least = np.partition(order_scores, n - k)[n - k]
        above, level = np.nonzero(order_scores > least)[0], np.nonzero(order_scores == least)[0]
        places = np.concatenate([above, level[:k - len(above)]])
    else:
        places = np.arange(n)
    return places[np.argsort(-order_scores[places], kind="stable")]


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, cols)})


def _tiles(left: pa.Table, right: pa.Table, steps: int):
    """Scores of each anchor of ``right`` with all rows of ``left``: ids, labels, anchor, its label, scores."""
    if not left.num_rows or not right.num_rows:
        return
    ids, labels, q = _unpacked(left.slice(0, 1).to_pylist()[0], steps)
    anchors, own, asked = _unpacked(right.slice(0, 1).to_pylist()[0], steps)
    for low in range(0, len(anchors), COLUMNS):
        got = np.clip(scores(q, asked[low:low + COLUMNS]), -LONG, LONG).astype(np.int64)
        for j in range(got.shape[1]):
            yield ids, labels, int(anchors[low + j]), int(own[low + j]), got[:, j]


POSITIVES = ["anchor_id", "positive_id", "positive_score"]
NEGATIVES = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]


def _meeting(blocks: DataFrame, parts: DataFrame, n_blocks: int, n_parts: int) -> tuple[DataFrame, DataFrame]:
    """Each block once for each part and each part once for each block, by number."""
    left = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    right = parts.withColumnRenamed("block", "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return left, right


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, label`` (long) and ``v`` (doubles) of rows with an id, a label and a finite vector."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("v"),
    )
    return out.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(finite)


def mine(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, steps: int = 256,
    least: tuple[int, int] = (80, 100),
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` is ``usable``; ``anchors`` chooses rows of it. The score is the inner product of floor(steps * component),
    higher first, ties to the smaller id. An anchor's positives are its first other rows of the same label; for each, the
    first rows of another label with ``least[0] * positive <= least[1] * negative`` and ``negative <= positive`` are returned.
    An anchor without positives, or a positive without such rows, gives no rows; a negative positive score
    leaves an empty window.

    Rows that share an id count as one, the least in label and components. Vectors of another length than
    the anchor's take no part with it. No rows give no rows. A score beyond 64 bits counts as the largest or least of them.
    """
    # One row per id, combined before it is sent: an id may hold any share of the rows.
    once = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    sized = settle(once.withColumn("dim", F.size("v")), "vectors")
    picked = sized.where(anchors)
    n, m = (t.agg(F.sum("dim")).first()[0] or 0 for t in (sized, picked))
    n_blocks, n_parts = max(1, -(-n // BLOCK)), max(1, -(-m // PART))

    def packed(of: DataFrame, k: int, label: str) -> DataFrame:
        numbered = of.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int"))
        return settle(numbered.groupBy("dim", "block").applyInArrow(_pack, PACKED), label)

    blocks, parts = packed(sized, n_blocks, "blocks"), packed(picked, n_parts, "parts")
    keys = ["dim", "block", "part"]

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for ids, labels, anchor, label, got in _tiles(left, right, steps):
            same = np.nonzero((labels == label) & (ids != anchor))[0]
            top = same[_first(got[same], positives)]
            out += [(anchor, int(i), int(s)) for i, s in zip(ids[top], got[top])]
        return _table(out, POSITIVES)

    left, right = _meeting(blocks, parts, n_blocks, n_parts)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(near, ", ".join(f"{c} long" for c in POSITIVES))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    close = settle(found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= positives).drop("_r"), "positives")

    pairs = F.collect_list(F.struct("anchor_id", "positive_id", "positive_score")).alias("pairs")
    asked = close.groupBy(F.pmod(F.xxhash64("anchor_id"), F.lit(n_parts)).cast("int").alias("block")).agg(pairs)
    windows = parts.join(asked, "block")

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        out, of = [], {}
        for r in right.column("pairs").to_pylist():
            for x in r:
                of.setdefault(x["anchor_id"], []).append((x["positive_id"], x["positive_score"]))
        for ids, labels, anchor, label, got in _tiles(left, right, steps):
            mine_ = of.get(anchor)
            if not mine_:
                continue
            other = np.nonzero(labels != label)[0]
            ranked = other[np.argsort(-got[other], kind="stable")]
            falling = -got[ranked]
            for positive, score in mine_:
                at = int(np.searchsorted(falling, -score))
                for place in ranked[at:at + negatives]:
                    s = int(got[place])
                    if least[0] * score <= least[1] * s:
                        out.append((anchor, positive, score, int(ids[place]), s))
        return _table(out, NEGATIVES)

    left, right = _meeting(blocks, windows, n_blocks, n_parts)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(hard, ", ".join(f"{c} long" for c in NEGATIVES))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
