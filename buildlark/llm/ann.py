"""Approximate nearest neighbours with multiprobe p-stable hashing.

Vectors are brought to length one, where the nearest by cosine is the nearest by distance. A table
projects on Gaussian directions and cuts each projection into cells; a bucket is one cell of each.
A neighbour at distance r differs from the query in a projection by a normal step of deviation r, so
the chance that it lies in a bucket is a product over the cells. A query visits its own bucket and
perturbed ones in order of that chance, until the buckets visited hold the wanted share of it. The
candidates of all tables are merged and ranked by their exact cosine. Every block of vectors has the
same tables over its own vectors, so a crowded bucket is spread over all blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlark.llm.vectors import against_all, arrays, as_table, best

TABLES, PROJECTIONS = 4, 8
#: Share of the chance that the buckets visited in one table must hold: 1 - (1 - 0.45) ** 4 = 0.91 for a
#: neighbour at the estimated distance, more for nearer ones.
SHARE = 0.45
#: Cells on each side of the query's, draws that the share is measured on, and vectors that the distance
#: of neighbours is estimated from. In a larger set they are nearer, so more is visited than needed.
REACH, DRAWS, SAMPLE = 6, 128, 2_000
#: Queries that are looked up together.
TOGETHER = 256

_GRID = np.arange(-8, 8, 1 / 512)
_BELOW = np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in _GRID])


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that neither very small nor very large ones are lost."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def neighbour_distance(rows: DataFrame, k: int, rows_at_most: int = SAMPLE) -> float:
    """Distance within which 90 % of a bounded sample (first by hash of id) have their kth neighbour in it."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows_at_most).collect()
    by: dict[int, list] = {}
    for r in some:
        by.setdefault(len(r["v"]), []).append(r["v"])
    far = []
    for held in by.values():
        if len(held) > 1:
            x = unit(np.array(held, float))
            near = np.sort(x @ x.T, axis=1)[:, -1 - min(k, len(held) - 1)]
            far += np.sqrt(np.maximum(0, 2 - 2 * near)).tolist()
    return max(1e-3, float(np.quantile(far, 0.9))) if far else 1.0


class Table:
    """Buckets of the vectors of a block under one set of directions."""

    def __init__(self, x: np.ndarray, seed: int, distance: float):
        rng = np.random.default_rng(seed)
        dims = x.shape[1]
        self.directions = rng.normal(size=(dims, PROJECTIONS))
        self.width = distance
        self.offset = rng.random(PROJECTIONS)
        cells = np.floor(x @ self.directions / self.width + self.offset).astype(np.int64)
        self.buckets, self.bucket_of = np.unique(cells, axis=0, return_inverse=True)
        self.bucket_of = self.bucket_of.reshape(-1)
        self.draws = rng.random((DRAWS, PROJECTIONS))

    def visits(self, q: np.ndarray) -> np.ndarray:
        """Which vectors lie in the buckets that each of some queries visits; one row per query."""
        at = q @ self.directions / self.width + self.offset
        home = np.floor(at).astype(np.int64)
        edges = (home - at)[:, :, None] + np.arange(-REACH, REACH + 2)[None, None, :]
        chance = np.maximum(np.diff(np.interp(edges, _GRID, _BELOW), axis=2), 1e-12)
        logs, total = np.log(chance), np.cumsum(chance, axis=2)
        own, drawn = np.zeros((len(q), len(self.buckets))), np.zeros((len(q), DRAWS))
        for m in range(PROJECTIONS):
            cells = np.clip(self.buckets[:, m][None, :] - home[:, m][:, None] + REACH, 0, 2 * REACH)
            own += np.take_along_axis(logs[:, m], cells, 1)
            cells = (self.draws[:, m][None, :, None] * total[:, m, None, -1:] > total[:, m, None, :]).sum(axis=2)
            drawn += np.take_along_axis(logs[:, m], np.minimum(cells, 2 * REACH), 1)
        least = np.quantile(drawn, 1 - SHARE, axis=1)
        return (own >= least[:, None])[:, self.bucket_of]


def search(ids: np.ndarray, v: np.ndarray, x: np.ndarray, found: np.ndarray, q: np.ndarray, u: np.ndarray, own: int, k: int):
    """Ids and cosines of the k nearest among the candidates ``found`` by all tables."""
    found = found & (ids != own)
    if found.sum() < k:
        found = ids != own  # fewer than wanted in the buckets: visit all the rest
    at = np.nonzero(found)[0]
    near = x[at] @ u
    least = np.partition(near, -k)[-k] if len(at) > k else -2.0
    some = at[near >= least - 1e-9]
    score = cosine(v[some], q)
    top = np.lexsort((ids[some], -score))[:k]
    return ids[some][top], score[top]


def cosine(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))


def nearest(rows: DataFrame, queries: Column, k: int = 5, distance: float | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for each row that ``queries`` chooses.

    ``rows`` is ``vectors.usable(..., zero=False)``. The query's own row is left out; ties go to the
    smaller vec_id; with at most k others all are returned; repeated rows count once; vectors of another
    length than the query's are no candidates; no rows give no rows. All rows are indexed; only
    ``distance``, if not given, is estimated on a bounded sample.
    """
    distance = neighbour_distance(rows, k) if distance is None else distance

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, v = arrays(left)
        found = []
        if len(ids):
            x = unit(v)
            tables = [Table(x, seed, distance) for seed in range(TABLES)]
            owns, q = arrays(right)
            for low in range(0, len(owns), TOGETHER):
                some = q[low:low + TOGETHER]
                u = unit(some)
                visited = np.logical_or.reduce([t.visits(u) for t in tables])
                for j in range(len(some)):
                    own = int(owns[low + j])
                    got, score = search(ids, v, x, visited[j], some[j], u[j], own, k)
                    found.append((np.full(len(got), own), got, score))
        return as_table(*(map(list, zip(*found)) if found else ([], [], [])), pa.float64())

    return best(against_all(rows, queries, work, "double"), k)
