"""Exact top-k by inner product with the threshold algorithm.

A block keeps, for each dimension, its vectors in order of that component. A query reads all lists
from the end that suits the sign of its own component, scores every vector it meets for the first
time in full, and stops when no vector further down can reach the kth score: none scores more than
the query does with the components at the present depth.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from buildlark.llm.vectors import against_all, arrays, as_table, best

#: Entries of each list that are read in the first round; each further round reads twice as many.
FIRST_DEPTH = 16
#: Integers up to here add up exactly as doubles in a product of up to 2 ** 13 dimensions.
EXACT = 1 << 20


def quantised(v: np.ndarray, steps: int) -> np.ndarray:
    """floor(steps * x) as whole doubles, or as Python integers where those would not add up exactly."""
    q = np.floor(steps * v)
    if not q.size or np.abs(q).max() <= EXACT:
        return q
    whole = np.empty(q.size, object)
    whole[:] = [int(x) for x in q.ravel().tolist()]
    return whole.reshape(q.shape)


def best_first(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places in order of score, highest first, then id."""
    if scores.dtype != object:
        return np.lexsort((ids, -scores))
    return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), np.int64)


class Lists:
    """The vectors of a block and, for each dimension, their order by that component."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        self.order = np.argsort(v, axis=0, kind="stable")

    def search(self, q: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best for ``q``, without the row of id ``own``."""
        n, dims = self.v.shape
        seen = self.ids == own
        up, down = np.nonzero(q < 0)[0], np.nonzero(q > 0)[0]
        ids, scores = np.zeros(0, np.int64), np.zeros(0, self.v.dtype)
        low, depth = 0, FIRST_DEPTH
        while True:
            depth = min(depth, n)
            if len(up) + len(down):
                met = np.concatenate([self.order[low:depth, up].ravel(), self.order[n - depth:n - low, down].ravel()])
            else:
                met = np.arange(n)
            fresh = np.zeros(n, bool)
            fresh[met] = True
            fresh &= ~seen
            seen |= fresh
            new = np.nonzero(fresh)[0]
            ids = np.concatenate([ids, self.ids[new]])
            scores = np.concatenate([scores, self.v[new] @ q])
            top = best_first(ids, scores)[:k]
            ids, scores = ids[top], scores[top]
            if depth == n or not len(up) + len(down):
                return ids, scores
            bound = sum(
                (q[side] * self.v[self.order[at, side], side]).sum() for side, at in ((up, depth - 1), (down, n - depth))
            )
            if len(ids) == k and scores[-1] > bound:
                return ids, scores
            low, depth = depth, 2 * depth


def top_k(rows: DataFrame, queries: Column, k: int = 5, steps: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``queries`` chooses, the k rows with the highest
    inner product of floor(steps * component), its own left out; all of them if there are fewer.

    ``rows`` is ``vectors.usable``. Ties go to the smaller vec_id; repeated rows count once; vectors
    of another length than the query's are no candidates; no rows give no rows. Scores beyond 64 bits
    are held to that range.
    """

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, v = arrays(left)
        owns, asked = arrays(right)
        both = quantised(np.concatenate([v, asked]), steps)
        lists, found = Lists(ids, both[:len(v)]), []
        for own, q in zip(owns.tolist(), both[len(v):]):
            got, scores = lists.search(q, k, own)
            scores = [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in scores]
            found.append((np.full(len(got), own), got, np.array(scores, np.int64)))
        return as_table(*(map(list, zip(*found)) if found else ([], [], [])), pa.int64())

    return best(against_all(rows, queries, work, "long"), k)
