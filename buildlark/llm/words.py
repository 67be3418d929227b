"""Words of many texts as 64-bit hashes, computed together on numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))

#: Bytes of text that are hashed together.
AT_ONCE = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits (a bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, 1 << 16), base, U)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=U)
    return _powers[name][:n]


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than white space."""
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = np.concatenate([[False], ~SPACE[np.frombuffer(raw, np.uint8)], [False]])
    edges = np.nonzero(solid[1:] != solid[:-1])[0]
    return edges[::2], edges[1::2]


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts in turn, and the index of the first word of each text (one more at the end)."""
    raw = b" ".join(texts) + b" "
    starts, ends = word_spans(raw)
    n = len(raw)
    sums = np.zeros(n + 1, U)
    np.cumsum(BYTE[np.frombuffer(raw, np.uint8)] * _power("forward", BASE, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power("back", BASE_INVERSE, n)[starts])
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text_at = np.concatenate([[0], np.cumsum(lengths)])
    return hashes, np.searchsorted(starts, text_at)


def window_hashes(words: np.ndarray, size: int, step: np.uint64 = STEP[0]) -> np.ndarray:
    """Hash of the ``size`` words from each word on; the last ``size - 1`` are missing."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out, factor = words[:n].copy(), step
    for k in range(1, size):
        out += words[k:n + k] * factor
        factor = U(int(factor) * int(step) % (1 << 64))
    return mix(out)


def byte_texts(batch: pa.RecordBatch, lower: bool = False, column: str = "text"):
    """First row and UTF-8 texts (NULL: empty) of runs of rows with about ``AT_ONCE`` bytes."""
    texts = batch.column(column).cast(pa.binary())
    start, held, size = 0, [], 0
    for i in range(batch.num_rows):
        t = texts[i].as_py() or b""
        held.append(t.translate(LOWER) if lower else t)
        size += len(t)
        if size >= AT_ONCE:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held
    # The worker lives on; what Arrow has freed goes back to the system.
    pa.default_memory_pool().release_unused()


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with columns ``c0``, ``c1``, ..., so that no name clashes with one that is added."""
    return rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
