"""Byte-level BPE encoding and decoding.

Each piece of the split pattern keeps its bytes in a row of live positions and a segment tree over
them whose leaves hold (rank of the pair that starts here, position); the root is the leftmost pair
of least rank. A merge joins two live neighbours and updates three leaves and the paths above them.
The trees of many different pieces of about one length lie in the rows of one array and are
advanced together, one merge of each per step; a long piece gets a tree of its own.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlark.llm.pieces import PartEncoder, text_groups

NONE = np.iinfo(np.int64).max
#: Pieces of more bytes than this are merged one by one.
TOGETHER = 64
ROWS = 20_000
#: Parts a worker remembers. Workers live on into later stages, where what they hold is missed.
REMEMBERED = 150_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(text: bytes) -> dict[bytes, int]:
    """The ranks of a file of lines "base64 of the bytes, rank"."""
    pairs = (line.split() for line in text.splitlines() if line.strip())
    return {base64.b64decode(a): int(b) for a, b in pairs}


class Bpe:
    """Merges by rank, for one vocabulary and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"ranks lack the single bytes {missing[:5]}")
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {
            (ranks[t[:i]] << 32) | ranks[t[i:]]: r
            for t, r in ranks.items() for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }
        self.pairs = pairs
        #: The pairs by hash, with open addressing, for looking up many at once.
        self.slot_bits = max(4, len(pairs).bit_length() + 3)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        self.slot_key = np.full(1 << self.slot_bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.slot_bits, -1, np.int64)
        at, ranked = self._slot(keys), np.fromiter(pairs.values(), np.int64, len(pairs))
        while len(keys):
            free = self.slot_key[at] < 0
            self.slot_key[at[free]] = keys[free]
            mine = self.slot_key[at] == keys
            self.slot_rank[at[mine]] = ranked[mine]
            keys, ranked, at = keys[~mine], ranked[~mine], (at[~mine] + 1) % len(self.slot_key)
        self.text = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the pair, or a negative number if it is none."""
        key = (left << 32) | right
        at = self._slot(key)
        held = self.slot_key.take(at)
        rank = np.where(held == key, self.slot_rank.take(at), -1)
        open_ = np.nonzero((held != key) & (held >= 0))[0]
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.slot_key)
            held = self.slot_key[at[open_]]
            hit = held == key[open_]
            rank[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return rank

    def _merge_together(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of 2 to ``width`` bytes; ``width`` is a power of two."""
        n = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
        ids = self.byte_id[raw].reshape(n, width)
        place = np.arange(width)
        after = np.broadcast_to(place + 1, (n, width)).copy()
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE, np.int64)
        row, col = np.nonzero(place[None, :-1] + 1 < lens[:, None])
        rank = self._rank(ids[row, col], ids[row, col + 1])
        ok = rank >= 0
        tree[row[ok], width + col[ok]] = rank[ok] * width + col[ok]
        node = width
        while node > 1:
            half = node // 2
            tree[:, half:node] = np.minimum(tree[:, node:2 * node:2], tree[:, node + 1:2 * node:2])
            node = half
        gone = place[None, :] >= lens[:, None]
        flat_tree, flat_ids, flat_gone = tree.reshape(-1), ids.reshape(-1), gone.reshape(-1)
        flat_after, flat_before = after.reshape(-1), before.reshape(-1)
        live = np.nonzero(flat_tree[1::2 * width] != NONE)[0]
        while len(live):
            base, top = live * width, live * (2 * width)
            merged, at = np.divmod(flat_tree.take(top + 1), width)
            right = flat_after.take(base + at)
            beyond = flat_after.take(base + right)
            flat_ids[base + at] = merged
            flat_gone[base + right] = True
            flat_after[base + at] = beyond
            flat_tree[top + width + right] = NONE
            more = np.nonzero(beyond < lens.take(live))[0]
            flat_before[base[more] + beyond[more]] = at[more]
            own = np.full(len(live), NONE, np.int64)
            rank = self._rank(merged[more], flat_ids.take(base[more] + beyond[more]))
            own[more] = np.where(rank >= 0, rank * width + at[more], NONE)
            flat_tree[top + width + at] = own
            left = flat_before.take(base + at)
            has = np.nonzero(left >= 0)[0]
            left = left[has]
            rank = self._rank(flat_ids.take(base[has] + left), merged[has])
            flat_tree[top[has] + width + left] = np.where(rank >= 0, rank * width + left, NONE)
            for root, leaf in ((top, right), (top, at), (top[has], left)):
                node = (width + leaf) >> 1
                for _ in range(width.bit_length() - 1):
                    below = root + 2 * node
                    flat_tree[root + node] = np.minimum(flat_tree.take(below), flat_tree.take(below + 1))
                    node >>= 1
            live = live[flat_tree.take(top + 1) != NONE]
        kept = ~gone
        flat = ids[kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.sum(axis=1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _merge_alone(self, piece: bytes) -> bytes:
        """The same for one long piece, with plain lists."""
        n, pairs = len(piece), self.pairs
        width = 1 << (n - 1).bit_length()
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        none = int(NONE)
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = pairs.get((ids[i] << 32) | ids[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, value: int) -> None:
            node = width + leaf
            tree[node] = value
            node >>= 1
            while node:
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        while tree[1] != none:
            merged, at = divmod(tree[1], width)
            right = after[at]
            beyond = after[right]
            ids[at], gone[right], after[at] = merged, 1, beyond
            put(right, none)
            r = None
            if beyond < n:
                before[beyond] = at
                r = pairs.get((merged << 32) | ids[beyond])
            put(at, none if r is None else r * width + at)
            left = before[at]
            if left >= 0:
                r = pairs.get((ids[left] << 32) | merged)
                put(left, none if r is None else r * width + left)
        return np.array([i for i, g in zip(ids, gone) if not g], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of each piece; one that is a token itself is that token."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            r = self.ranks.get(p)
            if r is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(p) > TOGETHER:
                out[i] = self._merge_alone(p)
            elif p:
                by_width.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for width, held in by_width.items():
            for k in range(0, len(held), ROWS):
                some = held[k:k + ROWS]
                for i, ids in zip(some, self._merge_together([pieces[i] for i in some], width)):
                    out[i] = ids
        return out

    def encode_parts(self, inner: list[str], heads: list[str]) -> list[bytes]:
        """``inner`` parts follow on one another, so they are split together."""
        pieces = self.split("".join(inner))
        held = []
        following = iter(pieces)
        for part in inner:
            own, left = [], len(part)
            while left > 0:
                own.append(piece := next(following))
                left -= len(piece)
            held.append(own)
        held += [self.split(h) for h in heads]
        different = list({x for own in held for x in own})
        ids = dict(zip(different, self.encode_pieces([x.encode() for x in different])))
        return [ids[own[0]] if len(own) == 1 else b"".join([ids[x] for x in own]) for own in held]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of all ids, one after the other."""
        i = np.frombuffer(ids, "<u4")
        length = self.length[i]
        ends = np.cumsum(length)
        from_ = np.repeat(self.start[i] - (ends - length), length)
        return self.text[from_ + np.arange(len(from_))].tobytes()


_made: dict[tuple[int, str], tuple[Bpe, PartEncoder]] = {}


def encoder(ranks_file: bytes, pattern: str) -> tuple[Bpe, PartEncoder]:
    """The encoder of this Python worker, made once."""
    key = (hash(ranks_file), pattern)
    if key not in _made:
        bpe = Bpe(read_ranks(ranks_file), pattern)
        _made[key] = bpe, PartEncoder(bpe.encode_parts, REMEMBERED)
    return _made[key]


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256 and, ``with_ids``, the ids themselves as
    ``ids binary`` (little-endian, 32 bits). A NULL text counts as empty (0 ids); a NULL doc_id
    stays NULL; repeated rows give repeated rows; other columns are ignored. The rank file, whose
    size is that of the vocabulary, is read by the driver and broadcast.
    """
    with open(ranks_path, "rb") as f:
        shared: Broadcast[bytes] = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # no cycles arise below, and scanning the remembered parts would cost most of the time
        bpe, parts = encoder(shared.value, pattern)
        for batch in batches:
            for start, texts in text_groups(batch):
                ids = parts.encode(texts)
                cols = [
                    batch.column("doc_id").slice(start, len(texts)),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(work, SCHEMA + (", ids binary" if with_ids else ""))
