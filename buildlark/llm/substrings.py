"""Removal of repeated passages by prefix-partitioned suffix trees over words.

Every word begins a suffix; only its first 13 words matter here, so trees end at that depth. Suffixes
are named by 64-bit fingerprints of their first words. They are dealt to groups by a prefix of 4 words,
or of 8 or 13 where a shorter one is frequent, so that a group fits in memory. Within a group the
suffixes are sorted by fingerprint; runs of equal ones are the nodes of full depth, and neighbouring
ones along a text make its maximal repeats.

Texts are held in blocks of neighbouring ids. A block sends each different suffix once, so a passage
that many documents share is combined before the shuffle. The group answers with one bit for each:
whether a block of smaller ids has it too. Which document of one block came first the block knows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlark.llm.words import STEP, U, byte_texts, hash_words, mix, window_hashes
from buildlark.operators.ordering import quantile_buckets
from buildlark.session import settle

WINDOW = 13
#: Lengths of prefixes that suffixes are grouped by; the next one is taken where one is frequent.
PREFIXES = (4, 8, WINDOW)
#: A prefix is frequent if it begins this share of the sampled suffixes; so there are few of them.
FREQUENT = 1 / 1024
#: One in so many suffixes is sampled to find them. They only spread the work.
SAMPLED = 16
#: Bytes of text in a block and, about, for a group.
BLOCK_BYTES, GROUP_BYTES = 4_000_000, 2_000_000
#: Quantiles of the ids that come to the driver; more blocks than that cut each range evenly.
CUTS = 1_024


def _prefixes(words: np.ndarray, n: int) -> list[np.ndarray]:
    return [window_hashes(words, k, STEP[1])[:n] for k in PREFIXES]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of text (level -1), sampled suffixes (level -2), and the frequent prefixes among these."""
    for batch in batches:
        for _, texts in byte_texts(batch):
            words, _ = hash_words(texts)
            n = max(0, len(words) - WINDOW + 1)
            rows = [(-1, 0, sum(map(len, texts)))]
            if n:
                own = np.arange(0, n, SAMPLED)
                rows.append((-2, 0, len(own)))
                for level, p in enumerate(_prefixes(words, n)[:-1]):
                    value, times = np.unique(p[own], return_counts=True)
                    some = times >= max(2, len(own) * FREQUENT / 2)
                    rows += [(level, int(v), int(t)) for v, t in zip(value[some].astype(np.int64), times[some])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["level", "prefix", "n"])


class _Suffixes:
    """The different suffixes of a block, in the order in which they are sent, and where each word's is."""

    def __init__(self, table: pa.Table, frequent: list[np.ndarray], groups: int):
        ids = table.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.order = ids[order], order
        texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
        self.texts = [texts[i] for i in order]
        words, self.at = hash_words(self.texts)
        n = max(0, len(words) - WINDOW + 1)
        n_words = np.diff(self.at)
        self.text_of = np.repeat(np.arange(len(self.texts)), n_words)
        self.starts = np.nonzero(self.text_of[:n] == self.text_of[WINDOW - 1:n + WINDOW - 1])[0] if n else np.zeros(0, np.int64)
        name = window_hashes(words, WINDOW)[self.starts]
        value, first, self.which = np.unique(name, return_index=True, return_inverse=True)
        prefix = _prefixes(words, n) if n else [np.zeros(0, U)] * len(PREFIXES)
        at = self.starts[first]
        key = prefix[0][at]
        for level, many in enumerate(frequent):
            longer = np.isin(key, many) if len(many) else np.zeros(len(key), bool)
            key = np.where(longer, prefix[level + 1][at], key)
        group = (mix(key) % U(groups)).astype(np.int64)
        self.sent = np.argsort(group, kind="stable")
        self.group = group[self.sent]
        self.value = value[self.sent]
        self.first_id = self.ids[self.text_of[at]] if len(at) else np.zeros(0, np.int64)

    def parcels(self) -> list[tuple[int, int, int]]:
        """Group and range of the sent suffixes that go to it."""
        own, begin = np.unique(self.group, return_index=True)
        return list(zip(own.tolist(), begin.tolist(), [*begin[1:].tolist(), len(self.group)]))


def _send(frequent: list[np.ndarray], groups: int):
    def work(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        suffixes = _Suffixes(table, frequent, groups) if block >= 0 else None
        parcels = suffixes.parcels() if suffixes else []
        return pa.table({
            "group": pa.array([g for g, _, _ in parcels], pa.int64()),
            "block": pa.array([block] * len(parcels), pa.int64()),
            "names": pa.array([suffixes.value[a:b].tobytes() for _, a, b in parcels], pa.binary()),
        })

    return work


def _answer(table: pa.Table) -> pa.Table:
    """One bit for each suffix that a block sent: whether a block of smaller ids sent it too."""
    blocks = table.column("block").to_numpy()
    order = np.argsort(blocks, kind="stable")
    names = [np.frombuffer(x, U) for x in table.column("names").to_pylist()]
    names = [names[i] for i in order]
    lengths = np.array([len(x) for x in names])
    value = np.concatenate(names)
    by_name = np.argsort(value, kind="stable")
    sorted_ = value[by_name]
    later = np.zeros(len(value), bool)
    later[by_name[1:]] = sorted_[1:] == sorted_[:-1]
    ends = np.cumsum(lengths)
    return pa.table({
        "group": table.column("group"),
        "block": pa.array(blocks[order]),
        "later": pa.array([np.packbits(later[a:b]).tobytes() for a, b in zip(ends - lengths, ends)], pa.binary()),
    })


def _remove(frequent: list[np.ndarray], groups: int, with_text: bool):
    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        suffixes = _Suffixes(docs, frequent, groups)
        n_words = np.diff(suffixes.at)
        gone = np.zeros(int(suffixes.at[-1]) + 1, np.int64)
        if len(suffixes.starts) and docs.column("block")[0].as_py() >= 0:
            bits = dict(zip(answers.column("group").to_pylist(), answers.column("later").to_pylist()))
            later = np.zeros(len(suffixes.value), bool)
            for g, a, b in suffixes.parcels():
                later[suffixes.sent[a:b]] = np.unpackbits(np.frombuffer(bits[g], np.uint8), count=b - a).astype(bool)
            own = suffixes.ids[suffixes.text_of[suffixes.starts]]
            repeated = suffixes.starts[later[suffixes.which] | (own > suffixes.first_id[suffixes.which])]
            np.add.at(gone, repeated, 1)
            np.add.at(gone, repeated + WINDOW, -1)
        removed = np.cumsum(gone)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(removed)])
        n_removed = total[suffixes.at[1:]] - total[suffixes.at[:-1]]
        kept = []
        for t, a, b, n in zip(suffixes.texts, suffixes.at[:-1].tolist(), suffixes.at[1:].tolist(), n_removed.tolist()):
            words = t.split()
            kept.append(b" ".join(words if not n else [w for w, r in zip(words, removed[a:b].tolist()) if not r]))
        doc_id = docs.column("doc_id").take(pa.array(suffixes.order))
        out = {
            "doc_id": doc_id, "n_words": pa.array(n_words), "n_removed": pa.array(n_removed),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
        }
        return pa.table(out | ({"kept": pa.array(kept, pa.binary()).cast(pa.string())} if with_text else {}))

    return work


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, ``with_text``, the ``kept`` words of each row.

    Words are runs of bytes other than ASCII white space. A word goes if a window of 13 words of its
    text covers it whose words also follow one another in a text with a smaller doc_id. NULL and empty
    texts have no words; rows that share an id do not remove from each other; rows with a NULL id have
    no place in the order: nothing is removed from them nor because of them. Other columns are ignored;
    no rows give no rows. Fingerprints of 64 bits, and the group, stand for the words of a window.
    """
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # Partial counts, one small row set per task; totals first, as they say what is frequent.
    counts = settle(
        slim.mapInArrow(_count, "level long, prefix long, n long").groupBy("level", "prefix").agg(F.sum("n").alias("n")), "prefixes")
    total = {r["level"]: r["n"] for r in counts.where("level < 0").collect()}
    bytes_, sampled = total.get(-1, 0), total.get(-2, 0)
    rows = counts.where((F.col("level") >= 0) & (F.col("n") >= max(2, sampled * FREQUENT))).collect()
    frequent = [np.array([r["prefix"] for r in rows if r["level"] == k], np.int64).view(U) for k in range(len(PREFIXES) - 1)]
    groups, n_blocks = max(1, -(-bytes_ // GROUP_BYTES)), max(1, -(-bytes_ // BLOCK_BYTES))
    blocked = _blocked(slim, n_blocks)
    parcels = blocked.groupBy("block").applyInArrow(_send(frequent, groups), "group long, block long, names binary")
    answers = parcels.groupBy("group").applyInArrow(_answer, "group long, block long, later binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_remove(frequent, groups, with_text), schema)


def _blocked(slim: DataFrame, n_blocks: int) -> DataFrame:
    """Add ``block``, which does not fall as doc_id grows; rows without an id get negative ones."""
    cuts = max(2, min(n_blocks, CUTS))
    cut = quantile_buckets(slim, "doc_id", "_cut", cuts)
    block, each = F.col("_cut").cast("long"), -(-n_blocks // cuts)
    if each > 1:
        edges = cut.where("doc_id IS NOT NULL").groupBy("_cut").agg(
            F.min("doc_id").cast("double").alias("_low"), F.max("doc_id").cast("double").alias("_high"))
        cut = cut.join(F.broadcast(edges), "_cut", "left")
        part = F.floor((F.col("doc_id").cast("double") - F.col("_low")) * each / (F.col("_high") - F.col("_low") + 1))
        block = block * each + part
    apart = -1 - F.pmod(F.xxhash64("text"), F.lit(n_blocks))
    return cut.withColumn("block", F.when(F.col("doc_id").isNull(), apart).otherwise(block).cast("long")).select("doc_id", "text", "block")
