"""Token ids in shard files, with a minimal perfect hash index for access by key.

Format. ``data``: Parquet rows of one block each, (block, payload, doc_ids, repeats, lengths): the raw
little-endian ids of neighbouring documents in ascending order of id, 16 bits wide where the vocabulary
allows it and 32 otherwise. The upper bits of ``block`` are the shard, which is a range of ids and a set
of files. ``index``: one row per bucket of keys. A key is (doc_id, number of the repeat). Within its
bucket a key hashes to a group, the group's stored displacement hashes it to a slot of its own, and the
bucket has as many slots as keys. A slot holds the key's fingerprint, block, offset and length in ids,
and the number of ids before it. A look-up is two hashes and one comparison; a key that was never
stored is told by its fingerprint.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlark.llm.pieces import PartEncoder, text_groups
from buildlark.llm.words import U, mix
from buildlark.session import new_table_path

#: Bytes of text in a shard; ids in a block; keys in a bucket and in a group of it, about.
SHARD_BYTES, BLOCK_IDS, BUCKET_KEYS, GROUP_KEYS = 16_000_000, 250_000, 2_000, 4
DATA = "block long, payload binary, doc_ids array<long>, repeats array<int>, lengths array<int>"
INDEX = (
    "bucket long, displacements binary, fingerprints binary, blocks binary, offsets binary, lengths binary, befores binary"
)


@dataclass
class TokenFiles:
    """Where the files are, and what is needed to read them."""

    data: str
    index: str
    buckets: int
    width: int


def key_hash(doc_id: np.ndarray, repeat: np.ndarray, null: np.ndarray) -> np.ndarray:
    """64 bits for a key; never the same for two ids that occur once."""
    return mix(mix(doc_id.astype(np.int64).view(U)) + repeat.astype(U) * U(0x9E3779B97F4A7C15) + null.astype(U) * U(0x632BE59BD9B4E019))


def _slots(h: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    return (mix(h + displacement.astype(U) * U(0xD6E8FEB86659FD93)) % U(n)).astype(np.int64)


def _groups(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h ^ U(0xA0761D6478BD642F)) % U(-(-n // GROUP_KEYS))).astype(np.int64)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ U(0x8EBC6AF09C88C6E3)) >> U(32)).astype(np.uint32)


def displacements(h: np.ndarray) -> np.ndarray:
    """For each group of keys, largest first, the least displacement that puts them on free slots."""
    n = len(h)
    group = _groups(h, n)
    out, taken = np.zeros(-(-n // GROUP_KEYS), np.uint32), np.zeros(n, bool)
    order = np.argsort(group, kind="stable")
    own, begin, size = np.unique(group[order], return_index=True, return_counts=True)
    for k in np.argsort(-size, kind="stable").tolist():
        keys = h[order[begin[k]:begin[k] + size[k]]]
        low = 0
        while True:
            tries = np.arange(low, low + 64)
            at = np.sort(_slots(keys[None, :], tries[:, None], n), axis=1)
            good = ~taken[at].any(axis=1) & (at[:, 1:] != at[:, :-1]).all(axis=1)
            if good.any():
                first = int(np.argmax(good))
                out[own[k]] = low + first
                taken[at[first]] = True
                break
            low += 64
            if low > 1 << 31:
                raise ValueError("two keys have the same hash")
    return out


def locate(h: np.ndarray, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each key in a bucket's row of the index, and whether its fingerprint is there."""
    stored = np.frombuffer(row["fingerprints"], np.uint32)
    moved = np.frombuffer(row["displacements"], np.uint32)
    at = _slots(h, moved[_groups(h, len(stored))], len(stored))
    return at, stored[at] == fingerprint(h)


def _keys(table: pa.Table) -> np.ndarray:
    ids = table.column("doc_id").combine_chunks()
    null = np.asarray(ids.is_null())
    return key_hash(ids.fill_null(0).to_numpy(), table.column("repeat").to_numpy(), null)


def _index(table: pa.Table) -> pa.Table:
    h = _keys(table)
    moved = displacements(h)
    at = _slots(h, moved[_groups(h, len(h))], len(h))
    back = np.argsort(at)
    cols = {c: table.column(c).to_numpy()[back] for c in ("block", "offset", "length", "before")}
    return pa.table({
        "bucket": table.column("bucket").slice(0, 1), "displacements": [moved.tobytes()], "fingerprints": [fingerprint(h)[back].tobytes()],
        "blocks": [cols["block"].astype("<i8").tobytes()], "offsets": [cols["offset"].astype("<i4").tobytes()],
        "lengths": [cols["length"].astype("<i4").tobytes()], "befores": [cols["before"].astype("<i8").tobytes()],
    })


def _look_up(keys: pa.Table, index: pa.Table) -> pa.Table:
    h = _keys(keys)
    if index.num_rows and len(h):
        row = index.to_pylist()[0]
        at, found = locate(h, row)
    else:
        at, found, row = np.zeros(len(h), np.int64), np.zeros(len(h), bool), None
    at = at[found]

    def held(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(row[name], kind)[at] if row else np.zeros(0, kind)

    return pa.table({
        "doc_id": keys.column("doc_id").filter(pa.array(found)), "block": held("blocks", "<i8"),
        "offset": held("offsets", "<i4"), "length": held("lengths", "<i4"), "before": held("befores", "<i8"),
    })


_encoders: dict[tuple[str, bool, int], PartEncoder | SimpleNamespace] = {}

#: Parts that are encoded as one text.
TOGETHER = 1_000


def _byte_lengths(spec: dict, vocab: dict[str, int]) -> np.ndarray | None:
    """Bytes that each id stands for, if the tokenizer is plain byte-level BPE, whose ids cover a text exactly."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if spec.get("normalizer") or not plain or model.get("type") != "BPE" or any(model.get(k) for k in odd):
        return None
    added = {a["content"] for a in spec.get("added_tokens") or []}
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token.encode()) if token in added else len(token)
    return out


def library_encoder(definition: str, special_as_text: bool, width: int = 4) -> PartEncoder | SimpleNamespace:
    """Encodes with the tokenizers library, in this Python worker, to ids of ``width`` bytes; special strings are
    ordinary text or get their id.

    Parts that follow a cut are encoded many at a time as one text, as most of the library's time is spent per
    call; their ids are told apart by the bytes they stand for. Texts are encoded whole if an added token holds
    white space or takes in what is around it."""
    key = (definition, special_as_text, width)
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own, spec = Tokenizer.from_str(definition), json.loads(definition)
        own.encode_special_tokens = special_as_text
        kind = f"<u{width}"
        lengths = _byte_lengths(spec, own.get_vocab())

        def separately(texts: list[str]) -> list[bytes]:
            out = []
            for k in range(0, len(texts), 5_000):
                out += [np.array(e.ids, kind).tobytes() for e in own.encode_batch_fast(texts[k:k + 5_000], add_special_tokens=False)]
            return out

        def together(parts: list[str]) -> list[bytes]:
            ids = np.array(own.encode_batch_fast(["".join(parts)], add_special_tokens=False)[0].ids, kind)
            ends = np.cumsum(lengths[ids])
            wanted = np.cumsum(np.fromiter((len(p) if p.isascii() else len(p.encode()) for p in parts), np.int64, len(parts)))
            at = np.searchsorted(ends, wanted)
            if ends[-1] != wanted[-1] or (ends[at] != wanted).any():
                return separately(parts)
            cuts = ((at + 1) * ids.itemsize).tolist()
            raw = ids.tobytes()
            return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

        def encode(inner: list[str], heads: list[str]) -> list[bytes]:
            if lengths is None:
                return separately(inner + heads)
            # What ends in white space may not be followed by another part.
            alone = [i for i, p in enumerate(inner) if p[-1].isspace()]
            apart = set(alone)
            joined = [i for i in range(len(inner)) if i not in apart] if alone else range(len(inner))
            out: list[bytes] = [b""] * len(inner)
            for k in range(0, len(joined), TOGETHER):
                some = joined[k:k + TOGETHER]
                for i, ids in zip(some, together([inner[i] for i in some])):
                    out[i] = ids
            rest = separately([inner[i] for i in alone] + heads)
            for i, ids in zip(alone, rest):
                out[i] = ids
            return out + rest[len(alone):]

        added = spec.get("added_tokens") or []
        whole = any(a.get("lstrip") or a.get("rstrip") or any(map(str.isspace, a["content"])) for a in added)
        made = SimpleNamespace(encode=separately) if whole else PartEncoder(encode)
        _encoders[key] = made
    return _encoders[key]


def _encode(definition: str, end_id: int, width: int, special_as_text: bool) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        gc.disable()
        encoder, kind = library_encoder(definition, special_as_text, width), f"<u{width}"
        last, repeat, block, held, size = object(), 0, None, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.array([b"".join(h[2] for h in held)], pa.binary()),
                pa.array([[h[0] for h in held]], pa.list_(pa.int64())), pa.array([[h[1] for h in held]], pa.list_(pa.int32())),
                pa.array([[len(h[2]) // width for h in held]], pa.list_(pa.int32())),
            ], ["block", "payload", "doc_ids", "repeats", "lengths"])

        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            ids, shards = batch.column("doc_id").to_pylist(), batch.column("shard").to_pylist()
            for start, texts in text_groups(batch):
                for i, raw in enumerate(encoder.encode(texts), start):
                    if block is None:
                        block = shards[i] << 32
                    repeat = repeat + 1 if ids[i] == last else 0
                    last = ids[i]
                    held.append((ids[i], repeat, raw + end))
                    size += len(held[-1][2])
                    if size >= BLOCK_IDS * width:
                        yield out()
                        block, held, size = block + 1, [], 0
        if held:
            yield out()

    return work


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 2, special_as_text: bool = True) -> TokenFiles:
    """Encode every whole text, append ``end_id``, and write data and index files.

    NULL and empty texts are just the end id. Documents are in ascending order of doc_id, NULL first;
    rows that share an id follow one another in order of text and are told apart by their number.
    Other columns are ignored; no rows give empty files. The tokenizer's definition is read by the
    driver; its size is that of the vocabulary. ``special_as_text=False`` is the library's own setting:
    strings like ``<|endoftext|>`` in a text get the special token's id.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    width = 2 if max(end_id, *Tokenizer.from_str(definition).get_vocab().values()) < 1 << 16 else 4
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = slim.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    order = F.col("doc_id").asc_nulls_first()
    ranged = slim.repartitionByRange(max(1, -(-size["b"] // SHARD_BYTES)), order).sortWithinPartitions(order, "text")
    shared = spark.sparkContext.broadcast(definition)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encode(shared.value, end_id, width, special_as_text)(batches)

    data, index = new_table_path(spark, "ids"), new_table_path(spark, "ids-index")
    ranged.withColumn("shard", F.spark_partition_id().cast("long")).mapInArrow(work, DATA).write.option("compression", "zstd").parquet(data)
    blocks = spark.read.schema(DATA).parquet(data).select("block", "doc_ids", "repeats", "lengths")
    buckets = max(1, -(-size["n"] // BUCKET_KEYS))
    _entries(blocks).withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInArrow(_index, INDEX).write.parquet(index)
    return TokenFiles(data, index, buckets, width)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "repeat"), F.lit(buckets)).cast("long")


def _entries(blocks: DataFrame) -> DataFrame:
    """A row for each document: key, block, offset, length and ids before it in all files."""
    shard = F.shiftright("block", 32)
    sized = blocks.select("block", shard.alias("shard"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sized.groupBy("shard").agg(F.sum("ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("base"))
    base = sized.withColumn("within", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(shards, "shard").select(
        "block", (F.col("base") + F.col("within")).alias("base"))
    placed = blocks.select("block", F.posexplode(F.arrays_zip("doc_ids", "repeats", "lengths")).alias("i", "d"))
    order = Window.partitionBy("block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("d.lengths").cast("long")).over(order), F.lit(0))
    return placed.withColumn("offset", offset).join(base, "block").select(
        F.col("d.doc_ids").alias("doc_id"), F.col("d.repeats").alias("repeat"), "block", "offset",
        F.col("d.lengths").alias("length"), (F.col("base") + F.col("offset")).alias("before"))


def look_up(spark: SparkSession, files: TokenFiles, keys: DataFrame) -> DataFrame:
    """``doc_id, block, offset, length, before`` of the keys (doc_id, repeat) that are in the files."""
    asked = keys.withColumn("bucket", bucket_of(files.buckets))
    index = spark.read.schema(INDEX).parquet(files.index)
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(
        _look_up, "doc_id long, block long, offset int, length int, before long")


def read(spark: SparkSession, files: TokenFiles, keys: DataFrame, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, ``with_ids``, ``ids binary`` of the keys, from the files.

    The places found in the index are gathered per block, which bounds them, and meet the payloads.
    """
    places = look_up(spark, files, keys).groupBy("block").agg(F.collect_list(F.struct("doc_id", "offset", "length", "before")).alias("places"))
    data = spark.read.schema(DATA).parquet(files.data).select("block", "payload")
    width = files.width

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                payload = batch.column("payload")[i].as_buffer()
                places = batch.column("places")[i].as_py()
                ids = [
                    np.frombuffer(payload, f"<u{width}", p["length"], p["offset"] * width).astype("<u4").tobytes() for p in places
                ]
                cols = [
                    pa.array([p["doc_id"] for p in places], pa.int64()), pa.array([p["before"] for p in places], pa.int64()),
                    pa.array([p["length"] for p in places], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return data.join(places, "block").mapInArrow(work, schema)


def keys_of(docs: DataFrame) -> DataFrame:
    """The keys (doc_id, repeat) of all rows of ``docs``."""
    counted = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("repeat"))
