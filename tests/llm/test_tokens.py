"""Byte-level BPE and token files against the libraries."""

import base64
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from buildlark.llm import bpe, token_files

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
HARD = [
    "", None, " ", "\n", "a\nb", "\n\na  b \n c", " lead", "trail ", "é中文 😀😀  x", "can't I'll  '", "a" * 3_000, "中" * 700, "\x1c \x85  z",
    "<|endoftext|> x", "word " * 20_000, "\r\n\r\n", "x\n y\n\nz", " a 　b", "1234 56,78.9", "\t\tdef f():\n    return 1\n",
]


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def texts_of(spark, sf):
    rng = random.Random(9)
    letters = "ab \n\t 　é中'’s.,!​И😀\x1c\x85Ⅷ٣"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1_500)]
    real = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    return HARD + made + real


def test_bpe_equals_library(spark, sf, tik):
    rows = list(enumerate(texts_of(spark, sf))) + [(None, "no id"), (3, HARD[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit(1))
    got = bpe.round_trip(df, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(got) == len(rows)
    by = dict(rows)
    for r in got:
        text = by[r.doc_id] or ""
        ids = tik.encode_ordinary(text)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("size", [None, 50])
def test_files_equal_library(spark, sf, tok, monkeypatch, size):
    if size:
        for name, value in (("SHARD_BYTES", 20_000), ("BLOCK_IDS", size), ("BUCKET_KEYS", 40)):
            monkeypatch.setattr(token_files, name, value)
    texts = texts_of(spark, sf)
    rng = random.Random(1)
    ids = rng.sample(range(-10**12, 10**12), len(texts))
    rows = list(zip(ids, texts)) + [(None, "none"), (None, None), (ids[4], "again"), (ids[4], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x")).repartition(3)
    got = token_files.read(spark, token_files.write(df, JSON), token_files.keys_of(df), with_ids=True).collect()
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        own = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want


def test_query_equals_the_unmodified_library(spark, tmp_path):
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"x  {end}  y", f"a\n{end}\nb\n\n{end}", f"{end} lead and{end}glued", "<|endof text|>", "plain words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    own = Tokenizer.from_file(JSON)
    assert own.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    start, want = 0, []
    for i, t in enumerate(texts):
        ids = np.array(own.encode(t, add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = entry.queries()["op4_token_files"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_tokens_that_take_in_spaces_are_encoded_whole():
    spec = json.loads(open(JSON).read())
    spec["added_tokens"][0] |= {"lstrip": True, "rstrip": True}
    definition = json.dumps(spec)
    text = "a <|endoftext|> b  <|endoftext|>\nc"
    got = token_files.library_encoder(definition, False).encode([text, "d"])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [
        Tokenizer.from_str(definition).encode(t, add_special_tokens=False).ids for t in (text, "d")]


def test_index_knows_what_is_missing(spark):
    df = spark.createDataFrame([(i * 7, f"text {i}") for i in range(3_000)], "doc_id long, text string")
    files = token_files.write(df, JSON)
    keys = spark.range(0, 21_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("repeat"))
    found = {r.doc_id for r in token_files.look_up(spark, files, keys).collect()}
    assert {i * 7 for i in range(3_000)} <= found and len(found) < 3_010
    none = token_files.write(df.limit(0), JSON)
    assert token_files.read(spark, none, token_files.keys_of(df)).count() == 0


def test_query_reads_all_documents(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = sorted(entry.queries()["op4_token_files"](spark, sf).collect(), key=lambda r: r.doc_id)
    assert len(rows) == n and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:])) and rows[0].start == 0


def test_parts_encoded_together_equal_the_library(monkeypatch):
    monkeypatch.setattr(token_files, "TOGETHER", 3)
    definition, own = open(JSON).read(), Tokenizer.from_file(JSON)
    texts = [
        "", " ", "\n", "a b c d e f g", "über straße  naïve\tcafé  x", "trailing space ", "\n\nlines\n here \n",
        "<|endoftext|> a<|endoftext|>b <|endoftext|>", "don't we'll I'M 12 345.67 !!! 日本 語 \U0001f600 \U0001f600", "x\x1cy z\x85w q​v",
    ]
    for width in (2, 4):
        got = token_files.library_encoder(definition, False, width).encode(texts + texts[::-1])
        assert [np.frombuffer(g, f"<u{width}").tolist() for g in got] == [
            own.encode(t, add_special_tokens=False).ids for t in texts + texts[::-1]]


def test_tokenizer_with_a_normalizer_is_encoded_part_by_part():
    spec = json.loads(open(JSON).read())
    spec["normalizer"] = {"type": "Lowercase"}
    definition = json.dumps(spec)
    text = "Some Words İN Upper case"
    got = token_files.library_encoder(definition, False).encode([text])
    assert np.frombuffer(got[0], "<u4").tolist() == Tokenizer.from_str(definition).encode(text, add_special_tokens=False).ids
