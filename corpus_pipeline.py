"""A training corpus from ``documents``, in five stages.

Each stage gets what its predecessor kept, with the columns of ``documents``; between stages the rows
are written as Parquet to the shared folder and read again.

1. toxicity: rows predicted toxic by the learnt lexicon go. Its labels are joined from ``labels``.
2. near_duplicates: one document of each near-duplicate group stays, the one with the smallest id.
3. secrets: spans of secrets are replaced by a mark; every row stays.
4. mix: sources are brought to their target weights; rows are repeated or cut as the mix says.
5. token_ids: encoded by byte-level BPE and decoded; columns doc_id, n_tokens, the digests of the
   ids and of the decoded bytes, and the ids (little-endian, 32 bits).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlark.llm import bpe, minhash, mixing, secret_scan, toxicity
from buildlark.session import settle, ship_package


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean_rows(docs, lexicon)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return minhash.one_of_each(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.mixed_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("secrets", remove_secrets),
    ("mix", mix_sources),
    ("token_ids", encode),
]

#: A learnt lexicon and minima are not SQL; tests/llm/test_pipeline.py holds the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
