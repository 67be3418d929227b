"""Removal of repeated passages against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from buildlark.llm import substrings
from tests.llm import brute


def check(rows, got):
    want = brute.dedup(rows)
    assert len(got) == len(want)
    for r in got:
        n, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed) == (n, n - len(kept)), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, entry.queries()["op2_substring_dedup"](spark, sf).collect())


@pytest.mark.parametrize("size", [4_000_000, 3_000])
def test_cases(spark, monkeypatch, size):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", size)
    monkeypatch.setattr(substrings, "GROUP_BYTES", size)
    monkeypatch.setattr(substrings, "CUTS", 7)
    rng = random.Random(2)
    passage = [f"p{k}" for k in range(60)]
    rows = [(-5, " ".join(passage[:13])), (0, ""), (1, None), (2, " \t\n"), (3, " ".join(passage[:12])), (2**60, "tail " * 30_000)]
    for i in range(10, 150):
        w = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(80))]
        k, a = rng.randrange(len(w) + 1), rng.randrange(40)
        rows.append((i * 1000, "\x0b".join(w[:k] + passage[a:a + rng.randrange(30)] + w[k:]) + " x"))
    rows += [(7, "same same " * 40), (2**60 + 1, rows[40][1]), (2**60 + 3, "tail " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x")).withColumn("n_words", F.lit(1))
    check(rows, substrings.remove_repeats(df.repartition(3)).collect())


def test_nulls_and_shared_ids(spark):
    t = " ".join(f"w{k}" for k in range(20))
    rows = [(None, t), (None, t), (4, t), (4, t), (9, "x " + t + " y")]
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert sorted(((r.doc_id or 0), r.n_removed) for r in out) == [(0, 0), (0, 0), (4, 0), (4, 0), (9, 20)]
    assert [r.kept for r in out if r.doc_id == 9] == ["x y"]
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
