"""Exact and approximate searches against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from buildlark.llm import ann, topk, vectors
from tests.oracle import compare, connect

NAN, INF = float("nan"), float("inf")


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("x")).withColumn("score", F.lit(1))


def odd_rows():
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.5, 0.25, 0.5, 3.0]) for _ in range(6)]) for i in range(120)]
    rows += [(200, None), (201, [NAN] * 6), (202, [INF, 0.0, 0.0, 0.0, 0.0, 0.0]), (203, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 6)]
    return rows + [(250, [0.0] * 6), (300, [1.0, 2.0]), (350, [2.0, 1.0]), (50, rows[50][1]), (400, [1e-30] * 6), (401, [2e30] * 6)]


def used(rows, zero):
    out = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out[i] = np.float32(v).astype(float)
    return out


def test_top_k_equals_duckdb(spark, sf):
    name = "op3_exact_top_k"
    assert compare(name, spark, connect(sf), sf, entry.queries()[name], entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("block", [4096, 16])
def test_top_k_cases(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "PART", 3)
    rows = odd_rows()
    got = topk.top_k(vectors.usable(rows_of(spark, rows)), F.col("vec_id") % 50 == 0).collect()
    use = used(rows, True)
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in use.items()}
    want = []
    for q in use:
        if q % 50 == 0:
            scored = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(whole[q], w)))), i) for i, w in whole.items() if i != q and len(w) == len(whole[q]))
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:5], 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(vectors.usable(rows_of(spark, rows).limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def brute_cosine(use, k=5):
    out = {}
    for q in use:
        if q % 50 == 0:
            u = use[q] / np.abs(use[q]).max()
            scored = []
            for i, v in use.items():
                if i != q and len(v) == len(u):
                    w = v / np.abs(v).max()
                    scored.append((-float((u * w).sum() / (np.sqrt((u * u).sum()) * np.sqrt((w * w).sum()))), i))
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute_cosine(used(rows, False))
    got = entry.queries()["op9_multiprobe_nearest"](spark, sf_dir).collect()
    assert len(got) == 5 * len(want)
    hit = {(r.query_id, r.vec_id): r.score for r in got}
    both = [(hit[q, i], s) for q, near in want.items() for i, s in near if (q, i) in hit]
    assert len(both) >= 0.9 * len(got)
    assert all(a == pytest.approx(b, abs=1e-12) for a, b in both)


def test_nearest_cases(spark):
    rows = odd_rows()
    got = ann.nearest(vectors.usable(rows_of(spark, rows), zero=False), F.col("vec_id") % 50 == 0).collect()
    want = brute_cosine(used(rows, False))
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: len(x) for q, x in by.items()} == {q: len(x) for q, x in want.items() if x}
    assert [i for i, _ in by[300]] == [350]
    for q, near in by.items():
        assert all(a >= b - 1e-12 for (_, a), (_, b) in zip(near, near[1:]))
        assert near[0][1] == pytest.approx(want[q][0][1], abs=1e-9)
    assert ann.nearest(vectors.usable(rows_of(spark, rows).limit(0), zero=False), F.col("vec_id") % 50 == 0).count() == 0
