"""Near-duplicates and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from buildlark.llm import minhash
from buildlark.llm.components import components
from buildlark.llm.words import hash_words, window_hashes
from tests.llm import brute


def test_hashes_tell_words_apart():
    texts = [b"", b" a  b\ta\nb ", "é ü é".encode(), b"ab c", b"a bc", b"x" * 3_000]
    words, at = hash_words(texts)
    flat = [w for t in texts for w in t.split()]
    assert np.diff(at).tolist() == [len(t.split()) for t in texts]
    by = {}
    for w, h in zip(flat, words.tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    assert window_hashes(words[:2], 3).size == 0
    assert window_hashes(words[:4], 2)[0] == window_hashes(words[:4], 2)[2]


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (300, 250), (None, 4)]
    edges += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((root(u), root(v)))
            up[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for n in up}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute.components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = entry.queries()["op6_minhash_dedup"](spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(want)


def test_cases(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, ("\n" if i % 2 else " ").join(w).upper() if i % 3 else " ".join(w)))
    chain = [f"c{k}" for k in range(300)]
    rows += [(100 + k, " ".join(chain[k * 8:k * 8 + 200])) for k in range(12)]
    rows += [(200, ""), (201, None), (202, " \t\n"), (203, "a b c"), (204, "A  b C"), (205, "a b"), (206, "a b c d e"), (300, "long " * 60_000), (301, "long " * 50_000)]
    rows += [(250, " ".join(base[60:] + base[:60])), (7, rows[7][1])]
    df = spark.createDataFrame(rows + [(None, " ".join(base)), (None, "a b c")], "doc_id long, text string")
    df = df.withColumn("n_shingles", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("id", F.lit(2)).repartition(4)
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows) + 2
    want = brute.components(list({i: t for i, t in rows}.items()))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    left = minhash.one_of_each(df).collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == sorted({c for _, c in want.values()})
    assert sum(r.doc_id is None for r in left) == 2


def test_rows_of_one_id_join_their_classes(spark):
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, "a b c d e f"), (3, "g h i j k l"), (4, "x y")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 1), (3, 1), (4, 4)]


def test_no_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("members", [1_000, 7])
def test_families_with_few_links(spark, monkeypatch, members):
    """Copies that share most of a text but are mostly too different from one another."""
    rng = random.Random(11)
    base, rows = [f"w{k}" for k in range(150)], []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", members)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(rows)


def test_the_longest_row_of_an_id_stays(spark):
    long = "one two three four five six seven eight"
    rows = [(1, "", "a"), (1, long, "b"), (1, "nine ten", "z"), (1, long, "a"), (1, None, "y"), (None, "x", "n"), (2, "", "c")]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "doc_id long, text string, source string").coalesce(1)
        got = minhash.one_of_each(df)
        assert got.columns == df.columns
        assert {tuple(r) for r in got.collect()} == {(1, long, "b"), (2, "", "c"), (None, "x", "n")}


def test_one_of_each_with_any_columns(spark):
    """Names of inner columns, maps and repeated ids; rows whose id comes once are untouched."""
    text = "a b c d e f g h"
    rows = [(1, text, 5, {"a": 1}, "x"), (2, text, 6, {"a": 2}, "y"), (3, "short", 1, None, None), (3, "longer text", 2, {"b": 1}, None),
            (3, "longer text", 3, {"c": 1}, None), (None, text, 9, None, "z"), (None, None, 9, None, "z"), (4, None, 1, None, ""), (5, "", 1, None, "")]
    schema = "doc_id long, text string, _bytes int, kept map<string,int>, `again.x` string"
    got = minhash.one_of_each(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "_bytes", "kept", "again.x"]
    want = [rows[0], rows[4], rows[5], rows[6], rows[7], rows[8]]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_one_of_each_of_no_rows(spark):
    assert minhash.one_of_each(spark.createDataFrame([], "doc_id long, text string, kept int")).count() == 0
