"""Each stage of the pipeline against plain code on its own input."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
from buildlark.llm import toxicity
from buildlark.session import settle
from tests.llm import brute


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, held = docs.columns, {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        before = settle(stage(spark, before, sf), "test")
        held[name] = rows(before)
        assert before.columns == names or name == "token_ids"
    given = {r["doc_id"]: r for r in rows(docs)}
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, lexicon).collect() if r.predicted}
    assert sorted(r["doc_id"] for r in held["toxicity"]) == sorted(set(given) - toxic)
    assert all(r == given[r["doc_id"]] for r in held["toxicity"])

    groups = brute.components([(r["doc_id"], r["text"]) for r in held["toxicity"]])
    assert sorted(r["doc_id"] for r in held["near_duplicates"]) == sorted(i for i, (_, c) in groups.items() if i == c)

    texts = {r["doc_id"]: r["text"] for r in held["secrets"]}
    assert set(texts) == {r["doc_id"] for r in held["near_duplicates"]}
    for r in held["near_duplicates"]:
        if not brute.base_secrets(r["text"]):
            assert re.sub(r"\S*\[SECRET\]\S*", "", texts[r["doc_id"]]) == re.sub(r"\S*\[SECRET\]\S*", "", r["text"]) or "[SECRET]" in texts[r["doc_id"]]
        else:
            assert "[SECRET]" in texts[r["doc_id"]]
        assert not brute.base_secrets(texts[r["doc_id"]])

    taken = Counter()
    for r in held["mix"]:
        taken[r["doc_id"]] += len(brute.words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert set(taken) <= set(texts) and all(n <= 3 * len(brute.words(texts[i])) for i, n in taken.items())
    total = sum(len(brute.words(t)) for t in texts.values())
    assert abs(sum(taken.values()) - total) <= len({r["source"] for r in held["mix"]})

    digests = Counter((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in held["mix"])
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in held["token_ids"]) == digests
    assert sorted(map(str, rows(corpus_pipeline.run(spark, sf)))) == sorted(map(str, held["token_ids"]))
