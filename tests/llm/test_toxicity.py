"""Toxicity: folding, hits, cases and held-out accuracy."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from buildlark.llm import toxicity as t


def test_folding_and_exceptions():
    assert t.fold("I​D10T! іdіоt Ｉdiot") == " idiot  idiot idiot "
    lexicon = t.Lexicon({" idiot": 2.0, " trash ": 1.0, " id": 0.5}, [" trash can "])
    found = lexicon.automaton()
    assert t.hits(t.fold("1d10ts, the trash can and trash. Trashy"), lexicon, found) == [(0, 2.0), (26, 1.0)]
    assert t.measures("", lexicon, found) == (0.0, 0.0)
    assert t.measures("x", t.Lexicon(), t.Lexicon().automaton()) == (0.0, 0.0)


def test_signs_of_any_script_end_words():
    lexicon = t.Lexicon({" idiot": 2.0, " trash ": 1.0})
    found = lexicon.automaton()
    for a, b in ["¡!", "¿?", "«»", "“”", "„“", "‘’", "‹›", "「」", "——", "––", "……", "。、", "•·", "٣٣", "\u200e\u200f"]:
        assert t.fold(f"{a}Idiot{b} {a}trash{b}").split() == ["idiot", "trash"], a
        assert [w for _, w in t.hits(t.fold(f"{a}Idiot{b} {a}trash{b}"), lexicon, found)] == [2.0, 1.0], a
    assert t.fold("so—trash—so").split() == ["so", "trash", "so"] and t.fold("isn’t") == t.fold("isn't")
    assert t.fold("❤\ufe0fidiot").split() == ["idiot"]
    assert t.fold("naïve Straße हिन्दी 漢字").split() == ["naïve", "straße", "हिन्दी", "漢字"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = entry.queries()["op1_toxicity"](spark, sf).join(labels, "doc_id")
    rows = got.where("held_out").select("score", "predicted", "toxic").collect()
    good = [r.score for r in rows if r.toxic]
    bad = sorted(r.score for r in rows if not r.toxic)
    auc = sum(sum(b < g for b in bad) + 0.5 * sum(b == g for b in bad) for g in good) / (len(good) * len(bad))
    assert auc > 0.97, auc
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97


def test_cases(spark):
    rows = [(i, ("you idiot " if i % 2 else "you friend ") + f"w{i} words here " * 5) for i in range(60)]
    rows += [(100, ""), (101, None), (None, "you 1d1ot go"), (3, rows[3][1]), (103, "kind " * 50_000 + "idiot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("toxic", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    lexicon = t.learn(docs, labels)
    out = t.score(docs, lexicon).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[i].predicted == i % 2 for i in range(60)) and by[None].predicted == 1
    assert by[100].score == by[101].score < 0.5
    left = t.clean_rows(docs, lexicon)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} >= {0, 2, 58, 100, 101}
    assert t.score(docs.limit(0), lexicon).count() == 0
    assert t.learn(docs, labels.where("toxic = 0")).entries == {}
    assert all(r.predicted == 0 for r in t.score(docs, t.learn(docs, labels.limit(0))).collect())
