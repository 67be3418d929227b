"""Columns that have the names of inner ones, and texts with very many matches."""

from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from buildlark.llm import mixing, secret_scan

ODD = ["_source", "_r", "_key", "_range", "_inside", "_text", "size", "target", "taken", "spans", "_base", "_random", "base", "put", "c0", "a.b"]
MODEL = [0.0] * len(secret_scan.ALPHABET) ** 2


def _odd(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in ODD])


def _kept(rows):
    return all(r[c] == f"own {c}" for r in rows for c in ODD)


def test_mix_and_redact_leave_other_columns_alone(spark):
    rows = [(1, "one two three", "x"), (2, None, None), (2, "one", "x"), (None, "password = hunter2hunter2 ok", "y")]
    docs = _odd(spark, rows)
    mixed = mixing.mixed_texts(docs)
    assert mixed.columns == docs.columns and _kept(mixed.collect()) and mixed.count() >= 3
    got = mixing.mix(docs)
    inner = [c for c in ODD if c not in mixing.OUT]
    assert [c for c in got.columns if c in inner] == inner and got.count() == 4
    clean = secret_scan.redact(docs, model=MODEL)
    assert clean.columns == docs.columns and _kept(clean.collect())
    assert sorted(r["text"] or "" for r in clean.collect()) == ["", "[SECRET] ok", "one", "one two three"]
    found = secret_scan.scan(docs, model=MODEL).collect()
    assert sum(len(r["spans"]) for r in found) == 1
    for work in (mixing.mixed_texts, mixing.mix, lambda d: secret_scan.redact(d, model=MODEL)):
        assert work(docs.limit(0)).count() == 0


def _plain(text, model_finds):
    """Spans and redacted text, one after the other."""
    base = [(m.start(), 0, m.end()) for m in re.finditer(secret_scan.ASSIGN.replace("(?i:", "(?:"), text, re.I) if len(m[1]) >= 8]
    base += [(m.start(), 2, m.end()) for m in re.finditer(secret_scan.HEX, text)]
    spans = base + [
        (m.start(), 3, m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text)
        if model_finds and not any(a < m.end() and m.start() < b for a, _, b in base)]
    spans.sort()
    out, at = "", 0
    for a, _, b in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return spans, out + text[at:]


def test_spans_and_redaction_equal_plain_code(spark):
    hexed = "0123456789abcdef" * 2
    texts = [
        f"é token={hexed} x {hexed} y", "Z" * 25 + " " + "q" * 30, f"{hexed}{hexed}", f"secret: '{hexed}zz' " * 7,
        (f"a {hexed} b " + "Q" * 22 + " \U0001f600 ") * 300, "", "nothing", f"token={'Q' * 30} " * 129,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for high in (True, False):
        model = [1.0 if high else -1.0] * len(MODEL)
        got = {r.doc_id: r.spans for r in secret_scan.scan(docs, model=model).collect()}
        clean = {r.doc_id: r.text for r in secret_scan.redact(docs, model=model).collect()}
        for i, text in enumerate(texts):
            spans, out = _plain(text, high)
            assert [(s.start, s.kind_no, s.end) for s in got[i]] == spans
            assert clean[i] == out


def test_many_matches_take_no_square(spark):
    text = " ".join(f"token=abcdefgh{i}" for i in range(32_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begun = time.monotonic()
    row = secret_scan.redact(docs, model=MODEL).first()
    assert row.text == " ".join(["[SECRET]"] * 32_000)
    assert time.monotonic() - begun < 60


def test_sample_takes_copies_once(spark):
    rows = [(None, "plain ordinary words here")] * 500 + [(i, f"some other words {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(secret_scan.train(docs, rows=10)) == len(MODEL)
    assert len(secret_scan.train(docs.limit(0))) == len(MODEL)
