"""Toxicity scores from a weighted lexicon.

Texts are folded first: compatibility forms, lower case, letters of other scripts that look like
Latin ones, digits used as letters, and everything but letters as a space. The lexicon holds words
and beginnings of words with log-odds weights learnt from labelled rows, and exception phrases in
which an entry does not count. One Aho-Corasick automaton finds both. The sum of the weights, also in
relation to the number of words, goes through a logistic curve fitted on the same rows.
"""

from __future__ import annotations

import gc
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlark.llm.pieces import text_groups
from buildlark.session import settle

#: Labelled rows that are learnt from at most, in order of the md5 of their id.
SAMPLE_ROWS = 20_000
#: Candidate entries whose clean rows are counted, entries kept, and exception phrases kept, at most.
CANDIDATES, ENTRIES, EXCEPTIONS = 60_000, 5_000, 2_000
#: Lengths of beginnings of words that may be entries.
PREFIXES = range(4, 11)
#: An entry is at least e ** 2 times as frequent in toxic rows.
LEAST_WEIGHT = 2.0

# Letters that look alike, and digits and signs used as letters.
LOOKALIKES = dict(zip("абсԁеёһіїјкӏмнорѕтԛуѵѡхгԍαβεηικνορτυχωɑɡɩı", "abcdeehiijklmhopstqyvwxrgabenikvoptuxwagii"))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a"}
HIDDEN = "­​‌‍⁠﻿"



class _Table(dict):
    """What becomes of a character: letters and the marks on them stay, invisible signs go, all else is a space."""

    def __missing__(self, code: int) -> int | str | None:
        c = chr(code)
        kind = unicodedata.category(c)
        invisible = kind == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF
        self[code] = None if invisible else code if kind[0] == "L" or kind in ("Mn", "Mc") else " "
        return self[code]


TABLE = _Table({ord(a): b for a, b in (LOOKALIKES | LEET).items()} | {ord(c): None for c in HIDDEN})


def fold(text: str) -> str:
    """The folded text, with a space before and after."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return f" {text.lower().translate(TABLE)} "


@dataclass
class Lexicon:
    """``entries``: ' word ' or ' beginning' to weight; ``exceptions``: ' two words '; ``curve``: bias and slopes."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: list[float] = field(default_factory=lambda: [-8.0, 0.0, 0.0])

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for e in self.entries:
            found.add_word(e, e)
        for e in self.exceptions:
            found.add_word(e, (e,))
        if len(found):
            found.make_automaton()
        return found


def hits(folded: str, lexicon: Lexicon, found: ahocorasick.Automaton) -> list[tuple[int, float]]:
    """Start and weight of the heaviest entry of each word that has one outside exception phrases."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if not len(found):
        return []
    for end, what in found.iter(folded):
        if isinstance(what, tuple):
            spared.append((end - len(what[0]) + 1, end))
        else:
            start = end - len(what) + 1
            best[start] = max(best.get(start, 0.0), lexicon.entries[what])
    return [(s, w) for s, w in sorted(best.items()) if not any(a <= s < b for a, b in spared)]


def measures(text: str, lexicon: Lexicon, found: ahocorasick.Automaton) -> tuple[float, float]:
    """Weight of all hits and weight per hundred words, both on a log scale."""
    folded = fold(text)
    total = sum(w for _, w in hits(folded, lexicon, found))
    if not total:
        return 0.0, 0.0
    words = len(folded.split()) or 1
    return float(np.log1p(total)), float(np.log1p(100 * total / words))


def _features(folded: str) -> dict[str, str]:
    """Words and beginnings of words of a text, with the words around the first place of each."""
    words = folded.split()
    out: dict[str, str] = {}
    for i, w in enumerate(words):
        if len(w) < 3 or f" {w} " in out:
            continue
        around = f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}"
        out[f" {w} "] = around
        for n in PREFIXES:
            if len(w) > n:
                out.setdefault(f" {w[:n]}", around)
    return out


def _rows(work):
    """``work`` on the texts of a batch with columns toxic and text, as a pandas step."""

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield work(frame["toxic"].tolist(), frame["text"].tolist())

    return step


def _count_toxic(toxic: list[int], texts: list[str]) -> pd.DataFrame:
    rows = [(f, a) for t, x in zip(toxic, texts) if t for f, a in _features(fold(x)).items()]
    return pd.DataFrame(rows, columns=["feature", "around"], dtype=str)


def _counter(known: set[str]):
    def work(toxic: list[int], texts: list[str]) -> pd.DataFrame:
        n: dict[str, int] = {}
        for t, x in zip(toxic, texts):
            if not t:
                for f in known.intersection(_features(fold(x))):
                    n[f] = n.get(f, 0) + 1
        return pd.DataFrame({"feature": pd.Series(n.keys(), dtype=str), "n": pd.Series(n.values(), dtype="int64")})

    return work


def _phrases(lexicon: Lexicon):
    """Hit words with the word before or after."""

    def work(toxic: list[int], texts: list[str]) -> pd.DataFrame:
        found, rows = lexicon.automaton(), []
        for t, x in zip(toxic, texts):
            folded = fold(x)
            own = set()
            for start, _ in hits(folded, lexicon, found):
                after, before = folded[start:start + 80].split()[:2], folded[max(0, start - 40):start].split()[-1:]
                own.add(f" {' '.join(after)} ")
                own.add(f" {' '.join(before + after[:1])} ")
            rows += [(p, t) for p in own if p.count(" ") == 3 and p in folded]
        return pd.DataFrame({"phrase": pd.Series([r[0] for r in rows], dtype=str), "toxic": pd.Series([r[1] for r in rows], dtype="int64")})

    return work


def _measured(lexicon: Lexicon):
    def work(toxic: list[int], texts: list[str]) -> pd.DataFrame:
        found = lexicon.automaton()
        got = [measures(x, lexicon, found) for x in texts]
        return pd.DataFrame({"toxic": toxic, "a": [g[0] for g in got], "b": [g[1] for g in got]})

    return work


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 60) -> list[float]:
    """Logistic curve by Newton steps with a small penalty on the slopes."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -3, 3)
    return beta.tolist()


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Lexicon and curve from labelled rows outside the held-out fold.

    At most ``rows`` labels are used, those first in order of the md5 of their id; copies of one text
    count once. An entry must stand between at least 3 different pairs of words (0.5 % of the toxic rows, if
    that is more), so that copies of one passage do not make entries. Phrases that hold a hit in at
    least 3 clean rows and in no toxic one become exceptions, beside the given ones. Without rows of
    both labels the lexicon is empty and every score low. What comes to the driver is bounded by
    ``rows``, ``CANDIDATES``, ``ENTRIES`` and ``EXCEPTIONS``.
    """
    given = [f" {fold(e).strip()} " for e in exceptions]
    some = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.md5(F.col("doc_id").cast("string"))).limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(some), "doc_id").groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("l"))
    sample = settle(sample.agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("toxic", "text"), "labelled")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Lexicon(exceptions=given)
    least = max(3, round(0.005 * toxic))
    counted = (
        sample.mapInPandas(_rows(_count_toxic), "feature string, around string")
        .groupBy("feature").agg(F.count(F.lit(1)).alias("t"), F.approx_count_distinct("around").alias("d"))
        .where((F.col("t") >= least) & (F.col("d") >= least))
    )
    support = {r["feature"]: r["t"] for r in counted.orderBy(F.desc("t"), "feature").limit(CANDIDATES).collect()}
    in_clean = sample.mapInPandas(_rows(_counter(set(support))), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    n_clean = {r["feature"]: r["n"] for r in in_clean.collect()}
    weight = {
        f: float(np.log((t + 0.5) / (toxic + 1)) - np.log((n_clean.get(f, 0) + 0.5) / (clean + 1))) for f, t in support.items()
    }
    entries: dict[str, float] = {}
    for f in sorted((f for f in weight if weight[f] >= LEAST_WEIGHT), key=len):
        shorter = [f[:n] for n in range(1 + PREFIXES.start, len(f)) if f[:n] in entries]
        if not any(weight[s] >= weight[f] - 0.5 for s in shorter):
            entries[f] = weight[f]
    kept = sorted(entries, key=lambda f: (-support[f] * entries[f], f))[:ENTRIES]
    lexicon = Lexicon({f: entries[f] for f in kept}, given)
    phrases = sample.mapInPandas(_rows(_phrases(lexicon)), "phrase string, toxic int").groupBy("phrase").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).where("t = 0 AND n >= 3")
    lexicon.exceptions += [r["phrase"] for r in phrases.orderBy(F.desc("n"), "phrase").limit(EXCEPTIONS).collect()]
    got = sample.mapInPandas(_rows(_measured(lexicon)), "toxic int, a double, b double").toPandas()
    lexicon.curve = _fit(got[["a", "b"]].to_numpy(float), got["toxic"].to_numpy(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text.

    NULL and empty texts get the score of a text without hits; NULL ids and repeated rows are rows
    like others; other columns are ignored; no rows give no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        found, curve = lexicon.automaton(), np.array(lexicon.curve)
        for batch in batches:
            for start, texts in text_groups(batch):
                x = np.array([(1.0, *measures(t, lexicon, found)) for t in texts])
                p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(start, len(texts)), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                ], ["doc_id", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(work, "doc_id long, score double, predicted int")


def clean_rows(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, with the same columns."""
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, curve = lexicon.automaton(), np.array(lexicon.curve)
        for batch in batches:
            texts = batch.column(names.index("text"))
            p = [np.dot(curve, (1.0, *measures(t.as_py() or "", lexicon, found))) < 0 for t in texts]
            yield batch.filter(pa.array(p, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
