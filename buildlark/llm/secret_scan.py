"""Secret scans: patterns, and strings that look random to Markov models; DataFrame functions only.

Two character models of order one, of random strings and of ordinary words, are counted from labelled
samples: digests and pattern matches on one side, words that no pattern matches on the other. A long
string is reported if its log-likelihood ratio per transition is above a margin.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlark.llm.words import numbered, quoted

# The patterns of the base kinds; the assigned value is group 1.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
VALUE_CHARS, ACCESS_CHARS = 8, 16

#: Characters of the models, and the strings they judge.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LONG = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{5,}+"

#: Rows that the models are counted on at most, and nats per transition above which a string is random.
TRAIN_ROWS = 2_000
MARGIN = 0.5
#: Pairs' worth of weight that single characters have in the models.
BACKING = 20.0

SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int>>"

#: Values that are folded one after the other; the chunks' results are folded in turn.
CHUNK = 128


def _with(value: Column, then) -> Column:
    """``then(value)``, where ``value`` is worked out once."""
    return F.transform(F.array(value), then)[0]


def _before(values: Column, fold) -> Column:
    """For each of ``values`` (ints), the ``fold`` of 0 and those before it; associative.

    An array grows by copying it, so long ones are folded in chunks."""
    def folded(chunk: Column, value) -> Column:
        zero = F.struct(F.lit(0).alias("all"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(chunk, zero, lambda a, x: F.struct(
            fold(a["all"], value(x)).alias("all"), F.concat(a["before"], F.array(a["all"])).alias("before")))

    def chunks(of: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(of) - 1) / CHUNK).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda c: folded(F.slice(of, c * CHUNK + 1, F.lit(CHUNK)), lambda x: x))

    def put_together(own: Column) -> Column:
        bases = folded(own, lambda x: x["all"])["before"]
        return F.flatten(F.zip_with(own, bases, lambda x, base: F.transform(x["before"], lambda y: fold(base, y))))

    return _with(_with(values, chunks), put_together)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _max(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of all matches, from the lengths of what lies between them and of the matches.

    ``keep(match, value)`` tells which ones count; the others have taken their place in the text all
    the same. Linear in the text and its matches, and empty without further work where the pattern is not found."""
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(2)) if kind == 0 else matches
    between = F.split(text, pattern, -1)
    gaps = F.slice(F.transform(between, F.length), F.lit(1), F.size(matches))
    lengths = F.zip_with(gaps, matches, lambda gap, m: gap + F.length(m))
    starts = F.zip_with(_before(lengths, _sum), gaps, _sum)
    found = F.transform(
        F.arrays_zip(starts.alias("start"), matches.alias("match"), values.alias("value")),
        lambda x: F.when(keep(x["match"], x["value"]), F.struct(
            x["start"].alias("start"), F.lit(kind).alias("kind_no"), F.lit(KINDS[kind]).alias("kind"),
            (x["start"] + F.length(x["match"])).alias("end"),
        )),
    )
    kept = F.filter(found, lambda s: s.isNotNull()).cast(SPAN)
    return F.when(F.rlike(text, F.lit(pattern)), kept).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    return F.concat(
        _spans(text, ASSIGN, 0, lambda m, v: F.length(v) >= VALUE_CHARS),
        _spans(text, ACCESS, 1, lambda m, v: F.length(m) >= ACCESS_CHARS),
        _spans(text, HEX, 2, lambda m, v: F.lit(True)),
    )


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each pair of characters of ALPHABET, row by row.

    Counted on at most ``rows`` documents, those first in order of the md5 of their id; rows alike in
    id and text count once. The keys are chosen without the texts, which only those rows then send. Random
    samples are two digests of each id in hex and base 64 and the values that the patterns find;
    ordinary ones are the words of five and more characters that hold no pattern match. Only the
    table of pairs, of fixed size, comes to the driver.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = docs.select(order.alias("_key"), F.xxhash64(text).alias("_hash"), text.alias("text"))
    chosen = keyed.select("_key", "_hash").orderBy("_key", "_hash").limit(rows).distinct()
    some = keyed.join(F.broadcast(chosen), ["_key", "_hash"]).groupBy("_key", "_hash").agg(F.first("text").alias("text"))
    matched = F.concat(
        F.regexp_extract_all("text", F.lit(f"({ASSIGN})"), F.lit(2)),
        F.regexp_extract_all("text", F.lit(f"({HEX})"), F.lit(1)),
        F.array(F.sha2("_key", 256), F.base64(F.unhex(F.sha2(F.reverse("_key"), 256)))),
    )
    plain = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), HEX, " ")
    words = F.regexp_extract_all(plain, F.lit(f"({ORDINARY})"))
    labelled = some.select(F.explode(F.concat(
        F.transform(matched, lambda w: F.struct(F.lit(1).alias("random"), w.alias("w"))),
        F.transform(words, lambda w: F.struct(F.lit(0).alias("random"), w.alias("w"))),
    )).alias("s")).groupBy("s.random", "s.w").count()
    pair = F.explode(F.transform(
        F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2))
    ))
    counts = (
        labelled.where(F.length("w") > 1).select("random", "count", pair.alias("pair"))
        .groupBy("random", "pair").agg(F.sum("count").alias("n")).collect()
    )
    at, size = {c: i for i, c in enumerate(ALPHABET)}, len(ALPHABET)
    n = [[[0.0] * size for _ in range(size)] for _ in range(2)]
    for r in counts:
        if r["pair"][0] in at and r["pair"][1] in at:
            n[r["random"]][at[r["pair"][0]]][at[r["pair"][1]]] += r["n"]

    def logs(pairs: list[list[float]]) -> list[float]:
        """Log probability of each pair, leaning on how common its second character is."""
        single = [sum(row[j] for row in pairs) + 0.5 for j in range(size)]
        share = [x / sum(single) for x in single]
        return [math.log((row[j] + BACKING * share[j]) / (sum(row) + BACKING)) for row in pairs for j in range(size)]

    return [r - o for r, o in zip(logs(n[1]), logs(n[0]))]


def ratio(word: Column, model: Sequence[float]) -> Column:
    """Log-likelihood ratio per transition of a word of ALPHABET."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    codes = F.transform(F.split(word, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    total = F.aggregate(
        codes, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
        lambda a, c: F.struct(c.alias("last"), F.when(
            a["last"] > 0, a["sum"] + F.element_at(table, (a["last"] - 1) * len(ALPHABET) + c)
        ).otherwise(a["sum"]).alias("sum")),
        lambda a: a["sum"],
    )
    return total / (F.length(word) - 1)


def scan(docs: DataFrame, model: Sequence[float] | None = None, margin: float = MARGIN) -> DataFrame:
    """``docs`` with ``spans``: all secrets found in the whole text, by start, then kind.

    Starts and ends are code points, ends exclusive. Base kinds are found leftmost and without
    overlap within a kind; a long string counts as random only where no base span touches it.
    NULL and empty texts have no spans; repeated rows and NULL ids are rows like others; an input
    column ``spans`` is replaced; an empty table gives no rows. Without ``model``, one is trained.
    """
    model = train(docs) if model is None else model
    kept = [c for c in docs.columns if c != "spans"]
    out = _scanned(numbered(docs.select(*map(quoted, kept))), f"c{kept.index('text')}", model, margin)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "spans")


def _scanned(rows: DataFrame, column: str, model: Sequence[float], margin: float) -> DataFrame:
    """``rows`` (columns ``c0``, ``c1``, ...) with the spans of ``column``."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    random = _spans(text, LONG, 3, lambda m, v: ratio(m, model) >= margin)
    out = rows.withColumns({"base": base_spans(text), "random": random})
    both = F.when(F.size("random") == 0, F.sort_array("base")).otherwise(_with(F.sort_array(F.concat("base", "random")), _alone))
    return out.withColumn("spans", both).drop("base", "random")


def _alone(spans: Column) -> Column:
    """Of spans in order, the base ones and the random ones that touch no base one."""
    is_base, far = lambda s: s["kind_no"] < 3, 1 << 30
    ends = F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(0))
    nears = F.transform(F.reverse(spans), lambda s: F.when(is_base(s), F.lit(far) - s["start"]).otherwise(0))
    around = F.arrays_zip(spans.alias("span"), _before(ends, _max).alias("end"), F.reverse(_before(nears, _max)).alias("near"))
    free = F.filter(around, lambda x: is_base(x["span"]) | (
        (x["end"] <= x["span"]["start"]) & (F.lit(far) - x["near"] >= x["span"]["end"])))
    return F.transform(free, lambda x: x["span"])


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", model: Sequence[float] | None = None, margin: float = MARGIN) -> DataFrame:
    """``docs`` with ``mark`` in place of each stretch that spans cover; all other text stays.

    The columns are those of ``docs``, whatever their names; ``n_chars``, if there is one, follows the
    text. NULL and empty texts stay; repeated rows and NULL ids are rows like others; an empty table
    gives no rows. The work is linear in the length of a text and the number of its spans.
    """
    model = train(docs) if model is None else model
    names = docs.columns
    column = f"c{names.index('text')}"
    out = _scanned(numbered(docs), column, model, margin)
    text = F.col(column)

    def put(spans: Column) -> Column:
        """The characters before each stretch and the mark, then those after the last."""
        reached = _before(F.transform(spans, lambda s: s["end"]), _max)
        opening = F.filter(F.zip_with(spans, reached, lambda s, at: F.struct(
            at.alias("at"), s["start"].alias("start"))), lambda g: g["start"] >= g["at"])
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return _with(F.split(text, ""), lambda chars: F.concat(
            F.array_join(F.transform(opening, lambda g: F.concat(
                F.array_join(F.slice(chars, g["at"] + 1, g["start"] - g["at"]), ""), F.lit(mark))), ""),
            F.substr(text, end + 1)))

    out = out.withColumn("put", F.when(F.size("spans") > 0, _with(F.col("spans"), put)).otherwise(text))
    now = {"text": F.col("put"), "n_chars": F.length("put").cast("long")}
    return out.select(*[now.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
