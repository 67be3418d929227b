"""Features of log lines: structured slots and TF-IDF, in long form and as ML vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlark.functions import logtext

# Fixed values.
TOP_TEMPLATES = 200
TOP_SERVICES = 32
MAX_TERMS = 5000
OTHER = "__OTHER__"
NONE = "__NONE__"

_KINDS = ("tmpl", "svc", "lvl", "num")
_CELLS = "array<struct<idx: int, term: string, weight: double>>"


# ---------------------------------------------------------------------------
# Structured slots
# ---------------------------------------------------------------------------
def slots(
    lines: DataFrame, top_templates: int = TOP_TEMPLATES, top_services: int = TOP_SERVICES
) -> DataFrame:
    """(kind, key, idx, name) of every structured feature, in column order.

    ``lines`` has pos, event_id and service. At most
    ``top_templates + top_services + 13`` rows, so the result may always be broadcast.
    """

    def top(key: Column, kind: str, n: int) -> DataFrame:
        counted = lines.groupBy(key.alias("key")).agg(
            F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")
        )
        kept = counted.orderBy(F.desc("n"), "first").limit(n)
        return kept.select(F.lit(kind).alias("kind"), "key", F.lit(0).alias("last"), "n", "first")

    spark = lines.sparkSession
    fixed = [("tmpl", OTHER, 1, 0, 0), ("svc", OTHER, 1, 0, 0)]
    fixed += [("lvl", lvl, 0, 0, i) for i, lvl in enumerate(logtext.LOG_LEVELS)]
    fixed += [("num", c, 0, 0, i) for i, c in enumerate(logtext.NUMERIC_FEATURES)]
    rows = (
        top(F.col("event_id"), "tmpl", top_templates)
        .unionByName(top(F.coalesce("service", F.lit(NONE)), "svc", top_services))
        .unionByName(spark.createDataFrame(fixed, "kind string, key string, last int, n bigint, first bigint"))
    )
    place = F.array_position(F.array(*[F.lit(k) for k in _KINDS]), F.col("kind"))
    order = Window.orderBy(place, "last", F.desc("n"), "first")
    return rows.select(
        "kind", "key", (F.row_number().over(order) - 1).alias("idx"),
        F.concat_ws("::", "kind", "key").alias("name"),
    )


def _lookup(lines: DataFrame, of: DataFrame, kind: str, key: Column, out: str) -> DataFrame:
    """Add the slot of ``key``, or the OTHER slot of its kind."""
    mine = of.where(F.col("kind") == kind).select(F.col("key").alias("_k"), F.col("idx").alias(out))
    other = of.where((F.col("kind") == kind) & (F.col("key") == OTHER)).select("idx").scalar()
    joined = lines.withColumn("_key", key).join(F.broadcast(mine), F.col("_key") == F.col("_k"), "left")
    return joined.withColumn(out, F.coalesce(out, other)).drop("_key", "_k")


def with_slots(lines: DataFrame, of: DataFrame, reference_none: bool = False) -> DataFrame:
    """Add tmpl_idx, svc_idx, lvl_idx to lines with event_id, service and log_level.

    A line without a service takes the ``__NONE__`` slot if there is one. ``reference_none``
    sends it to OTHER instead, as the published behaviour does.
    """
    svc = F.col("service") if reference_none else F.coalesce("service", F.lit(NONE))
    out = _lookup(lines, of, "tmpl", F.col("event_id"), "tmpl_idx")
    out = _lookup(out, of, "svc", svc, "svc_idx")
    lvl = of.where("kind = 'lvl'").select(F.col("key").alias("log_level"), F.col("idx").alias("lvl_idx"))
    return out.join(F.broadcast(lvl), "log_level")


def structured_long(lines: DataFrame, of: DataFrame, key: str, reference_none: bool = False) -> DataFrame:
    """(key, col, value) of every non-zero structured feature."""
    placed = with_slots(lines, of, reference_none)
    first_num = of.where("kind = 'num'").select(F.min("idx")).scalar()
    cells = [F.struct(F.col(c).alias("col"), F.lit(1.0).alias("value")) for c in ("tmpl_idx", "svc_idx", "lvl_idx")]
    cells += [
        F.struct((first_num + i).alias("col"), F.col(c).cast("double").alias("value"))
        for i, c in enumerate(logtext.NUMERIC_FEATURES)
    ]
    flat = placed.select(key, F.explode(F.array(*cells)).alias("c")).select(key, "c.col", "c.value")
    return flat.where("value <> 0")


# ---------------------------------------------------------------------------
# TF-IDF
# ---------------------------------------------------------------------------
def with_terms(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Add the uni- and bigrams of the normalised text, with repeats (NULL: none); words are found once per row."""
    found = docs.withColumn("_words", logtext.words(logtext.tfidf_text(F.coalesce(F.col(text), F.lit("")))))
    return found.withColumn(out, logtext.unigrams_and_bigrams(F.col("_words"))).drop("_words")


def vocabulary(docs: DataFrame, text: str, max_terms: int = MAX_TERMS) -> DataFrame:
    """(term, idx, df, idf) of the most frequent terms, idx in alphabetical order.

    One pass: a document's terms are sorted, so the first of each run counts for the document,
    and both counts combine on the map side with no shuffle by document.
    """
    sorted_terms = with_terms(docs.select(text), text, "t").select(F.sort_array("t").alias("t"))
    flagged = F.zip_with(
        "t", F.concat(F.array(F.lit(None).cast("string")), "t"),
        lambda a, b: F.struct(a.alias("term"), (~a.eqNullSafe(b)).alias("is_first")),
    )
    flat = sorted_terms.select(F.explode(flagged).alias("c")).select("c.term", "c.is_first").where("term IS NOT NULL")
    kept = (
        flat.groupBy("term").agg(F.count(F.lit(1)).alias("cf"), F.count_if("is_first").alias("df"))
        .orderBy(F.desc("cf"), "term").limit(max_terms)
    )
    n = docs.agg(F.count(F.lit(1))).scalar()
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    # At most max_terms rows are numbered here.
    return kept.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"), "df", idf.alias("idf"))


def tfidf_long(docs: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """(key, idx, term, weight): sublinear tf times idf, each document scaled to length 1.

    Every row is a document, counted and weighted within its row, so nothing is shuffled after the
    vocabulary, of which all terms come to the driver (as many as were asked for in ``vocabulary``).
    A document without a known term has no row.
    """
    known = vocab.select("term", "idx", "idf").orderBy("idx").collect()
    counted = with_terms(docs.select(F.col(key), F.col(text).alias("_text")), "_text", "_terms").drop("_text")
    if known:
        names, idf = pa.array([r.term for r in known]), np.array([r.idf for r in known])

        @F.arrow_udf(_CELLS)
        def weigh(counts: pa.Array) -> pa.Array:
            return _cell_lists(counts, names, idf)

        counter = CountVectorizerModel.from_vocabulary(
            [r.term for r in known], inputCol="_terms", outputCol="_counts"
        )
        cells = weigh("_counts")
        counted = counter.transform(counted)
    else:
        cells = F.lit(None).cast(_CELLS)
    flat = counted.select(key, F.explode(cells).alias("_cell"))
    return flat.select(key, "_cell.idx", "_cell.term", "_cell.weight")


# ---------------------------------------------------------------------------
# Vectors
# ---------------------------------------------------------------------------
@dataclass
class FeatureSpace:
    """Everything needed to turn a line into a vector. All parts have a fixed upper size."""

    terms: list[str]
    idf: list[float]
    names: list[str]  # of all columns: terms, then structured slots
    slots: DataFrame | None  # None: TF-IDF only

    @property
    def size(self) -> int:
        return len(self.names)


def feature_space(docs: DataFrame, text: str, slot_table: DataFrame | None, max_terms: int = MAX_TERMS) -> FeatureSpace:
    """Fit the vocabulary on ``docs``; at most ``max_terms`` terms come to the driver."""
    vocab = vocabulary(docs, text, max_terms).orderBy("idx").collect()
    words = [r.term for r in vocab]
    names = list(words)
    if slot_table is not None:
        names += [r["name"] for r in slot_table.orderBy("idx").collect()]
    return FeatureSpace(words, [r.idf for r in vocab], names, slot_table)


def _vector_array(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int, size: int) -> pa.Array:
    """Sparse ML vectors from cells given as (row, column, value)."""
    order = np.lexsort((cols, rows))
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    idx = pa.ListArray.from_arrays(pa.array(ends), pa.array(cols[order].astype(np.int32)))
    val = pa.ListArray.from_arrays(pa.array(ends), pa.array(vals[order].astype(np.float64)))
    return pa.StructArray.from_arrays(
        [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), idx, val],
        names=["type", "size", "indices", "values"],
    )


def _tfidf_cells(counts: pa.Array, idf: np.ndarray):
    idx, val = counts.field("indices"), counts.field("values")
    n = len(counts)
    rows = np.repeat(np.arange(n), pc.list_value_length(idx).to_numpy(zero_copy_only=False))
    cols = idx.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    w = (1.0 + np.log(val.flatten().to_numpy(zero_copy_only=False))) * idf[cols]
    norm = np.sqrt(np.bincount(rows, weights=w * w, minlength=n))
    return rows, cols, w / norm[rows]


def _cell_lists(counts: pa.Array, names: pa.Array, idf: np.ndarray) -> pa.Array:
    """The weighted cells of each row as a list; a row without counts has an empty one."""
    rows, cols, w = _tfidf_cells(counts, idf)
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(counts)))]).astype(np.int32)
    cells = pa.StructArray.from_arrays(
        [pa.array(cols.astype(np.int32)), names.take(pa.array(cols)), pa.array(w)], names=["idx", "term", "weight"]
    )
    return pa.ListArray.from_arrays(pa.array(ends), cells)


def vectors(lines: DataFrame, text: str, space: FeatureSpace, out: str = "features") -> DataFrame:
    """Add the feature vector of each line, without a shuffle.

    Terms are counted in the JVM; weighting and stacking run on whole Arrow batches. With
    structured slots, ``lines`` carries event_id, service, log_level and the numeric features.
    """
    idf = np.array(space.idf)
    size, offset = space.size, len(space.terms)
    counted = with_terms(lines, text, "_terms")
    if space.terms:
        counter = CountVectorizerModel.from_vocabulary(space.terms, inputCol="_terms", outputCol="_counts")
        counted = counter.transform(counted)
    else:
        raise ValueError("no terms: the training text holds no words")

    if space.slots is None:
        @F.arrow_udf(VectorUDT())
        def weigh(counts: pa.Array) -> pa.Array:
            return _vector_array(*_tfidf_cells(counts, idf), len(counts), size)

        return counted.withColumn(out, weigh("_counts")).drop("_terms", "_counts")

    nums = list(logtext.NUMERIC_FEATURES)
    first_num = size - len(nums)

    @F.arrow_udf(VectorUDT())
    def stack(counts: pa.Array, t: pa.Array, s: pa.Array, lv: pa.Array,
              n0: pa.Array, n1: pa.Array, n2: pa.Array, n3: pa.Array) -> pa.Array:
        n = len(counts)
        rows, cols, vals = ([x] for x in _tfidf_cells(counts, idf))
        for slot in (t, s, lv):
            rows.append(np.arange(n))
            cols.append(offset + slot.to_numpy(zero_copy_only=False).astype(np.int64))
            vals.append(np.ones(n))
        for j, num in enumerate((n0, n1, n2, n3)):
            v = num.to_numpy(zero_copy_only=False)
            at = np.flatnonzero(v)
            rows.append(at)
            cols.append(np.full(len(at), first_num + j))
            vals.append(v[at])
        return _vector_array(*(np.concatenate(x) for x in (rows, cols, vals)), n, size)

    placed = with_slots(counted, space.slots)
    return placed.withColumn(out, stack("_counts", "tmpl_idx", "svc_idx", "lvl_idx", *nums)).drop(
        "_terms", "_counts", "tmpl_idx", "svc_idx", "lvl_idx"
    )
