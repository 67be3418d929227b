"""MinHash near-duplicates: banding, signature verification, exact confirmation, components.

Documents with the same shingle set are one class and only its smallest id goes on. Classes that
agree in a band of minima share a bucket. Not all pairs of a bucket are formed: its members are held
against two of them first and components are found. Buckets that still hold four or more members in
different components are put together where they share members; such a clump is cut into blocks, each
pair of blocks counts its intersections as a matrix product, and hands out a spanning forest of the
links. Every pair that shares a bucket is therefore either confirmed, refused, or joined by others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildlark.llm.components import components
from buildlark.llm.words import U, byte_texts, hash_words, mix, window_hashes
from buildlark.session import settle

#: A pair at the least similarity, 0.75, shares no band with probability (1 - 0.75 ** 4) ** 32 = 5e-6.
BANDS, ROWS = 32, 4
SHINGLE = 5
#: Confirmed: 100 * intersection >= LEAST * union.
LEAST = 75
#: Pairs whose minima agree in a smaller share are refused without their sets; 0.75 is over 6 standard
#: deviations away from it.
SIGNATURE_LEAST = 0.5
#: Members and shingles that a block of a clump holds, about; columns that are multiplied at once.
BLOCK_MEMBERS, BLOCK_SHINGLES, COLUMNS = 1_000, 250_000, 2_048

_rng = np.random.default_rng(77)
FACTOR = _rng.integers(1, 1 << 62, BANDS * ROWS, dtype=U) * U(2) + U(1)
ADDEND = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=U)


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in turn, repeats included, and where each text begins.

    A text with fewer words than a shingle has its whole sequence as one; without words, none."""
    words, at = hash_words(texts)
    n_words = np.diff(at)
    windows = window_hashes(words, SHINGLE)
    count = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(begin[-1], U)
    full = n_words >= SHINGLE
    inside = np.repeat(at[:-1] - begin[:-1], count) + np.arange(begin[-1])
    is_full = np.repeat(full, count)
    out[is_full] = windows[inside[is_full]]
    for i in np.nonzero(~full & (n_words > 0))[0].tolist():
        w = words[at[i]:at[i + 1]]
        out[begin[i]] = mix(window_hashes(w, len(w)) + U(len(w)))[0]
    return out, begin


def signatures(shingles: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The minima of each text with shingles, one row each."""
    starts = begin[:-1][np.diff(begin) > 0]
    out = np.zeros((len(starts), BANDS * ROWS), np.uint32)
    if len(starts):
        for k in range(BANDS * ROWS):
            out[:, k] = np.minimum.reduceat((shingles * FACTOR[k] + ADDEND[k]) >> U(32), starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One hash per band and row of ``signature``; different bands never share a key by design."""
    wide = signature.astype(U).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), (len(signature), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + wide[:, :, r])
    return key.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in byte_texts(batch, lower=True):
            shingles, begin = shingle_hashes(texts)
            keys = band_keys(signatures(shingles, begin))
            sets = [np.unique(shingles[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
            some = np.array([len(s) > 0 for s in sets], bool)
            offsets = np.concatenate([[0], np.cumsum(some)]).astype(np.int32) * BANDS
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(start, len(texts)),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([int(mix(s).sum(dtype=U).astype(np.int64)) for s in sets], pa.int64()),
                pa.array([int(mix(s ^ FACTOR[0]).sum(dtype=U).astype(np.int64)) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1))),
            ], ["doc_id", "n_shingles", "set_a", "set_b", "keys"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in byte_texts(batch, lower=True):
            shingles, begin = shingle_hashes(texts)
            minima = iter(signatures(shingles, begin))
            sets = [np.unique(shingles[a:b]).tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(start, len(texts)),
                pa.array(sets, pa.binary()),
                pa.array([next(minima).tobytes() if s else b"" for s in sets], pa.binary()),
            ], ["doc_id", "shingles", "minima"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that pass the signature check and then the exact one."""
    for batch in batches:
        kept = []
        cols = [batch.column(c) for c in ("shingles_u", "shingles_v", "minima_u", "minima_v")]
        for i in range(batch.num_rows):
            su, sv, mu, mv = (c[i].as_buffer() for c in cols)
            same = np.frombuffer(mu, np.uint32) == np.frombuffer(mv, np.uint32)
            if not len(same) or same.mean() < SIGNATURE_LEAST:
                continue
            a, b = np.frombuffer(su, U), np.frombuffer(sv, U)
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= LEAST * (len(a) + len(b) - both):
                kept.append(i)
        yield batch.select(["u", "v"]).take(pa.array(kept, pa.int64()))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    def side(name: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(name), F.col("shingles").alias(f"shingles_{name}"), F.col("minima").alias(f"minima_{name}"))

    return pairs.join(side("v"), "v").join(side("u"), "u").mapInArrow(_confirm, "u long, v long")


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _between_blocks(group: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between the members of two blocks (or within one)."""
    ids, own = group["id"].to_numpy(), group["component"].to_numpy()
    none = pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
    if len(np.unique(own)) < 2:
        return none
    sets = [np.frombuffer(x, U) for x in group["shingles"]]
    size = np.array([len(x) for x in sets])
    shingle, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.nonzero(times > 1)[0]
    place = np.full(len(shingle), -1)
    place[shared] = np.arange(len(shared))
    member, column = np.repeat(np.arange(len(sets)), size), place[column]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    first, second = (np.nonzero(group["block"].to_numpy() == group[c].iloc[0])[0] for c in ("i", "j"))
    both = np.zeros((len(first), len(second)), np.float32)
    for low in range(0, len(shared), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[member[a:b], column[a:b] - low] = 1
        both += part[first] @ part[second].T
    union = size[first][:, None] + size[second][None, :] - both
    x, y = np.nonzero((100 * both >= LEAST * union) & (own[first][:, None] != own[second][None, :]))
    if not len(x):
        return none
    x, y = first[x], second[y]
    _, one = np.unique(np.stack([own[x], own[y]]), axis=1, return_index=True)
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while up.setdefault(c, c) != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    kept = []
    for k in one.tolist():
        p, q = root(own[x[k]]), root(own[y[k]])
        if p != q:
            up[p] = q
            kept.append(k)
    a, b = ids[x[kept]], ids[y[kept]]
    return pd.DataFrame({"u": np.maximum(a, b), "v": np.minimum(a, b)})


def _link(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, component`` of all bucket members (key, id) with a link, by confirmed links only."""
    centre = members.groupBy("key").agg(F.min("id").alias("m"), F.max("id").alias("n"))
    near = members.join(centre, "key")
    pairs = near.where("id <> m").select(*_pair(F.col("id"), F.col("m"))).unionByName(
        near.where("id <> n").select(*_pair(F.col("id"), F.col("n")))).distinct()
    edges = settle(_confirmed(pairs, sets), "confirmed")
    found = settle(components(edges), "components")
    owned = members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    mixed = owned.groupBy("key").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first"),
    ).where("a < b AND n > 3").select("key", "first")
    open_ = settle(owned.join(mixed, "key").select("id", "component", "first").distinct(), "open")
    if open_.isEmpty():
        return found
    clumps = components(open_.select(F.col("id").alias("u"), F.col("first").alias("v")))
    held = (
        open_.select("id", "component").distinct()
        .join(clumps.select(F.col("node").alias("id"), F.col("component").alias("clump")), "id")
        .join(sets.select(F.col("doc_id").alias("id"), "shingles"), "id")
    )
    held = settle(held, "clumps")
    blocks = held.groupBy("clump").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum(F.length("shingles")) / (8 * BLOCK_SHINGLES))).cast("int").alias("blocks"))
    dealt = (
        held.join(blocks, "clump").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        .select("clump", "i", "j", "block", "id", "component", "shingles")
    )
    more = dealt.groupBy("clump", "i", "j").applyInPandas(_between_blocks, "u long, v long")
    return settle(components(edges.unionByName(more)), "components")


def _link_ids(rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with the classes joined that hold rows of one id."""
    own = rows.drop("keys").join(classes.drop("keys"), ["set_a", "set_b", "n_shingles"])
    edges = own.select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    known = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return settle(components(edges.unionByName(known)), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; shingles are five words.
    Rows without words have no shingles and stand alone, with their own id. Rows with a NULL doc_id
    are linked with nothing: component NULL, kept. Repeated rows and rows that share an id give a row
    each; a link of one of them holds for the id. Other columns are ignored; no rows give no rows.
    ``component_id`` is the smallest id reachable over links; ``kept`` says whether the row's is it.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>"
    sketch = settle(slim.mapInArrow(_sketch, schema), "sketch")
    worded = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = settle(worded.groupBy("set_a", "set_b", "n_shingles").agg(
        F.min("doc_id").alias("id"), F.min_by("keys", "doc_id").alias("keys")), "classes")
    by_key = classes.select("id", F.explode("keys").alias("key"))
    shared = by_key.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = settle(by_key.join(shared, "key").select("key", "id"), "members")
    involved = members.select(F.col("id").alias("doc_id")).distinct()
    texts = slim.join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = settle(texts.mapInArrow(_full_sets, "doc_id long, shingles binary, minima binary"), "sets")
    found = _link(members, sets)
    same = sketch.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    if not same.isEmpty():
        found = _link_ids(worded.join(same, "doc_id"), classes, found)
    named = classes.drop("keys").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "set_a", "set_b", "n_shingles", F.coalesce("component", "id").alias("_component"))
    out = sketch.drop("keys").join(named, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("_component"))).otherwise(F.col("doc_id"))
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one for each component, with the same columns. Rows without an id all stay.

    Of rows that share an id, the one with the longest text stays, then the last in order of the text and
    of the other columns that have an order (maps have none), so that every run keeps the same row. Only such
    rows are compared; a row whose id comes once is passed on. Columns may have any names. NULL and
    empty texts are linked with nothing; no rows give no rows."""
    per_id = near_duplicates(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("kept").alias("kept"), (F.count(F.lit(1)) > 1).alias("again")).where("kept")
    per_id = settle(per_id.drop("kept"), "stay")
    once = docs.join(per_id.where("NOT again").select("doc_id"), "doc_id", "left_semi")
    several = docs.join(per_id.where("again").select("doc_id"), "doc_id", "left_semi")
    order = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in ("doc_id", "text") and _orderable(f.dataType)]
    rank = F.struct(F.octet_length("text"), F.col("text"), *order)
    last = several.groupBy("doc_id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), rank).alias("row"))
    last = last.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return once.select(*[f"`{c}`" for c in docs.columns]).unionByName(last).unionByName(docs.where("doc_id IS NULL"))
