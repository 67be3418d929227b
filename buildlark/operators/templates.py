"""Log-template mining: the online fixed-depth-tree method of He et al. (ICWS 2017) as Spark jobs.

Two lines can meet only in the same leaf (token count and the branch keys of the leading tokens),
and inside a leaf the method is sequential: each line joins the most similar template so far,
generalising it, or starts a new one. A leaf may hold most of the data, so it must not become one
task. What makes it parallel is that very few lines change anything. Call a line that starts or
generalises a template a *step*; a leaf with C templates of L tokens has at most C * (L + 1) of
them, however many lines it holds. Given the right steps, the templates at any position follow
from the steps before it, so the leaf's chunks can be worked through independently.

``mine`` guesses the steps from the distinct lines, lets every chunk replay the steps before it
and then its own lines, and collects the steps a chunk finds that were not known. No unknown step
anywhere means that each chunk started from exactly what the sequential method would have had
there, so the result is the sequential one. Otherwise the earliest unknown steps are added and
the leaves concerned are gone through again; each round makes at least one more chunk right.

A line with too few words besides wildcards is not similar even to itself: every such line is a
template of its own, however often it comes, and no line ever joins one. These *loners* change
nothing for others and are numbered without going through chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlark.functions import logtext
from buildlark.operators.ordering import number_globally, number_rows, quantile_buckets, salted_join
from buildlark.session import settle

# Fixed values of the method.
DEPTH = 4
SIMILARITY = 0.4
MAX_CHILDREN = 100
EXAMPLES = 3

CHUNK_LINES = 200_000  # lines of one leaf that one task works through
FAN_IN = 64  # chunks whose step guesses are merged by one task
STEPS_PER_ROUND = 4096  # unknown steps per leaf taken up in one round; the next rounds take the rest
BLOCK = 1024  # stored templates, or distinct lines, of one key that are compared in one piece
_SEP = "\x1f"


@dataclass
class Mined:
    """``lines``: one row per line; ``templates``: one per template; the rest lets mining go on."""

    lines: DataFrame
    templates: DataFrame
    steps: DataFrame
    branches: DataFrame


# ---------------------------------------------------------------------------
# Leaf keys
# ---------------------------------------------------------------------------
def masked_line(line: Column) -> Column:
    """The masked line with single blanks; one wildcard for an empty line."""
    text = F.coalesce(line, F.lit(""))
    joined = F.array_join(logtext.tokens(logtext.mask(text)), " ")
    return F.when(logtext.is_blank(text), F.lit(logtext.WILDCARD)).otherwise(joined)


def first_keys(
    keyed: DataFrame, node: str, key: str, pos: str, max_children: int = MAX_CHILDREN
) -> DataFrame:
    """(node, key, first_pos) of the first ``max_children`` distinct keys seen at each node."""
    seen = keyed.where(F.col(key).isNotNull()).groupBy(node, key).agg(F.min(pos).alias("first_pos"))
    order = Window.partitionBy(node).orderBy("first_pos", key)
    return seen.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_children).drop("_r")


def _route(lines: DataFrame, depth: int, branches_at) -> tuple[DataFrame, list[DataFrame]]:
    """Add ``leaf`` to lines that have ``masked``; ``branches_at(i, keyed)`` gives level i's keys."""
    toks = F.split("masked", " ")
    out = lines.withColumn("leaf", F.size(toks).cast("string"))
    used = []
    for i in range(depth - 2):
        keyed = out.withColumn("_key", logtext.branch_key(F.get(F.split("masked", " "), F.lit(i))))
        kept = branches_at(i, keyed).select(F.col("node").alias("leaf"), F.col("key").alias("_key"), "first_pos")
        used.append(kept.select(
            F.lit(i).alias("level"), F.col("leaf").alias("node"), F.col("_key").alias("key"), "first_pos"
        ))
        own = kept.select("leaf", "_key", F.lit(True).alias("_own"))
        branch = F.when(F.col("_own"), F.col("_key")).otherwise(F.lit(logtext.WILDCARD))
        out = (
            keyed.join(own, ["leaf", "_key"], "left")
            .withColumn("leaf", F.when(F.col("_key").isNull(), F.col("leaf")).otherwise(
                F.concat_ws(_SEP, "leaf", branch)))
            .drop("_key", "_own")
        )
    return out, used


def with_leaf(
    lines: DataFrame, depth: int, max_children: int, prior: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Add the leaf of each line; also return the branch keys (level, node, key, first_pos)."""

    def branches_at(i: int, keyed: DataFrame) -> DataFrame:
        seen = keyed.select(F.col("leaf").alias("node"), F.col("_key").alias("key"), F.col("pos"))
        if prior is not None:
            old = prior.where(F.col("level") == i).select("node", "key", F.col("first_pos").alias("pos"))
            seen = seen.unionByName(old)
        return first_keys(seen, "node", "key", "pos", max_children)

    out, used = _route(lines, depth, branches_at)
    branches = used[0]
    for u in used[1:]:
        branches = branches.unionByName(u)
    return out, branches


# ---------------------------------------------------------------------------
# One leaf's templates, inside a task
# ---------------------------------------------------------------------------
class _Templates:
    """Templates of one leaf as rows of token codes; code 0 is the wildcard."""

    def __init__(self, similarity: float) -> None:
        self.similarity = similarity
        self.codes: dict[str, int] = {logtext.WILDCARD: 0}
        self.words: list[str] = [logtext.WILDCARD]  # by code
        self.rows: np.ndarray | None = None
        self.n = 0
        self.known: dict[str, tuple[int, str]] = {}  # masked line -> answer while nothing changes

    def text(self, i: int) -> str:
        return " ".join(self.words[c] for c in self.rows[i])

    def code(self, word: str) -> int:
        known = self.codes.setdefault(word, len(self.words))
        if known == len(self.words):
            self.words.append(word)
        return known

    def take(self, masked: str) -> tuple[int, str, bool]:
        """Template number and text for a line, and whether the line was a step."""
        hit = self.known.get(masked)
        if hit is not None:
            return hit[0], hit[1], False
        line = np.array([self.code(t) for t in masked.split(" ")], dtype=np.int64)
        best = self._closest(line)
        if best < 0:
            if self.rows is None:
                self.rows = np.zeros((8, len(line)), dtype=np.int64)
            elif self.n == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            best, step = self.n, True
            self.rows[best] = line
            self.n += 1
        else:
            merged = np.where(self.rows[best] == line, line, 0)
            step = bool((merged != self.rows[best]).any())
            self.rows[best] = merged
        if step:
            self.known.clear()
        self.known[masked] = best, self.text(best)
        return *self.known[masked], step

    def _closest(self, line: np.ndarray) -> int:
        """The most similar template, the one with more wildcards on a tie; -1 if none is close."""
        if not self.n:
            return -1
        rows = self.rows[: self.n]
        same = ((rows == line) & (rows != 0)).sum(axis=1)
        wild = (rows == 0).sum(axis=1)
        best = int(np.argmax(same * (len(line) + 1) + wild))
        return best if int(same[best]) / float(len(line)) >= self.similarity else -1


def _own_steps(similarity: float):
    """Grouped map: the lines of a group that are steps when the group stands alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        state = _Templates(similarity)
        return pdf[[state.take(m)[2] for m in pdf["masked"]]]

    return run


def _work_chunk(similarity: float, columns: Sequence[str]):
    """Cogrouped map: one chunk's lines after the steps known before and inside it."""

    def run(lines: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        if lines.empty:
            return pd.DataFrame(columns=columns)
        lines = lines.sort_values("pos")
        start = lines["pos"].iloc[0]
        state = _Templates(similarity)
        for m in steps[steps["step_pos"] < start].sort_values("step_pos")["masked"]:
            state.take(m)
        known = set(steps["step_pos"])
        taken = [state.take(m) for m in lines["masked"]]
        lines["cluster"] = [t[0] for t in taken]
        lines["template_online"] = [t[1] for t in taken]
        lines["unknown_step"] = [t[2] and p not in known for t, p in zip(taken, lines["pos"])]
        return lines[list(columns)]

    return run


def _final_templates(similarity: float):
    """Grouped map: the templates of a leaf after all its steps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        state = _Templates(similarity)
        first: list[int] = []
        for p, m in zip(pdf["pos"], pdf["masked"]):
            if state.take(m)[0] == len(first):
                first.append(p)
        return pd.DataFrame({
            "leaf": pdf["leaf"].iloc[0],
            "cluster": range(state.n),
            "template": [state.text(i) for i in range(state.n)],
            "first_pos": first,
        })

    return run


# ---------------------------------------------------------------------------
# Mining
# ---------------------------------------------------------------------------
# ``_rank`` is a line's place in its leaf, from 1 on: chunks hold equally many lines whatever the
# positions are (negative, far apart, hashes). Steps of an earlier run have rank 0.
_STEP = "leaf string, pos long, _rank long, masked string"
_STEP_COLUMNS = ("leaf", "pos", "_rank", "masked")


def _chunk(width: int) -> Column:
    return F.floor((F.col("_rank") - 1) / F.lit(width))


def _guess_steps(lines: DataFrame, similarity: float, chunk_lines: int) -> DataFrame:
    """Steps of the distinct lines in order of first appearance, merged chunk by chunk."""
    out = lines.groupBy("leaf", "masked").agg(F.min("pos").alias("pos"), F.min("_rank").alias("_rank"))
    out = out.select(*_STEP_COLUMNS)
    most = lines.agg(F.max("_rank")).first()[0] or 0
    own = _own_steps(similarity)
    width = chunk_lines
    while True:
        out = out.groupBy("leaf", _chunk(width).alias("chunk")).applyInPandas(own, _STEP)
        if most <= width:
            return out
        width *= FAN_IN


def _work(lines: DataFrame, steps: DataFrame, similarity: float, chunk_lines: int, carry) -> DataFrame:
    """Work through every chunk of ``lines`` from the steps known so far."""
    chunk = _chunk(chunk_lines)
    cut = lines.withColumn("chunk", chunk)
    chunks = cut.select("leaf", "chunk").distinct()
    for_chunk = (
        steps.select("leaf", F.col("pos").alias("step_pos"), "masked", chunk.alias("step_chunk"))
        .join(chunks, "leaf")
        .where("step_chunk <= chunk")
        .select(F.col("leaf").alias("step_leaf"), F.col("chunk").alias("for_chunk"), "step_pos", "masked")
    )
    columns = [*_STEP_COLUMNS, *carry, "cluster", "template_online", "unknown_step"]
    types = dict(lines.dtypes) | {"cluster": "int", "template_online": "string", "unknown_step": "boolean"}
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns)
    return (
        cut.groupBy("leaf", "chunk")
        .cogroup(for_chunk.groupBy("step_leaf", "for_chunk"))
        .applyInPandas(_work_chunk(similarity, columns), schema)
    )


def _is_loner(similarity: float, text: str = "masked") -> Column:
    toks = F.split(text, " ")
    words = F.size(F.filter(toks, lambda t: t != logtext.WILDCARD))
    return words / F.size(toks).cast("double") < similarity


def mine(
    lines: DataFrame,
    carry: Sequence[str] = (),
    depth: int = DEPTH,
    similarity: float = SIMILARITY,
    max_children: int = MAX_CHILDREN,
    chunk_lines: int = CHUNK_LINES,
    strip_timestamp: bool = False,
    prior: tuple[DataFrame, DataFrame] | None = None,
) -> Mined:
    """Mine templates from ``lines`` (pos long, unique and in reading order; raw string).

    ``carry`` names columns to keep on the lines. ``prior`` is (steps, branches) of an earlier
    run whose positions all lie before these lines; mining then goes on from there.
    ``strip_timestamp`` takes the stamp off a line before masking: stamped lines otherwise share
    their leading tokens and land in few leaves.
    """
    if depth < 3:
        raise ValueError("depth must be at least 3")
    raw = F.col("raw")
    text = logtext.without_timestamp(raw) if strip_timestamp else raw
    base = lines.select("pos", *carry, masked_line(text).alias("masked"))
    old_steps, old_branches = prior if prior else (None, None)
    masked = quantile_buckets(settle(base, "masked"), "pos", "_bucket")
    routed, branches = with_leaf(masked, depth, max_children, old_branches)
    ranked = number_rows(routed, ["leaf"], "_bucket", [F.col("pos")], "_rank").drop("_bucket")
    routed = settle(ranked, "routed")
    branches = settle(branches, "branches")

    own_lines, routed = routed.where(_is_loner(similarity)), routed.where(~_is_loner(similarity))
    loners = own_lines.select("leaf", "pos", "masked")

    steps = _guess_steps(routed, similarity, chunk_lines)
    if old_steps is not None:
        loners = loners.unionByName(old_steps.where(_is_loner(similarity)).select("leaf", "pos", "masked"))
        old_steps = old_steps.where(~_is_loner(similarity))
        steps = old_steps.select("leaf", "pos", F.lit(0).cast("long").alias("_rank"), "masked").unionByName(steps)
    steps = settle(steps, "steps")

    open_lines, settled = routed, None
    while True:
        out = settle(_work(open_lines, steps, similarity, chunk_lines, carry), "worked")
        unknown = out.where("unknown_step").select(*_STEP_COLUMNS)
        leaves = settle(unknown.select("leaf").distinct(), "open")
        done = out.join(leaves, "leaf", "left_anti").drop("unknown_step")
        settled = done if settled is None else settled.unionByName(done)
        if leaves.isEmpty():
            break
        first = Window.partitionBy("leaf").orderBy("pos")
        next_up = unknown.withColumn("_r", F.row_number().over(first)).where(f"_r <= {STEPS_PER_ROUND}").drop("_r")
        more = steps.unionByName(next_up)
        kept = more.join(leaves, "leaf", "left_semi").groupBy("leaf").applyInPandas(_own_steps(similarity), _STEP)
        steps = settle(kept.unionByName(steps.join(leaves, "leaf", "left_anti")), "steps")
        open_lines = open_lines.join(leaves, "leaf", "left_semi")

    found = steps.groupBy("leaf").applyInPandas(
        _final_templates(similarity), "leaf string, cluster int, template string, first_pos long"
    ).unionByName(loners.select(
        "leaf", F.lit(-1).alias("cluster"), F.col("masked").alias("template"), F.col("pos").alias("first_pos")
    ))
    numbered = settle(number_globally(found, "first_pos", "_no"), "templates").withColumn(
        "event_id", logtext.event_id(F.col("_no") - 1)
    ).drop("_no")
    named = settled.join(numbered.select("leaf", "cluster", "event_id", "template"), ["leaf", "cluster"])
    own_ids = numbered.where("cluster = -1").select("cluster", F.col("first_pos").alias("pos"), "event_id", "template")
    alone = own_lines.withColumn("template_online", F.col("masked")).join(own_ids, "pos")
    every = named.unionByName(alone).drop("_rank")
    return Mined(every, numbered, steps.drop("_rank").unionByName(loners), branches)


def summarise(
    assigned: DataFrame, templates: DataFrame, lines: DataFrame, top_k: int | None = None
) -> DataFrame:
    """(event_id, template, count, examples) per template, most frequent first.

    ``assigned`` has pos and event_id, ``templates`` event_id, template and first_pos, ``lines``
    pos and raw. The examples are picked by position before any text is touched.
    """
    counts = assigned.groupBy("event_id").agg(F.count(F.lit(1)).alias("count"))
    ranked = (
        templates.select("event_id", "template", "first_pos").join(counts, "event_id")
        .orderBy(F.desc("count"), "first_pos")
    )
    ranked = ranked if top_k is None else ranked.limit(top_k)
    first = Window.partitionBy("event_id").orderBy("pos")
    picked = (
        assigned.select("event_id", "pos").withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= EXAMPLES)
    )
    shown = (
        picked.join(lines.select("pos", "raw"), "pos")
        .groupBy("event_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "raw"))).alias("e"))
        .select("event_id", F.transform("e", lambda x: x["raw"]).alias("examples"))
    )
    out = ranked.join(shown, "event_id").orderBy(F.desc("count"), "first_pos")
    return out.select("event_id", "template", "count", "examples")


def parse_batch(
    lines: DataFrame, source: str | None = None, syslog_year: int = 1900, **mine_options
) -> DataFrame:
    """One parsed record per line: template, parameters, level, service, time and time delta.

    ``source`` names a column whose values are read as separate streams for the time delta.
    """
    from buildlark.functions import times
    from buildlark.operators.ordering import last_value_before

    group = [source] if source else []
    mined = mine(lines, carry=["raw", *group], **mine_options)
    raw = F.col("raw")
    recs = mined.lines.select(
        "pos", *group, "raw",
        F.col("template_online").alias("template"),
        F.col("template").alias("final_template"),
        "event_id",
        logtext.parameters(F.split("template_online", " "), F.split("masked", " ")).alias("parameters"),
        logtext.level(raw).alias("log_level"),
        logtext.service(raw).alias("service"),
        logtext.timestamp(raw, syslog_year).alias("timestamp"),
    )
    dated = last_value_before(recs, group, "pos", "timestamp", "_prev")
    delta = times.seconds_between(F.col("timestamp"), F.col("_prev"))
    return dated.withColumn("timestamp_delta_sec", delta).drop("_prev")


# ---------------------------------------------------------------------------
# Assigning lines to templates that are already there
# ---------------------------------------------------------------------------
def _places(templates: DataFrame, wide: DataFrame) -> DataFrame:
    """(leaf, places) of wide leaves: the word positions, those with most different words first."""
    words = templates.join(wide, "leaf", "left_semi").select("leaf", F.posexplode(F.split("template", " ")).alias("at", "word"))
    kinds = words.where(F.col("word") != logtext.WILDCARD).groupBy("leaf", "at").agg(F.approx_count_distinct("word").alias("n"))
    return kinds.groupBy("leaf").agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "at"))), lambda k: k["at"]).alias("places"))


def _fewest(size: Column, similarity: float) -> Column:
    """Words that two lines of ``size`` tokens must share to be similar, at least."""
    return F.greatest(F.lit(1), F.ceil(F.lit(similarity) * size - F.lit(1e-9)).cast("int"))


def _keyed(rows: DataFrame, text: str, similarity: float) -> DataFrame:
    """Add ``toks`` and one row per key (at, word): one for all in a leaf without ``places``, else the
    first words in their order that cannot all be left out of what two similar lines share."""
    toks = F.col("toks")
    own = F.filter(
        F.transform("places", lambda at: F.struct(at.alias("at"), F.get(toks, at).alias("word"))),
        lambda k: k["word"] != logtext.WILDCARD,
    )
    words = F.size(F.filter(toks, lambda t: t != logtext.WILDCARD))
    first = F.slice(own, F.lit(1), words - _fewest(F.size(toks), similarity) + 1)
    every = F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("word")))
    keys = F.when(F.col("places").isNull(), every).otherwise(first)
    keyed = rows.withColumn("toks", F.split(text, " ")).withColumn("_key", F.explode(keys)).drop("places")
    return keyed.select("*", "_key.at", "_key.word").drop("_key")


def assign(
    lines: DataFrame,
    templates: DataFrame,
    branches: DataFrame,
    depth: int = DEPTH,
    similarity: float = SIMILARITY,
    unseen: str = "__OTHER__",
) -> DataFrame:
    """Add the event id of the closest stored template to lines with ``masked``; changes nothing.

    Distinct masked lines meet the templates of their leaf as rows. Whatever has too few words to reach
    ``similarity`` (loners among them) is left out first, as it can match nothing. In a leaf with very many
    templates only those are compared that share one of the words of ``_keyed``. Templates and lines of
    one key are dealt to blocks of about ``BLOCK``, and every pair of blocks is a piece of work of its own.
    """

    def branches_at(i: int, keyed: DataFrame) -> DataFrame:
        return branches.where(F.col("level") == i).select("node", "key", "first_pos")

    distinct = lines.select("masked").distinct().where(~_is_loner(similarity))
    routed = settle(_route(distinct, depth, branches_at)[0].select("leaf", "masked"), "distinct")
    able = templates.where(~_is_loner(similarity, "template")).select("leaf", "event_id", "first_pos", "template")
    able = settle(able, "able")

    size = F.split("leaf", _SEP)[0].cast("int")
    many = F.lit(similarity > 0) & (F.col("n") > BLOCK * (size - _fewest(size, similarity) + 1))
    leaves = able.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    plan = settle(leaves.select("leaf").join(_places(able, leaves.where(many)), "leaf", "left"), "leaves")
    stored = _keyed(salted_join(able, plan, ["leaf"], F.col("template")), "template", similarity)
    asked = _keyed(salted_join(routed, plan, ["leaf"], F.col("masked")), "masked", similarity)

    key = ["leaf", "at", "word"]
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int")
    cells = settle(
        stored.groupBy(key).agg(blocks.alias("t_blocks")).join(asked.groupBy(key).agg(blocks.alias("l_blocks")), key), "cells")

    def dealt(rows: DataFrame, spread: Column, own: str, other: str) -> DataFrame:
        out = salted_join(rows, cells, key, spread)
        out = out.withColumn(own, F.pmod(F.xxhash64(spread), F.col(f"{own}_blocks")).cast("int"))
        out = out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
        return out.drop("t_blocks", "l_blocks")

    left = dealt(asked, F.col("masked"), "l", "t")
    right = dealt(stored.withColumnRenamed("toks", "t_toks"), F.struct("template", "first_pos"), "t", "l").drop("template")
    pairs = left.join(right, [*key, "t", "l"]).withColumn("sim", logtext.similarity(F.col("t_toks"), F.col("toks")))
    best = F.max(F.struct(
        "sim", logtext.wildcard_count(F.col("t_toks")).alias("wild"), (-F.col("first_pos")).alias("early"), "event_id"))
    matched = pairs.where(F.col("sim") >= similarity).groupBy("masked").agg(best.alias("_best")).select("masked", "_best.event_id")
    return lines.join(matched, "masked", "left").withColumn("event_id", F.coalesce("event_id", F.lit(unseen)))
