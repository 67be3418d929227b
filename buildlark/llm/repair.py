"""Repair of conversations as lightest derivations.

A conversation's roles should read ``(s?(ua)+)?``. Items say "rows i to j can be read from state p to state q"
and have a value (cost, audit); edits of a row and inserted turns are the axioms, and an item is
extended by an edit or by another item that begins where it ends. Values are popped from an agenda in
the order (cost, rows read, audit). Every extension raises cost or rows read, and it keeps the order of two values
of one item, because no two audits of one item and one cost begin with one another. So the first
value popped for an item is its lightest, and the search ends when the goal item is popped.

Rows are sorted over all tasks by conversation and turn; each task reads its own run of rows. A
conversation that begins and ends inside it is repaired there. Others, and those with many rows, leave
fragments: the items of a run of rows between all pairs of states. Fragments of a conversation
are combined by the same agenda, without their texts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlark.session import settle

#: Rows, and bytes of text, that a fragment holds at most (one row is never split).
FRAGMENT_ROWS, FRAGMENT_BYTES = 2_048, 4_000_000

#: Next state by the role initial that is read: 0 nothing yet, 1 after s, 2 after u, 3 after a.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, GOALS = range(4), (0, 3)
ROLE = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}

SOUND, TRUNC, DUPLICATE, BLANK = range(4)

Edge = tuple[int, int, int, str]  # from state, to state, cost, audit
Value = tuple[int, str, tuple[int, ...]]  # cost, audit, states after each step


def edits(initial: str, fault: int, copies: int) -> list[Edge]:
    """The edits of a row and its exact copies, which must go: a row is kept, given a role, or deleted.

    Deleting the copies comes right after it, which is before an inserted turn in the order of audits."""
    rest, more = "D" * (copies - 1), DELETE * (copies - 1)
    out = [(q, q, DELETE + more, "D" + rest) for q in STATES]
    if fault in (SOUND, TRUNC):
        extra = more + (TRUNCATED if fault == TRUNC else 0)
        for (q, letter), to in NEXT.items():
            if letter == initial:
                out.append((q, to, extra, "K" + rest))
            elif letter in ROLE:
                out.append((q, to, REROLE + extra, "R" + rest))
    return out


INSERTS: list[Edge] = [(q, to, INSERT, "I") for (q, letter), to in NEXT.items() if letter in ROLE]


def lightest(steps: list[list[Edge]], starts=STATES, inserts: list[Edge] = INSERTS, goals=None) -> dict[tuple[int, int], Value]:
    """The lightest value from each start to each state after all steps; with ``goals``, only that of
    the first goal state that is popped."""
    n = len(steps)
    after = [[[e for e in step if e[0] == q] for q in STATES] for step in steps]
    same = [[e for e in inserts if e[0] == q] for q in STATES]
    agenda = [(0, 0, "", p, p, ()) for p in starts]
    heapq.heapify(agenda)
    final: set[tuple[int, int, int]] = set()
    out: dict[tuple[int, int], Value] = {}
    while agenda:
        cost, k, audit, p, q, path = heapq.heappop(agenda)
        if (k, p, q) in final:
            continue
        final.add((k, p, q))
        if k == n:
            if goals is None or q in goals:
                states, at = [], path
                while at:
                    at, s = at
                    states.append(s)
                out[p, q] = cost, audit, tuple(reversed(states))
                if goals is not None:
                    return out
        else:
            for _, to, more, letters in after[k][q]:
                if (k + 1, p, to) not in final:
                    heapq.heappush(agenda, (cost + more, k + 1, audit + letters, p, to, (path, to)))
        for _, to, more, letters in same[q]:
            if (k, p, to) not in final:
                # A turn inserted after a step belongs to it: the state after the step moves on.
                moved = (path[0], to) if path else path
                heapq.heappush(agenda, (cost + more, k, audit + letters, p, to, moved))
    return out


def repaired_lines(rows: list[tuple[str, str, int]], audit: str, state: int = 0) -> list[str]:
    """``role:text`` of each turn that ``audit`` leaves of ``rows`` (role, text, copies), from ``state`` on."""
    out, at, left = [], 0, rows[0][2] if rows else 0
    for letter in audit:
        if letter in "IR":
            to = "a" if state == 2 else "u"
            out.append(f"{ROLE[to]}:{rows[at][1] if letter == 'R' else ''}")
            state = NEXT[state, to]
        elif letter == "K":
            out.append(f"{rows[at][0]}:{rows[at][1]}")
            state = NEXT[state, rows[at][0][:1]]
        if letter != "I":
            left -= 1
            if not left:
                at += 1
                left = rows[at][2] if at < len(rows) else 0
    return out


class _Run:
    """Counts and rows of a stretch of one conversation."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, int]] = []
        self.steps: list[list[Edge]] = []
        self.counts = [0, 0, 0, 0]  # by fault
        self.illegal = self.turns = self.bytes = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn, role: str, text: str, copies: int, fault: int) -> None:
        initial = role[:1]
        self.rows.append((role, text, copies))
        self.bytes += len(role) + len(text)
        self.steps.append(edits(initial, fault, copies))
        self.counts[fault] += 1
        self.counts[BLANK if fault == BLANK else DUPLICATE] += copies - 1
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += copies - 1  # a role next to itself is never in order
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def full(self) -> bool:
        return len(self.rows) >= FRAGMENT_ROWS or self.bytes >= FRAGMENT_BYTES


FACTS = "blank long, duplicate long, truncated long, illegal long"
PIECE = pa.schema([
    ("conv_id", pa.int64()), ("place", pa.int64()), ("whole", pa.bool_()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
    ("first", pa.string()), ("last", pa.string()),
    ("values", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
    ("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())]))),
    ("digest", pa.string()),
])
PIECE_DDL = (
    f"conv_id long, place long, whole boolean, {FACTS}, turns long, low long, high long, first string, last string, "
    "values array<struct<p: int, q: int, cost: long, audit: string>>, rows array<struct<role: string, text: string, copies: long>>, digest string"
)
#: Rows made into Python values, and conversations handed on, at once.
AT_ONCE, HANDED_ON = 256, 512


def _sha256(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _piece(conv, place: int, run: _Run, whole: bool) -> dict:
    """A finished conversation, or a fragment with all its items and rows."""
    found = lightest(run.steps, (0,) if whole else STATES, goals=GOALS if whole else None)
    audit = next(iter(found.values()))[1] if whole else ""
    return {
        "conv_id": conv, "place": place, "whole": whole, "blank": run.counts[BLANK], "duplicate": run.counts[DUPLICATE],
        "truncated": run.counts[TRUNC], "illegal": run.illegal, "turns": run.turns, "low": run.low, "high": run.high,
        "first": run.first, "last": run.last,
        "values": [{"p": p, "q": q, "cost": cost, "audit": a} for (p, q), (cost, a, _) in sorted(found.items())],
        "rows": [] if whole else [{"role": r, "text": t, "copies": c} for r, t, c in run.rows],
        "digest": _sha256(repaired_lines(run.rows, audit)) if whole else None,
    }


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for low in range(0, batch.num_rows, AT_ONCE):
            yield from zip(*(c.to_pylist() for c in batch.slice(low, AT_ONCE).columns))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the conversations in a task's rows, which are in order."""
    place, held, size = TaskContext.get().partitionId() << 32, [], 0
    run, conv, begun = _Run(), None, False  # begun: the first row of the conversation is in ``run``
    for row in _rows(batches):
        if run.rows and (row[0] != conv or run.full()):
            new = row[0] != conv
            held.append(_piece(conv, place, run, begun and new))
            size += 1 if held[-1]["whole"] else 1 + run.bytes // 1_000
            place, run, begun = place + 1, _Run(), new
            if size >= HANDED_ON:
                yield pa.RecordBatch.from_pylist(held, PIECE)
                held, size = [], 0
        conv = row[0]
        run.add(*row[1:])
    if run.rows:
        held.append(_piece(conv, place, run, False))
    yield pa.RecordBatch.from_pylist(held, PIECE)


CHOSEN = pa.schema([
    ("conv_id", pa.int64()), ("place", pa.int64()), ("state", pa.int32()), ("part", pa.string()),
    ("total", pa.struct([
        ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
        ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
    ])),
])
CHOSEN_DDL = f"conv_id long, place long, state int, part string, total struct<gaps: long, {FACTS.replace(' long', ': long')}, cost: long, audit: string>"


def _combine(table: pa.Table) -> pa.Table:
    """What becomes of each fragment of one conversation; the first one carries the conversation's figures."""
    parts = sorted(table.to_pylist(), key=lambda r: r["place"])
    steps = [[(v["p"], v["q"], v["cost"], v["audit"]) for v in r["values"]] for r in parts]
    (cost, audit, states), = lightest(steps, (0,), [], GOALS).values()
    total = {k: sum(r[k] for r in parts) for k in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:]))
    dated = [r for r in parts if r["low"] is not None]
    turns = sum(r["turns"] for r in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
    gaps = dated[-1]["high"] - dated[0]["low"] + 1 - turns if dated else 0
    total |= {"gaps": gaps, "cost": cost, "audit": audit}
    out = []
    for k, (r, p, q) in enumerate(zip(parts, (0, *states), states)):
        part = next(v["audit"] for v in r["values"] if (v["p"], v["q"]) == (p, q))
        out.append({"conv_id": r["conv_id"], "place": r["place"], "state": p, "part": part, "total": None if k else total})
    return pa.Table.from_pylist(out, CHOSEN)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of each fragment after its part of the audit."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            lines = repaired_lines([(x["role"], x["text"], x["copies"]) for x in r["rows"]], r["part"], r["state"])
            yield pa.RecordBatch.from_pylist(
                [{"conv_id": r["conv_id"], "place": r["place"], "n": len(lines), "text": "\n".join(lines)}],
                pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("text", pa.string())]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation, fed fragment by fragment in order."""
    out, conv, running, any_lines, open_ = [], None, None, False, False
    for batch in batches:
        for i in range(batch.num_rows):
            c, n, text = (batch.column(x)[i].as_py() for x in ("conv_id", "n", "text"))
            if not open_ or c != conv:
                if open_:
                    out.append({"conv_id": conv, "digest": running.hexdigest()})
                conv, running, any_lines, open_ = c, hashlib.sha256(), False, True
            if n:
                running.update((b"\n" if any_lines else b"") + text.encode())
                any_lines = True
    if open_:
        out.append({"conv_id": conv, "digest": running.hexdigest()})
    yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("digest", pa.string())]))


def _named(rows: DataFrame) -> DataFrame:
    """``conv_id`` (long), ``turn`` (long), ``role`` and ``text``; a NULL role or text becomes one space."""
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with repeatable faults, by crc32 of ``conv_id:turn`` modulo 20:
    0 drops the row, 1 empties its text, 2 removes ``. ! ?``, 3 repeats it, 4 makes it the user's.

    NULLs are one space first, in the checksum too; ids and turns stay NULL."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 3, 2).otherwise(1)
    out = _named(rows).withColumn("_kind", kind).where("_kind <> 0")
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("_")).drop("_")


def _faulty(rows: DataFrame) -> DataFrame:
    """Each different row once, with the number of its ``copies`` and its ``fault``."""
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    once = once.withColumn("_same", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    # NULL turns come first; a struct with the flag keeps them in the comparison.
    at = F.struct(F.col("turn").isNotNull().alias("dated"), "turn")
    again = once.groupBy("conv_id", "_same").agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("_same").alias("_key"), "_first")
    met = once.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_same") == F.col("_key")), "left")
    solid = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), -1, 1)
    later = F.coalesce(~at.eqNullSafe(F.col("_first")) & F.col("_first").isNotNull(), F.lit(False))
    fault = F.when(F.col("_solid") == "", BLANK).when(later, DUPLICATE).when(~F.col("_solid").isin(".", "!", "?"), TRUNC).otherwise(SOUND)
    return met.withColumn("_solid", solid).select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation of
    ``rows`` (conv_id, turn, role, text), in order of turn (NULLs first), role and text.

    Edits: K keeps a row (0), R makes it the user's or the assistant's (2), D deletes it (3; blank rows and those whose
    role and text came before must go), I inserts an empty turn (2); a truncated row that stays adds 1. ``audit`` is the
    cheapest list of edits, of several the least in ASCII order.

    NULL role or text: one space. NULL turn: first, without part in gaps. NULL conv_id: one conversation. Repeated rows are
    counted before they are sent anywhere. A conversation may have more rows than a task can hold, and texts of any length
    are read whole; only its audit must fit a row. Other columns are ignored; no rows give no rows.
    """
    order = ["conv_id", "turn", "role", "text"]
    inputs = _faulty(_named(rows)).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = settle(inputs.mapInArrow(_read, PIECE_DDL), "pieces")
    whole, open_ = pieces.where("whole"), pieces.where("NOT whole")
    names = ["blank", "duplicate", "truncated", "illegal"]
    value = F.get("values", F.lit(0))
    done = whole.select(
        "conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"), *names,
        value["cost"].alias("cost"), value["audit"].alias("audit"), F.col("digest").alias("repaired_sha256"),
    )
    chosen = settle(open_.drop("rows", "digest", "whole").groupBy("conv_id").applyInArrow(_combine, CHOSEN_DDL), "chosen")
    own = chosen.select(F.col("place").alias("_place"), "state", "part")
    texts = open_.join(own, F.col("place") == F.col("_place")).select("conv_id", "place", "rows", "state", "part")
    lines = texts.mapInArrow(_rewrite, "conv_id long, place long, n long, text string")
    digests = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_digests, "conv_id long, digest string")
    totals = chosen.where("total IS NOT NULL").select("conv_id", "total.*")
    digests = digests.withColumnRenamed("conv_id", "_conv")
    joined = totals.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "gaps", *names, "cost", "audit", F.col("digest").alias("repaired_sha256"))
    return done.unionByName(joined)


def with_all(repaired: DataFrame, rows: DataFrame) -> DataFrame:
    """``repaired`` and, with zeros and an empty audit, each other conv_id of ``rows``."""
    every = rows.select(F.col("conv_id").cast("long").alias("_conv")).distinct()
    out = every.join(repaired, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        F.col("_conv").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
