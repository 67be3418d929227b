"""Boosted trees on sparse vectors: several of Spark's GBTClassifier fits over one table, in shared passes.

The models are Spark's, grown by its rules: the first tree fits the labels as -1 and 1, each further one the
pseudo-residuals of the logistic loss of the sum so far; a node is split where the variance falls most, over at most
31 thresholds per feature taken from about 10 000 rows. What differs is how the sums come about. Only the cells of a
vector that are not zero are added up, and a feature's bin of zeros is what is left of its node; of two children
the smaller one is read and the other is their parent less it; and all fits, those of the folds and that of the
whole table, share each pass, where Spark reads every feature of every row on each level of each fit.

Rows are cut into blocks that Spark keeps. A block's margins are a state that is made anew from the last one after
each round and checkpointed every few rounds. The sums of a level are added up in at most ``PARTIAL`` parts.
"""

from __future__ import annotations

import json
import pickle
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlark.session import new_table_path

# Spark's fixed values.
MAX_BINS = 32
SPLIT_SAMPLE = 10_000  # rows that thresholds are taken from, MAX_BINS squared at least
EPSILON = 2.0 ** -52  # a fall of the variance up to this is rounding
CHECKPOINT_EVERY = 10

#: Rows and cells of a block at most; a row of more cells is a block of its own.
BLOCK_ROWS, BLOCK_CELLS = 1 << 16, 1 << 21
#: Parts in which the sums of a level reach the driver.
PARTIAL = 8
#: Bins that a pass adds up at once, and that are held on the driver for the next level.
PASS_BINS, HELD_BINS = 1 << 19, 1 << 22
#: Gains this close are a tie, which the first feature wins, as exact sums would have it.
TIE = 1e-9

_NODE = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
    "gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)
_TREE_PARAMS = ("maxDepth", "seed")
_BOOSTING_ONLY = ("maxIter", "stepSize", "subsamplingRate", "lossType", "validationTol", "featureSubsetStrategy", "probabilityCol", "rawPredictionCol")


# ---------------------------------------------------------------------------
# Thresholds
# ---------------------------------------------------------------------------
def thresholds(values: np.ndarray, counts: np.ndarray, total: float) -> np.ndarray:
    """Where a feature of these values other than zero may be split in ``total`` rows; Spark's rule."""
    order = np.argsort(values)
    values, counts = values[order], counts[order].astype(float)
    if not len(values):
        return values
    if total - counts.sum() > EPSILON * counts.sum() * 100:
        at = np.searchsorted(values, 0.0)
        values, counts = np.insert(values, at, 0.0), np.insert(counts, at, total - counts.sum())
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) < MAX_BINS:
        return middles
    stride, out = counts.sum() / MAX_BINS, []
    seen, target = counts[0], stride
    for i in range(1, len(values)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            out.append(middles[i - 1])
            target += stride
    return np.array(out)


def _unwrapped(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, F.unwrap_udt("features").alias("features"))


def _edges(rows: DataFrame, leave_out: list[int | None], sizes: dict[int, int], seed: int) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    """Of every feature, the thresholds of all fits, and for each fit which of these are its own."""
    of_fit = [sum(n for k, n in sizes.items() if k != out) for out in leave_out]
    wanted = max(MAX_BINS ** 2, SPLIT_SAMPLE)
    share = min(1.0, wanted / min(of_fit))
    # The sample is read three times and must stay the same.
    sample = (rows.sample(False, share, seed) if share < 1 else rows).select("fold", "features").persist(StorageLevel.MEMORY_AND_DISK)
    taken = {r["fold"]: r["n"] for r in sample.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = [float(sum(n for k, n in taken.items() if k != out)) for out in leave_out]
    v = F.col("features")
    place = F.when(v["type"] == 0, v["indices"]).otherwise(F.sequence(F.lit(0), F.size(v["values"]) - 1))
    cells = _unwrapped(sample, "fold").select("fold", F.explode(F.arrays_zip(place.alias("idx"), v["values"].alias("value"))).alias("c"))
    counted = cells.select("fold", "c.idx", "c.value").where("value <> 0").groupBy("idx", "fold", "value").agg(F.count(F.lit(1)).alias("n"))

    def of_feature(table: pa.Table) -> pa.Table:
        fold, value, n = (table.column(c).to_numpy() for c in ("fold", "value", "n"))
        out = []
        for fit, left in enumerate(leave_out):
            own = fold != left if left is not None else np.ones(len(fold), bool)
            values, at = np.unique(value[own], return_inverse=True)
            out.append(thresholds(values, np.bincount(at, n[own], len(values)), totals[fit]))
        return pa.table({"idx": table.column("idx")[:1], "cuts": pa.array([out], pa.list_(pa.list_(pa.float64())))})

    found = {r["idx"]: r["cuts"] for r in counted.groupBy("idx").applyInArrow(of_feature, "idx int, cuts array<array<double>>").collect()}
    sample.unpersist()
    size = rows.select(_size(F.unwrap_udt("features")).alias("n")).first()["n"]
    edges, own = [], []
    for f in range(size):
        cuts = [np.array(c, float) for c in found.get(f, [[]] * len(leave_out))]
        edges.append(np.unique(np.concatenate(cuts)))
        own.append([np.isin(edges[-1], c) for c in cuts])
    return edges, own


def _size(v):
    return F.coalesce(v["size"], F.size(v["values"]))


@dataclass
class Layout:
    """Where the bins of the features that can be split lie in a row of all bins."""

    features: np.ndarray
    first: np.ndarray
    width: np.ndarray
    zero: np.ndarray  # the bin that 0 falls into, from the first
    edges: list[np.ndarray]  # of every feature of a vector
    own: np.ndarray  # fits x bins: whether the fit may split behind the bin

    @property
    def bins(self) -> int:
        return int(self.width.sum())

    @staticmethod
    def of(edges: list[np.ndarray], own: list[list[np.ndarray]], fits: int) -> Layout:
        features = np.array([f for f, e in enumerate(edges) if len(e)], np.int64)
        width = np.array([len(edges[f]) + 1 for f in features], np.int64)
        first = np.cumsum(width) - width
        zero = np.array([np.searchsorted(edges[f], 0.0) for f in features], np.int64)
        may = np.zeros((fits, int(width.sum())), bool)
        for f, at in zip(features, first):
            for fit in range(fits):
                may[fit, at:at + len(edges[f])] = own[f][fit]
        return Layout(features, first, width, zero, edges, may)


# ---------------------------------------------------------------------------
# Blocks of rows
# ---------------------------------------------------------------------------
@dataclass
class Block:
    """Rows with the bins of their cells, by row and by bin."""

    label: np.ndarray  # -1 or 1
    fold: np.ndarray
    start: np.ndarray
    bins: np.ndarray
    by_bin: np.ndarray  # rows of the cells in order of bins
    bin_start: np.ndarray

    @cached_property
    def wide(self) -> np.ndarray:
        return self.by_bin.astype(np.int64)

    def bins_of(self, first: int, width: int, zero: int) -> np.ndarray:
        """Each row's bin of one feature."""
        ends = self.bin_start[first:first + width + 1]
        out = np.full(len(self.label), zero, np.int32)
        out[self.by_bin[ends[0]:ends[-1]]] = np.repeat(np.arange(width, dtype=np.int32), np.diff(ends))
        return out


def _block(label: np.ndarray, fold: np.ndarray, lens: np.ndarray, cols: np.ndarray, vals: np.ndarray, layout: Layout) -> Block:
    place = np.full(len(layout.edges), -1, np.int64)
    place[layout.features] = layout.first
    order = np.argsort(cols, kind="stable")
    bins = np.empty(len(cols), np.int64)
    ends = np.searchsorted(cols[order], np.arange(len(layout.edges) + 1))
    for f in np.flatnonzero(np.diff(ends)):
        at = order[ends[f]:ends[f + 1]]
        bins[at] = place[f] + np.searchsorted(layout.edges[f], vals[at]) if place[f] >= 0 else -1
    row = np.repeat(np.arange(len(lens)), lens)
    kept = (bins >= 0) & (vals != 0)
    row, bins = row[kept], bins[kept]
    by_bin = np.argsort(bins, kind="stable")
    small = np.uint16 if layout.bins < 1 << 16 else np.int32
    return Block(
        label * 2.0 - 1, fold, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lens)))]).astype(np.int32), bins.astype(small),
        row[by_bin].astype(np.uint16 if len(lens) <= 1 << 16 else np.int32), np.searchsorted(bins[by_bin], np.arange(layout.bins + 1)).astype(np.int32))


def _parts(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Label, fold and cells of the rows of a batch."""
    v = batch.column("features")
    kind, values, indices = v.field("type").to_numpy(), v.field("values"), v.field("indices")
    lens = np.diff(values.offsets.to_numpy()).astype(np.int64)
    vals, cols = values.flatten().to_numpy(), np.concatenate([np.arange(n) for n in lens]) if kind.any() else indices.flatten().to_numpy()
    if kind.any() and not kind.all():
        held = np.repeat(kind == 0, lens)
        cols[held] = indices.flatten().to_numpy()
    return batch.column("label").to_numpy().astype(float), batch.column("fold").to_numpy().astype(np.int32), lens, cols.astype(np.int64), vals


def _blocks(rows: DataFrame, layout: Layout) -> RDD:
    """The table as pickled blocks, one item each, kept by Spark."""
    shared = rows.sparkSession.sparkContext.broadcast(layout)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list) -> pa.RecordBatch:
            block = _block(*(np.concatenate(x) for x in zip(*held)), shared.value)
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], ["block"])

        held, n, cells = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            label, fold, lens, cols, vals = _parts(batch)
            ends, at = np.concatenate([[0], np.cumsum(lens)]), 0
            while at < len(label):
                room = int(np.searchsorted(ends, ends[at] + BLOCK_CELLS - cells, "right")) - 1
                to = min(len(label), at + BLOCK_ROWS - n, room)
                if to <= at:
                    if held:
                        yield done(held)
                        held, n, cells = [], 0, 0
                        continue
                    to = at + 1
                part = slice(ends[at], ends[to])
                held.append((label[at:to], fold[at:to], lens[at:to], cols[part], vals[part]))
                n, cells, at = n + to - at, cells + int(ends[to] - ends[at]), to
        if held:
            yield done(held)

    blocks = _unwrapped(rows, "label", "fold").mapInArrow(cut, "block binary").rdd.map(lambda r: bytes(r[0]))
    return _one_by_one(blocks).persist(StorageLevel.MEMORY_AND_DISK)


def _one_by_one(rdd: RDD) -> RDD:
    """With one item a batch, so that it can be zipped without being written anew."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


# ---------------------------------------------------------------------------
# Trees as they are grown
# ---------------------------------------------------------------------------
@dataclass
class Level:
    """The nodes of a level; the last entry of each array is that of rows which are in none."""

    column: np.ndarray  # which of ``splits``, -1 for a leaf
    edge: np.ndarray
    child: np.ndarray  # place of the left child in the next level, the right one follows
    value: np.ndarray  # of a leaf, else 0
    splits: list[tuple[int, int, int]]  # first bin, width, bin of zero of the features


def _walk(block: Block, levels: list[Level], out: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Each row's place in the level after these, -1 for none, and the value of the leaf it came to."""
    at = np.zeros(len(block.label), np.int64)
    if out is not None:
        at[block.fold == out] = -1
    value = np.zeros(len(at))
    for level in levels:
        value += level.value[at]
        column = level.column[at]
        right = np.zeros(len(at), bool)
        for c, split in enumerate(level.splits):
            mine = column == c
            right[mine] = (block.bins_of(*split) > level.edge[at])[mine]
        at = np.where(column >= 0, level.child[at] + right, -1)
    return at, value


def _residual(label: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
    """What the next tree is fitted to: the label, later minus the gradient of the logistic loss."""
    return label if margin is None else 4 * label / (1 + np.exp(np.minimum(2 * label * margin, 700)))


def _sums(block: Block, owner: np.ndarray, slots: int, bins: int, weights: list[np.ndarray | None]) -> list[np.ndarray]:
    """Slots x bins: the cells' weights, their number where None, of the rows that belong to a slot."""
    rows = np.flatnonzero(owner >= 0)
    if slots == 1 and 2 * len(rows) > len(owner):  # most rows: those that belong to none weigh nothing
        own = owner >= 0
        ends = block.bin_start.astype(np.int64)
        full, out = np.flatnonzero(np.diff(ends)), []
        for w in weights:
            out.append(np.zeros(bins))
            if len(full):
                out[-1][full] = np.add.reduceat(np.where(own, 1.0 if w is None else w, 0.0)[block.wide], ends[full])
        return out
    start = block.start[rows].astype(np.int64)
    lens = block.start[rows + 1] - start
    cell = np.repeat(start - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
    key = block.bins[cell].astype(np.int64)
    if slots > 1:
        key += np.repeat(owner[rows] * bins, lens)
    return [np.bincount(key, None if w is None else np.repeat(w[rows], lens), slots * bins).astype(float) for w in weights]


@dataclass
class Ask:
    """What a pass is to add up for a fit: the totals of a level's nodes, and the bins of those with a slot."""

    fit: int
    out: int | None
    levels: list[Level]
    nodes: int
    slot: np.ndarray  # of every node and of rows in none: -1 without
    slots: int
    counts: bool
    squares: bool

    def size(self, bins: int) -> int:
        return 3 * self.nodes + self.slots * bins * (1 + self.counts + self.squares)


def _answer(block: Block, margins: np.ndarray | None, asked: list[Ask], bins: int) -> np.ndarray:
    out = []
    for a in asked:
        at, _ = _walk(block, a.levels, a.out)
        r = _residual(block.label, None if margins is None else margins[a.fit])
        # Rows in none come first and are left out.
        out += [np.bincount(at + 1, w, a.nodes + 1)[1:].astype(float) for w in (None, r, r * r)]
        if a.slots:
            out += _sums(block, a.slot[at], a.slots, bins, [r, *[None] * a.counts, *[r * r] * a.squares])
    return np.concatenate(out)


class Rows:
    """Blocks and the margins of the trees so far."""

    def __init__(self, spark: SparkSession, blocks: RDD, bins: int, fits: int):
        self.blocks, self.bins, self.fits, self.sc = blocks, bins, fits, blocks.ctx
        self.state: RDD | None = None
        self.old: list[RDD] = []
        self.kept: str | None = None  # the checkpoint that the margins go back to
        self.rounds = 0
        self.parts = blocks.getNumPartitions()
        if self.sc.getCheckpointDir() is None:
            self.sc.setCheckpointDir(new_table_path(spark, "rounds"))

    def ask(self, asked: list[Ask]) -> np.ndarray:
        bins = self.bins
        pairs = self.blocks.map(lambda b: (b, None)) if self.state is None else self.blocks.zip(self.state)

        def work(part: int, items: Iterator) -> Iterator:
            total = None
            for b, m in items:
                got = _answer(pickle.loads(b), None if m is None else pickle.loads(m), asked, bins)
                total = got if total is None else total + got
            if total is not None:
                yield part % PARTIAL, total

        sums = pairs.mapPartitionsWithIndex(work)
        got = (sums if self.parts <= PARTIAL else sums.reduceByKey(np.add, PARTIAL)).values().collect()
        self._tidy()
        return sum(got)

    def add(self, trees: list[list[Level]], leave_out: list[int | None], weight: float) -> None:
        """Margins with another tree of each fit."""
        before, fits = self.state, self.fits
        pairs = self.blocks.map(lambda b: (b, None)) if before is None else self.blocks.zip(before)

        def more(pair: tuple) -> bytes:
            block, m = pickle.loads(pair[0]), pair[1]
            margins = np.zeros((fits, len(block.label))) if m is None else pickle.loads(m)
            for i, (levels, out) in enumerate(zip(trees, leave_out)):
                margins[i] += weight * _walk(block, levels, out)[1]
            return pickle.dumps(margins, 5)

        self.state = _one_by_one(pairs.map(more)).persist(StorageLevel.MEMORY_AND_DISK)
        self.rounds += 1
        if self.rounds % CHECKPOINT_EVERY == 0:
            self.state.checkpoint()
        if before is not None:
            self.old.append(before)

    def _tidy(self) -> None:
        """Margins that the present ones, which have just been read, were made of."""
        while self.old:
            old = self.old.pop()
            old.unpersist()
            if old.isCheckpointed():
                self.kept = old.getCheckpointFile()
        if self.kept and self.state is not None and self.state.isCheckpointed() and self.state.getCheckpointFile() != self.kept:
            self._delete(self.kept)
            self.kept = None

    def _delete(self, file: str) -> None:
        path = self.sc._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(self.sc._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        self._tidy()
        if self.state is not None:
            self.state.unpersist()
            if self.state.isCheckpointed():
                self._delete(self.state.getCheckpointFile())
        if self.kept:
            self._delete(self.kept)
        self.blocks.unpersist()


# ---------------------------------------------------------------------------
# Growing
# ---------------------------------------------------------------------------
@dataclass
class Node:
    """Of the rows that came to a node: their number, sum and sum of squares of what is fitted."""

    stats: np.ndarray
    split: tuple[int, int] | None = None  # place of the feature in the layout, edge
    gain: float = -1.0
    below: tuple[Node, Node] | None = None
    sums: list[np.ndarray] | None = None  # by bin, while they are held: sums and numbers, on the last level squares

    @property
    def value(self) -> float:
        return float(self.stats[1] / self.stats[0]) if self.stats[0] else 0.0


def _whole(sums: list[np.ndarray], totals: list[np.ndarray], layout: Layout) -> None:
    """Add to each feature's bin of zeros what its other cells leave of the node."""
    for got, total in zip(sums, totals):
        got[:, layout.first + layout.zero] += total[:, None] - np.add.reduceat(got, layout.first, axis=1)


def _best(node: Node, layout: Layout, fit: int) -> tuple[int, np.ndarray] | None:
    """The bin to split behind, and the statistics of the left side; None if no split lowers the variance.

    The fall is n_left n_right / n^2 times the squared difference of the means, which rounding leaves alone."""
    n, s = node.stats[0], node.stats[1]

    def left(x: np.ndarray) -> np.ndarray:
        up = np.cumsum(x)
        return up - np.repeat(up[layout.first] - x[layout.first], layout.width)

    ns, ss = left(node.sums[1]), left(node.sums[0])
    may = layout.own[fit] & (ns > 0) & (ns < n)
    if not may.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(may, ns * (n - ns) / (n * n) * (ss / ns - (s - ss) / (n - ns)) ** 2, -1.0)
    top = gain.max()
    if top <= EPSILON:
        return None
    at = int(np.argmax(gain >= top * (1 - TIE)))
    node.gain = float(gain[at])
    return at, np.array([ns[at], ss[at], left(node.sums[2])[at] if len(node.sums) > 2 else np.nan])


def _grow(rows: Rows, layout: Layout, leave_out: list[int | None], depth: int, counts: dict[int, np.ndarray]) -> list[tuple[Node, list[Level]]]:
    """One tree of each fit, level by level. ``counts`` keeps the roots' numbers by bin, which no round changes."""
    roots = [Node(np.zeros(3)) for _ in leave_out]
    trees: list[list[Level]] = [[] for _ in leave_out]
    front = {fit: [root] for fit, root in enumerate(roots)}
    parents: dict[int, list[Node]] = {}
    for level in range(depth):
        last = level == depth - 1
        held = 2 * layout.bins * sum(len(nodes) for nodes in front.values()) <= HELD_BINS
        # Of two children the smaller one is read, if their parent's sums are held.
        read = {fit: [i for i, node in enumerate(nodes) if level == 0 or parents[fit][i // 2].sums is None or last
                      or node.stats[0] < nodes[i ^ 1].stats[0] or (node.stats[0] == nodes[i ^ 1].stats[0] and i % 2 == 0)]
                for fit, nodes in front.items()}
        todo = [(fit, i) for fit, some in read.items() for i in some]
        at_once = max(1, PASS_BINS // max(1, layout.bins))
        for begin in range(0, len(todo), at_once):
            some = todo[begin:begin + at_once]
            asked = []
            for fit in dict.fromkeys(f for f, _ in some):
                mine = [i for f, i in some if f == fit]
                slot = np.full(len(front[fit]) + 1, -1, np.int64)
                slot[mine] = np.arange(len(mine))
                asked.append(Ask(fit, leave_out[fit], trees[fit], len(front[fit]), slot, len(mine), level > 0 or fit not in counts, last))
            got, at = rows.ask(asked), 0
            for a in asked:
                own = got[at:at + a.size(rows.bins)]
                at += len(own)
                totals, sums = own[:3 * a.nodes].reshape(3, -1), own[3 * a.nodes:].reshape(1 + a.counts + a.squares, a.slots, rows.bins)
                for node, stats in zip(front[a.fit], totals.T):
                    node.stats = stats
                mine = np.flatnonzero(a.slot >= 0)
                if not a.counts:
                    sums = np.concatenate([sums[:1], counts[a.fit][None, None], sums[1:]])
                told = [totals[k][mine] for k in ((1, 0, 2) if a.squares else (1, 0))]
                if a.counts:
                    _whole(list(sums), told, layout)
                else:
                    _whole([x for k, x in enumerate(sums) if k != 1], [x for k, x in enumerate(told) if k != 1], layout)
                if level == 0:
                    counts[a.fit] = sums[1][0]
                for j, i in enumerate(mine):
                    node = front[a.fit][i]
                    node.sums = [x[j].copy() for x in sums]
                    _split(node, layout, a.fit)
                    if not held:
                        node.sums = None
        following: dict[int, list[Node]] = {}
        for fit, nodes in front.items():
            for i in set(range(len(nodes))) - set(read[fit]):
                nodes[i].sums = [whole - other for whole, other in zip(parents[fit][i // 2].sums, nodes[i ^ 1].sums)]
                _split(nodes[i], layout, fit)
            for node in [*parents.get(fit, []), *(n for n in nodes if last or not n.below)]:
                node.sums = None
            trees[fit].append(_level(nodes, layout))
            following[fit] = [child for node in nodes if node.below for child in node.below]
        parents = {fit: [n for n in nodes if n.below] for fit, nodes in front.items()}
        front = {fit: nodes for fit, nodes in following.items() if nodes}
        if not front:
            break
    for fit, nodes in front.items():
        trees[fit].append(_level(nodes, layout))
    return list(zip(roots, trees))


def _split(node: Node, layout: Layout, fit: int) -> None:
    """Give a node its children, if a split lowers the variance."""
    found = _best(node, layout, fit)
    if found is not None:
        at, left = found
        place = int(np.searchsorted(layout.first, at, "right")) - 1
        node.split = place, int(at - layout.first[place])
        node.below = Node(left), Node(node.stats - left)


def _level(nodes: list[Node], layout: Layout) -> Level:
    used = sorted({node.split[0] for node in nodes if node.split})
    column = [used.index(node.split[0]) if node.split else -1 for node in nodes]
    child = 2 * (np.cumsum([node.split is not None for node in nodes]) - 1)
    return Level(
        np.array([*column, -1]), np.array([*(node.split[1] if node.split else 0 for node in nodes), 0]), np.array([*child, 0]),
        np.array([*(0.0 if node.split else node.value for node in nodes), 0.0]),
        [(int(layout.first[f]), int(layout.width[f]), int(layout.zero[f])) for f in used])


# ---------------------------------------------------------------------------
# Spark's models
# ---------------------------------------------------------------------------
def _stored(tree: int, root: Node, layout: Layout) -> list[tuple]:
    """A tree's nodes as Spark stores them, left before right; leaves that say the same are one."""
    out: list[tuple] = []

    def same(node: Node) -> bool:
        """Whether all leaves below have one value."""
        if not node.below:
            return True
        a, b = node.below
        return same(a) and same(b) and _leaf(a).value == _leaf(b).value

    def put(node: Node) -> int:
        at = len(out)
        out.append(())
        n, total, squares = (float(x) for x in node.stats)
        impurity = squares / n - (total / n) ** 2 if n else 0.0
        below, cut, gain = (-1, -1), (-1, [], -1), -1.0
        if node.below and not same(node):
            f = int(layout.features[node.split[0]])
            cut, gain = (f, [float(layout.edges[f][node.split[1]])], -1), node.gain
            below = put(node.below[0]), put(node.below[1])
        out[at] = (tree, (at, node.value, impurity, [n, total, squares], int(n), gain, *below, cut))
        return at

    put(root)
    return out


def _leaf(node: Node) -> Node:
    while node.below:
        node = node.below[0]
    return node


def _model(spark: SparkSession, estimator: GBTClassifier, roots: list[Node], layout: Layout) -> GBTClassificationModel:
    """The trees as a model of Spark's, by its stored form."""
    set_to, default = ({p.name: v for p, v in m.items()} for m in (estimator._paramMap, estimator._defaultParamMap))

    def about(kind: str, uid: str, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid} | more)

    of_tree = {"paramMap": {k: v for k, v in set_to.items() if k in _TREE_PARAMS}, "defaultParamMap": {k: v for k, v in default.items() if k not in _BOOSTING_ONLY}}
    trees = [(i, about("regression.DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", **of_tree), 1.0 if i == 0 else float(set_to["stepSize"]))
             for i in range(len(roots))]
    own = about("classification.GBTClassificationModel", estimator.uid, paramMap=set_to, defaultParamMap=default, numFeatures=len(layout.edges), numTrees=len(roots))
    path = new_table_path(spark, "boosted")
    spark.createDataFrame([(own,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes = [n for i, root in enumerate(roots) for n in _stored(i, root, layout)]
    spark.createDataFrame(nodes, _NODE).coalesce(1).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


def each(tasks: Iterable, fn: Callable, parallelism: int) -> list:
    """Run independent work side by side in this order, as Spark's own cross-validator does."""
    tasks = list(tasks)
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        return pool.map(inheritable_thread_target(fn), tasks, chunksize=1)


def fit(rows: DataFrame, leave_out: list[int | None], rounds: int, depth: int, step: float, seed: int) -> list[GBTClassificationModel]:
    """A model for each entry of ``leave_out``: of rows (label, fold, features) but those of that fold, None for all rows."""
    if depth < 1 or rounds < 1:
        raise ValueError("boosting takes a round and a depth of one at least")
    spark, fits = rows.sparkSession, len(leave_out)
    told = rows.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    if any(r["label"] not in (0, 1) for r in told):
        raise ValueError("labels must be 0 or 1, without nulls")
    sizes: dict[int, int] = {}
    for r in told:
        sizes[r["fold"]] = sizes.get(r["fold"], 0) + r["n"]
    if any(not sum(n for k, n in sizes.items() if k != out) for out in leave_out):
        raise ValueError("no rows to fit")
    # Work is dealt to all cores, however many files the vectors are in.
    rows = rows.select("label", "fold", "features").repartition(max(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
    layout = Layout.of(*_edges(rows, leave_out, sizes, seed), fits)
    data = Rows(spark, _blocks(rows, layout), layout.bins, fits)
    grown, counts = [], {}
    try:
        for m in range(rounds):
            trees = _grow(data, layout, leave_out, depth, counts)
            grown.append([root for root, _ in trees])
            if m < rounds - 1:
                data.add([levels for _, levels in trees], leave_out, 1.0 if m == 0 else step)
    finally:
        data.close()
    estimator = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
    return each(range(fits), lambda i: _model(spark, estimator, [roots[i] for roots in grown], layout), fits)
