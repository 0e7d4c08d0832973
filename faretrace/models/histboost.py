"""Second-order histogram boosting of many fits at once, missing values included.

A fit is a set of training rows, predictors and a target. The rows of all fits lie in one table of blocks; a row belongs to
each fit that trains on it. One job a level sums gradients and hessians into histograms keyed by (fit, node) over
(predictor, bin) and chooses each node's split where the sums meet, so that the driver sees one row a node and the number
of jobs does not depend on the number of fits. A missing value has a bin of its own and goes, at each split, to the side
where the gain is larger. A fit in a batch equals the same fit alone. Fits of at most ``ROWS_A_PARTITION`` rows each lie
in a partition of their own, where the same steps need no exchange and bins and all trees are one job.

Larger fits are one job too where the tasks that run at once can hold their rows: the tasks of a barrier stage keep
blocks, margins and the rows of each node in memory from the first tree to the last, lay the sums of a level into files of
the checkpoint folder, add up a share of the nodes each and lay the splits there too. Spark's own barrier looks once a second,
so it only begins the job. Only fits of more than ``HELD_ROWS`` rows a task take a job a level. Tasks that hold their rows sum
those of the smaller child of a split; its sibling is what is left of the parent.

Gradients and hessians are multiples of a power of two so small that all sums of a fit are exact: 29 bits below the largest
for ten million rows, where single precision has 24. So sums depend on no order, and differences of sums are sums.

Loss of a node with sums G and H is ``-G**2 / (2 * (H + l2))``; a split's gain is what it takes off. Bins are weighted
quantiles of the training rows of their own fit. Margins are kept beside the blocks; the trees since they were written ride
with each job and are added where blocks are read, and every ``CUT_EVERY`` trees a checkpoint writes them anew.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import NativeFile, fs
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from faretrace.session import cut_lineage, shared_folder, ship_package, storage, tasks_at_once

#: bins a predictor, that of missing values apart; a bin number is one byte
MAX_BINS = 255
#: points that a weighted quantile summary keeps
SUMMARY = 4096
#: rows of a block, and rows of a partition
BLOCK_ROWS, ROWS_A_PARTITION = 65_536, 400_000
#: rows from which a barrier stage takes another task, as long as there are slots
ROWS_SIDE_BY_SIDE = 200_000
#: rows that a task of a barrier stage holds at most, at about 30 bytes and less than one a predictor
HELD_ROWS = 3_000_000
#: rows of a fit from which gradients and hessians of its classes are less than 2**31 units
COUNTED_ROWS = 1 << 22
#: trees between two checkpoints of the margins
CUT_EVERY = 10
#: least gain of a split
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Task:
    """One fit: ``rows`` is an SQL condition on the design, ``positive_weight`` multiplies rows of label 1 (None: the
    weight that balances the classes)."""

    name: str
    rows: str
    columns: tuple[str, ...]
    target: str = "label"
    squared: bool = False
    positive_weight: float | None = 1.0


@dataclass(frozen=True)
class Settings:
    trees: int = 300
    depth: int = 6
    rate: float = 0.1
    l2: float = 1.0
    #: least sum of hessians on each side of a split
    least_weight: float = 1.0
    max_bins: int = MAX_BINS


@dataclass
class Tree:
    """Nodes by number: the children of i are 2i and 2i + 1, the root is 1."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    split: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    #: number of the last bin that goes left, as the cut stands for in the bins of the fit
    last_bin: np.ndarray

    def grow(self, node: int, split: tuple, settings: Settings) -> list[int]:
        """Take a node's split from ``best_splits``; the children, which are open now, or none if it is a leaf."""
        feature, last_bin, missing_left, gain, gl, hl, gr, hr = split
        if feature < 0:
            self.value[node] = -settings.rate * gl / (hl + settings.l2)
            return []
        self.feature[node], self.last_bin[node], self.missing_left[node] = feature, last_bin, missing_left
        self.split[node], self.gain[node] = True, gain
        for child, g, h in ((2 * node, gl, hl), (2 * node + 1, gr, hr)):
            self.value[child] = -settings.rate * g / (h + settings.l2)
        return [2 * node, 2 * node + 1]

    def with_cuts(self, edges: list[np.ndarray]) -> Tree:
        """Cuts from the last bins; past the last cut only missing values go right."""
        for node in np.flatnonzero(self.split):
            own = edges[self.feature[node]]
            self.cut[node] = own[self.last_bin[node]] if self.last_bin[node] < len(own) else np.inf
        return self

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 << depth
        return cls(np.zeros(n, np.int32), np.zeros(n), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n), np.zeros(n),
                   np.zeros(n, np.int32))


@dataclass
class Forest:
    """A fitted model; ``start`` is the margin before the first tree."""

    task: Task
    start: float = 0.0
    weight: float = 1.0
    rows: int = 0
    trees: list[Tree] = field(default_factory=list)
    #: no gradient or hessian of the first tree is larger
    reach: float = 1.0

    def margins(self, values: np.ndarray, depth: int) -> np.ndarray:
        """``values``: one row a predictor, NaN where missing."""
        out = np.full(values.shape[1], self.start)
        missing = np.isnan(values)
        at = np.arange(values.shape[1])
        for tree in self.trees:
            node = np.ones(len(at), np.int64)
            for _ in range(depth):
                f = tree.feature[node]
                left = np.where(missing[f, at], tree.missing_left[node], values[f, at] < tree.cut[node])
                node = np.where(tree.split[node], 2 * node + ~left, node)
            out += tree.value[node]
        return out

    def scores(self, values: np.ndarray, depth: int) -> np.ndarray:
        margins = self.margins(values, depth)
        return margins if self.task.squared else 1 / (1 + np.exp(-margins))

    def importance(self) -> list[tuple[str, float]]:
        """Mean gain of the splits on each predictor, as a share of the sum of these means."""
        n = len(self.task.columns)
        total, splits = np.zeros(n), np.zeros(n)
        for tree in self.trees:
            np.add.at(total, tree.feature[tree.split], tree.gain[tree.split])
            np.add.at(splits, tree.feature[tree.split], 1)
        mean = total / np.maximum(splits, 1)
        return list(zip(self.task.columns, (mean / (mean.sum() or 1)).tolist(), strict=True))


# ---- rows of fits --------------------------------------------------------


def _rows_of_fits(design: DataFrame, tasks: Sequence[Task], conditions: Sequence[str], columns: Sequence[str],
                  keep: Sequence[str] = ()) -> DataFrame:
    """(fit, y, the predictors, ``keep``): a row once for each fit whose condition it meets."""
    fits = ", ".join(f"CASE WHEN {condition} THEN {i} END" for i, condition in enumerate(conditions))
    targets = {t.target for t in tasks}
    if len(targets) != 1:
        raise ValueError("fits of one batch share a target")
    return design.select(
        F.explode(F.expr(f"filter(array({fits}), x -> x IS NOT NULL)")).alias("fit"),
        F.col(targets.pop()).cast("double").alias("y"), *(F.col(c).cast("float").alias(c) for c in columns),
        *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)))


def _matrix(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """One row a predictor; NULL and NaN are NaN. Values are single-precision numbers."""
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(np.float64)


def _predictors(tasks: Sequence[Task]) -> list[str]:
    return list(dict.fromkeys(c for t in tasks for c in t.columns))


# ---- weighted quantiles --------------------------------------------------


def _thinned(values: np.ndarray, weights: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their weights; of more than ``keep`` values, those at even steps of weight, each standing for
    the weight up to it. Ranks move by at most a ``keep``-th of the weight."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    begins = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, int)
    values = values[begins]
    weights = np.add.reduceat(weights, begins) if len(begins) else weights
    if len(values) <= keep:
        return values, weights
    upto = np.cumsum(weights)
    at = np.unique(np.minimum(np.searchsorted(upto, upto[-1] * np.arange(1, keep + 1) / keep), len(values) - 1))
    at[-1] = len(values) - 1
    return values[at], np.diff(np.concatenate(([0.0], upto[at])))


def cuts_of(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Values at which a new bin begins, at most ``bins`` - 1: all but the smallest if there are few, else those at even
    steps of weight."""
    values, weights = _thinned(values, weights, max(SUMMARY, bins))
    if len(values) <= bins:
        return values[1:]
    upto = np.cumsum(weights)
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins, "left"))
    return values[at[at > 0]]


def _fit_cuts(rows: DataFrame, forests: Sequence[Forest], columns: Sequence[str], bins: int) -> dict[tuple[int, int], np.ndarray]:
    """Cuts of each (fit, predictor). Tasks thin what they have seen; summaries of a predictor meet in one row group. The
    driver receives at most ``bins`` numbers a pair."""
    weights = np.array([f.weight for f in forests])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            fits, y, x = batch.column("fit").to_numpy(), batch.column("y").to_numpy(), _matrix(batch, columns)
            for fit in np.unique(fits):
                mine = fits == fit
                w = np.where(y[mine] == 1, weights[fit], 1.0)
                for i in range(len(columns)):
                    v = x[i, mine]
                    there = ~np.isnan(v)
                    old = held.get((fit, i), (np.zeros(0), np.zeros(0)))
                    held[fit, i] = _thinned(np.concatenate((old[0], v[there])), np.concatenate((old[1], w[there])), SUMMARY)
        yield _packed([(int(f), i, v, w) for (f, i), (v, w) in held.items()])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for fit, i, v, w in zip(*(batch.column(c).to_pylist() for c in ("fit", "predictor", "v", "w")), strict=True):
                held.setdefault((fit, i), []).append((v, w))
        yield _packed([(f, i, cuts_of(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)), bins), [])
                       for (f, i), parts in held.items()])

    schema = "fit int, predictor int, v array<double>, w array<double>"
    merged = rows.mapInArrow(summarise, schema).repartition("fit", "predictor").mapInArrow(merge, schema).collect()
    return {(r["fit"], r["predictor"]): np.array(r["v"], np.float64) for r in merged}


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array([x if k in kinds[:2] else np.asarray(x) for x in c], k)
                                       for c, k in zip(columns, kinds, strict=True)], ["fit", "predictor", "v", "w"])


# ---- blocks --------------------------------------------------------------


BLOCKS = "fit int, bins binary, y binary, margin binary"
_BLOCKS_ARROW = pa.schema([("fit", pa.int32()), ("bins", pa.binary()), ("y", pa.binary()), ("margin", pa.binary())])


def _block_row(fit: int, bins: np.ndarray, y: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([fit], pa.int32()), pa.array([bins.tobytes()]), pa.array([y.tobytes()]),
                                       pa.array([margin.tobytes()])], schema=_BLOCKS_ARROW)


def _to_blocks(rows: DataFrame, forests: Sequence[Forest], columns: Sequence[str], cuts: dict) -> DataFrame:
    """Blocks of one fit each: bin numbers by predictor of the fit, targets, margins."""
    starts = [f.start for f in forests]
    positions = [[columns.index(c) for c in f.task.columns] for f in forests]

    def binned(fit: int, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        bins = np.empty((len(positions[fit]), len(y)), np.uint8)
        for row, i in enumerate(positions[fit]):
            edges = cuts.get((fit, i), np.zeros(0))
            bins[row] = np.where(np.isnan(x[i]), len(edges) + 1, np.searchsorted(edges, x[i], "right"))
        return _block_row(fit, bins, y.astype(np.float64), np.full(len(y), starts[fit]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            fits, y, x = batch.column("fit").to_numpy(), batch.column("y").to_numpy(), _matrix(batch, columns)
            for fit in np.unique(fits).tolist():
                mine = fits == fit
                parts = held.setdefault(fit, [])
                parts.append((x[:, mine], y[mine]))
                if sum(len(p[1]) for p in parts) >= BLOCK_ROWS:
                    yield binned(fit, np.concatenate([p[0] for p in parts], 1), np.concatenate([p[1] for p in parts]))
                    held[fit] = []
        for fit, parts in held.items():
            if parts:
                yield binned(fit, np.concatenate([p[0] for p in parts], 1), np.concatenate([p[1] for p in parts]))

    return rows.mapInArrow(pack, BLOCKS)


def _read_blocks(batches: Iterator[pa.RecordBatch], n_columns: Sequence[int]) -> Iterator[tuple]:
    for batch in batches:
        fits = batch.column("fit").to_pylist()
        for k, fit in enumerate(fits):
            y = np.frombuffer(batch.column("y")[k].as_buffer(), np.float64)
            bins = np.frombuffer(batch.column("bins")[k].as_buffer(), np.uint8).reshape(n_columns[fit], len(y))
            yield fit, bins, y, np.frombuffer(batch.column("margin")[k].as_buffer(), np.float64)


def _nodes(tree: Tree, bins: np.ndarray, missing: np.ndarray, depth: int) -> np.ndarray:
    """Node of each row after ``depth`` levels; ``missing`` has the bin of missing values of each predictor."""
    node = np.ones(bins.shape[1], np.int64)
    for _ in range(depth):
        node = _below(tree, bins, missing, node)
    return node


def _below(tree: Tree, bins: np.ndarray, missing: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Nodes one level further down."""
    f = tree.feature[node]
    b = bins[f, np.arange(len(node))]
    left = np.where(b == missing[f], tree.missing_left[node], b <= tree.last_bin[node])
    return np.where(tree.split[node], 2 * node + ~left, node)


# ---- levels --------------------------------------------------------------


SPLITS = """fit int, turn int, node int, feature int, bin int, missing_left boolean, gain double, gl double, hl double,
gr double, hr double"""
_SPLIT_NAMES = ["fit", "turn", "node", "feature", "bin", "missing_left", "gain", "gl", "hl", "gr", "hr"]


def best_splits(g: np.ndarray, h: np.ndarray, missing: np.ndarray, settings: Settings) -> list[tuple]:
    """For each node of histograms (node, predictor, bin): predictor, last bin to the left, side of missing values, gain,
    and G and H of both sides; predictor -1 and the node's own sums if no split gains enough. Of equal gains the first
    predictor, the lowest bin and missing values to the right win."""
    return _best(_candidates(g, h, missing, np.arange(g.shape[1]), settings), g[:, 0].sum(axis=1), h[:, 0].sum(axis=1), settings)


def _candidates(g: np.ndarray, h: np.ndarray, missing: np.ndarray, names: np.ndarray, settings: Settings) -> list[list[tuple]]:
    """For each node the best splits by the predictors, called ``names``, with missing values on either side."""
    n, n_features, width = g.shape
    columns = np.arange(n_features)
    gm, hm = g[:, columns, missing], h[:, columns, missing]
    total_g, total_h = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
    g, h = g.copy(), h.copy()
    g[:, columns, missing] = h[:, columns, missing] = 0
    gl, hl = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
    # the last bin below that of missing values leaves nothing but them on the right
    usable = np.arange(width)[None, :] < missing[:, None]
    with_missing = np.flatnonzero((hm > 0).any(axis=0))
    found: list[list[tuple]] = [[] for _ in range(n)]
    for side, chosen in enumerate((columns, with_missing)):
        if not len(chosen):
            continue
        l_g, l_h = (gl, hl) if len(chosen) == n_features else (gl[:, chosen], hl[:, chosen])
        if side:
            l_g, l_h = l_g + gm[:, chosen, None], l_h + hm[:, chosen, None]
        r_g, r_h = total_g[:, None, None] - l_g, total_h[:, None, None] - l_h
        allowed = (l_h >= settings.least_weight) & (r_h >= settings.least_weight) & usable[chosen]
        kept = np.where(allowed, l_g * l_g / (l_h + settings.l2) + r_g * r_g / (r_h + settings.l2), -np.inf).reshape(n, -1)
        for k, at in enumerate(kept.argmax(axis=1).tolist()):
            f, b = divmod(at, width)
            found[k].append((-kept[k, at], int(names[chosen[f]]), b, side, l_g[k, f, b], l_h[k, f, b], r_g[k, f, b], r_h[k, f, b]))
    return found


def _best(found: list[list[tuple]], total_g: np.ndarray, total_h: np.ndarray, settings: Settings) -> list[tuple]:
    out: list[tuple] = []
    for k, of_node in enumerate(found):
        minus, f, b, side, *sums = min(of_node)
        gain = (-minus - total_g[k] ** 2 / (total_h[k] + settings.l2)) / 2
        out.append((f, b, bool(side), gain, *sums) if gain > LEAST_GAIN
                   else (-1, 0, False, 0.0, total_g[k], total_h[k], 0.0, 0.0))
    return out


def _bundles(bins: np.ndarray) -> list[tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]]:
    """Predictors whose combinations in these rows are at most 256, as one code: codes of the rows, and for each predictor
    the codes in the order of its bins, where a bin begins and which it is. Sums by code add up to sums by bin, so that many
    predictors take one pass."""
    out: list[tuple[np.ndarray, list]] = []
    n_bins = [len(np.unique(x)) for x in bins]
    for i in sorted(range(len(bins)), key=lambda i: n_bins[i]):
        for k, (codes, members) in enumerate(out):
            if len(members[0][1]) * n_bins[i] > 1 << 14:
                continue
            both = codes.astype(np.int64) << 8 | bins[i]
            used = np.flatnonzero(np.bincount(both, minlength=1 << 16))
            if len(used) <= 256:
                number = np.zeros(1 << 16, np.uint8)
                number[used] = np.arange(len(used))
                out[k] = number[both], [*((j, known[used >> 8]) for j, known in members), (i, used & 255)]
                break
        else:
            used = np.flatnonzero(np.bincount(bins[i], minlength=256))
            number = np.zeros(256, np.uint8)
            number[used] = np.arange(len(used))
            out.append((number[bins[i]], [(i, used)]))
    return [(codes, [(i, np.argsort(known, kind="stable"), *np.unique(np.sort(known), return_index=True)[::-1])
                     for i, known in members]) for codes, members in out if len(codes)]


class _Held:
    """A block in a task's memory, with what the tree that grows knows of its rows: those of each open node. Bins are kept as the
    codes of their bundles alone, and nothing of the batch that they came in."""

    def __init__(self, fit: int, bins: np.ndarray, y: np.ndarray, margin: np.ndarray):
        self.fit, self.margin = fit, margin.copy()
        self.y = y.astype(np.uint8) if np.isin(y, (0, 1)).all() else y.copy()
        self.bundles = _bundles(bins)
        #: for each predictor its bundle and the bins that the codes stand for
        self.known: dict[int, tuple[int, np.ndarray]] = {}
        for k, (_, members) in enumerate(self.bundles):
            for i, order, begins, present in members:
                known = np.empty(len(order), np.int64)
                known[order] = np.repeat(present, np.diff(np.append(begins, len(order))))
                self.known[i] = k, known
        #: multiples of ``unit``
        self.g = self.h = np.zeros(0)
        self.unit = 1.0
        self.rows: dict[int, np.ndarray] = {}

    def begin(self, g: np.ndarray, h: np.ndarray, unit: float) -> None:
        """All rows at the root of a new tree."""
        self.unit = unit
        self.g, self.h = (g, h) if unit == 1 else (np.rint(x / unit).astype(np.int32) for x in (g, h))
        self.rows = {1: np.arange(len(self.y), dtype=np.uint32)}

    def descend(self, tree: Tree, missing: np.ndarray) -> None:
        """Rows of split nodes go to the children; those of leaves are done with the tree."""
        above, self.rows = self.rows, {}
        for node, at in above.items():
            if not tree.split[node]:
                self.margin[at] += tree.value[node]
                continue
            f = int(tree.feature[node])
            k, known = self.known[f]
            left = known <= tree.last_bin[node]
            if tree.missing_left[node]:
                left |= known == missing[f]
            left = left[self.bundles[k][0].take(at)]
            self.rows[2 * node], self.rows[2 * node + 1] = at[left], at[~left]

    def finish(self, tree: Tree) -> None:
        for node, at in self.rows.items():
            self.margin[at] += tree.value[node]


class _Mail:
    """Files by which tasks that run side by side tell one another something, turn by turn."""

    def __init__(self, folder: str, names: list[str], me: int):
        self.system, self.folder = storage(folder)
        self.names, self.me, self.turn = names, me, 0

    def path(self, task: int, kind: str, turn: int) -> str:
        return posixpath.join(self.folder, f"{self.names[task]}-{kind}-{turn}")

    def lay(self, kind: str, parts: Iterable[bytes]) -> None:
        """Write this task's file of the turn; others see it whole or not at all."""
        path = self.path(self.me, kind, self.turn)
        with self.system.open_output_stream(f"{path}.part") as out:
            for part in parts:
                out.write(part)
        self.system.move(f"{path}.part", path)

    @contextmanager
    def files(self, kind: str) -> Iterator[list[NativeFile]]:
        """The files of all tasks, as soon as they are there. If a task is lost, Spark ends the stage and with it the wait."""
        opened: list[NativeFile] = []
        for task in range(len(self.names)):
            path, pause = self.path(task, kind, self.turn), 0.0002
            while self.system.get_file_info(path).type != fs.FileType.File:
                time.sleep(pause)
                pause = min(2 * pause, 0.02)
            opened.append(self.system.open_input_file(path))
        try:
            yield opened
        finally:
            for file in opened:
                file.close()

    def next_turn(self) -> None:
        """All have read the sums of this turn, and the splits of the turn before, as nobody goes on without them."""
        self.system.delete_file(self.path(self.me, "sums", self.turn))
        if self.turn:
            self.system.delete_file(self.path(self.me, "splits", self.turn - 1))
        self.turn += 1


class _Level:
    """What a task needs for one level: the trees so far grown, the open nodes, and how to read blocks."""

    def __init__(self, forests: Sequence[Forest], widths: list[np.ndarray], settings: Settings):
        self.squared = [f.task.squared for f in forests]
        self.weights = [f.weight for f in forests]
        self.missing = widths
        self.n_columns = [len(w) for w in widths]
        self.settings = settings
        self.n_rows = [f.rows for f in forests]
        self.reach = [f.reach for f in forests]
        #: where the bins of a predictor begin in a node's sums, and where they end
        self.edges = [np.concatenate([[0], np.cumsum(w + 1)]) for w in widths]
        #: for each fit the sums of the nodes of the level before, of the rows held here
        self.known: list[dict[int, np.ndarray]] = [{} for _ in forests]
        #: for each turn since the margins were written, the trees of all fits
        self.pending: list[list[Tree]] = []
        self.trees: list[Tree] = []
        self.open: list[list[int]] = []
        self.depth = 0
        #: where the tasks of a barrier stage lay their sums
        self.folder = ""

    def units(self, fit: int) -> float:
        """No sum reaches 2**53 of these units, so many of which are 1."""
        return float(2.0 ** (52 - np.ceil(np.log2(max(self.n_rows[fit], 2) * self.reach[fit]))))

    def gradients(self, fit: int, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        units = self.units(fit)
        if self.squared[fit]:
            return np.rint((margin - y) * units) / units, np.ones(len(y))
        p = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, self.weights[fit], 1.0)
        return np.rint(w * (p - y) * units) / units, np.rint(w * p * (1 - p) * units) / units

    def turned(self, fit: int) -> None:
        """A tree is grown; a margin moves by no more than its largest value."""
        if self.squared[fit]:
            self.reach[fit] += float(np.abs(self.trees[fit].value).max())

    def histograms(self, blocks: Iterable[tuple]) -> dict[int, np.ndarray]:
        """{fit: (2, open nodes, predictors, bins)} of sums of gradients and hessians."""
        held: dict[int, np.ndarray] = {}
        for fit, bins, y, margin in blocks:
            if not self.open[fit]:
                continue
            shape = len(self.open[fit]), self.n_columns[fit], int(self.missing[fit].max()) + 1
            place = np.full(2 << self.settings.depth, -1, np.int64)
            place[self.open[fit]] = np.arange(shape[0])
            at = place[_nodes(self.trees[fit], bins, self.missing[fit], self.depth)]
            there = np.flatnonzero(at >= 0)
            g, h = self.gradients(fit, y[there], self.margins(fit, bins, margin)[there])
            cells = (at[there] * (shape[1] * shape[2]) + (np.arange(shape[1]) * shape[2])[:, None] + bins[:, there]).ravel()
            sums = np.stack([np.bincount(cells, np.tile(x, shape[1]), int(np.prod(shape))) for x in (g, h)])
            sums = sums.reshape(2, *shape)
            held[fit] = held[fit] + sums if fit in held else sums
        return held

    def partial(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fit, sums in self.histograms(_read_blocks(batches, self.n_columns)).items():
            for k, node in enumerate(self.open[fit]):
                yield pa.RecordBatch.from_arrays([pa.array([fit], pa.int32()), pa.array([node], pa.int32()),
                                                  pa.array([sums[:, k].tobytes()])], ["fit", "node", "sums"])

    def merged(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, (fit, node) in enumerate(zip(batch.column("fit").to_pylist(), batch.column("node").to_pylist(), strict=True)):
                sums = np.frombuffer(batch.column("sums")[k].as_buffer(), np.float64)
                held[fit, node] = held[fit, node] + sums if (fit, node) in held else sums
        for (fit, node), sums in sorted(held.items()):
            g, h = sums.reshape(2, 1, self.n_columns[fit], -1)
            yield self.packed(fit, 0, [node], best_splits(g, h, self.missing[fit], self.settings))

    def sums(self, held: dict[int, list[_Held]]) -> dict[int, np.ndarray]:
        """{fit: (open nodes, 2, bins of all predictors)} of sums of gradients and hessians of the rows held here."""
        found: dict[int, np.ndarray] = {}
        for fit, blocks in held.items():
            nodes, edges = self.open[fit], self.edges[fit]
            if not nodes:
                continue
            n_rows = {node: sum(len(block.rows[node]) for block in blocks) for node in nodes}
            counted = [node for node in nodes if node == 1 or (n_rows[node], node) < (n_rows[node ^ 1], node ^ 1)]
            sums = np.zeros((len(counted), 2, edges[-1]))
            for block in blocks:
                rows = [block.rows[node] for node in counted]
                place = np.repeat(np.arange(len(counted)) << 8, [len(x) for x in rows])
                at = np.concatenate(rows).astype(np.intp)
                g, h = block.g.take(at), block.h.take(at)
                for codes, members in block.bundles:
                    cells = place + codes.take(at)
                    by_code = np.stack([np.bincount(cells, x, len(counted) << 8).reshape(-1, 256) for x in (g, h)], 1)
                    for i, order, begins, present in members:
                        sums[:, :, edges[i] + present] += np.add.reduceat(by_code[:, :, order], begins, axis=2)
            sums *= blocks[0].unit
            known = dict(zip(counted, sums, strict=True))
            for node in nodes:
                if node not in known:
                    known[node] = self.known[fit][node // 2] - known[node ^ 1]
            self.known[fit] = known
            found[fit] = np.stack([known[node] for node in nodes])
        return found

    def chosen(self, fit: int, sums: np.ndarray) -> list[tuple]:
        """``best_splits`` of (nodes, 2, bins of all predictors)."""
        edges, sizes = self.edges[fit], self.missing[fit] + 1
        totals = sums[:, :, :edges[1]].sum(axis=2)
        found: list[list[tuple]] = [[] for _ in sums]
        for low, high in ((0, 16), (16, 128), (128, 256)):  # predictors of much the same number of bins
            names = np.flatnonzero((sizes > low) & (sizes <= high))
            if not len(names):
                continue
            wide = np.zeros((*sums.shape[:2], len(names), int(sizes[names].max())))
            for j, i in enumerate(names):
                wide[:, :, j, :sizes[i]] = sums[:, :, edges[i]:edges[i + 1]]
            for of_node, more in zip(found, _candidates(wide[:, 0], wide[:, 1], self.missing[fit][names], names, self.settings),
                                     strict=True):
                of_node += more
        return _best(found, totals[:, 0], totals[:, 1], self.settings)

    def grown(self, blocks: list[_Held], fits: Iterable[int],
              meet: Callable[[dict[int, np.ndarray]], dict[int, list[tuple]]]) -> Iterator[pa.RecordBatch]:
        """All splits of ``fits``, whose rows are held; ``meet`` turns the sums of a level into the splits of its open nodes."""
        fits = list(fits)
        held = {fit: [block for block in blocks if block.fit == fit] for fit in sorted({block.fit for block in blocks})}
        for turn in range(self.settings.trees):
            for fit in fits:
                self.trees[fit], self.open[fit] = Tree.empty(self.settings.depth), [1]
            for block in blocks:
                counted = not self.squared[block.fit] and self.n_rows[block.fit] >= COUNTED_ROWS
                block.begin(*self.gradients(block.fit, block.y, block.margin), 1 / self.units(block.fit) if counted else 1.0)
            for _ in range(self.settings.depth):
                if not any(self.open[fit] for fit in fits):
                    break
                for fit, splits in meet(self.sums(held)).items():
                    yield self.packed(fit, turn, self.open[fit], splits)
                    self.open[fit] = [c for node, split in zip(self.open[fit], splits, strict=True)
                                      for c in self.trees[fit].grow(node, split, self.settings)]
                for block in blocks:
                    block.descend(self.trees[block.fit], self.missing[block.fit])
            for block in blocks:
                block.finish(self.trees[block.fit])
            for fit in fits:
                self.turned(fit)

    def side_by_side(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All splits of fits whose rows lie in the tasks of this barrier stage; the first task returns them."""
        tasks = BarrierTaskContext.get()
        me = tasks.partitionId()
        blocks = [_Held(*block) for block in _read_blocks(batches, self.n_columns)]
        # a file's name is its task's alone, also if the stage is run again
        mine = [uuid.uuid4().hex, sorted({block.fit for block in blocks})]
        held = [json.loads(x) for x in tasks.allGather(json.dumps(mine))]
        mail = _Mail(self.folder, [name for name, _ in held], me)
        sizes = [2 * int(edges[-1]) for edges in self.edges]

        def meet(sums: dict[int, np.ndarray]) -> dict[int, list[tuple]]:
            mail.lay("sums", (memoryview(sums[fit]).cast("B") for fit in sorted(sums)))
            # a task's file has its open fits one behind another
            places: dict[tuple[int, int], int] = {}
            for other, (_, fits) in enumerate(held):
                at = 0
                for fit in fits:
                    places[other, fit] = at
                    at += 8 * sizes[fit] * len(self.open[fit])
            share = [(fit, k) for fit, nodes in enumerate(self.open) for k in range(len(nodes))][me::len(held)]
            found = []
            with mail.files("sums") as files:
                for fit, group in groupby(share, key=lambda x: x[0]):
                    mine = [k for _, k in group]
                    total = np.zeros((len(mine), sizes[fit]))
                    for other, file in enumerate(files):
                        if (other, fit) in places:
                            for k, out in zip(mine, total, strict=True):
                                out += sums[fit][k].ravel() if other == me else np.frombuffer(
                                    file.read_at(8 * sizes[fit], places[other, fit] + 8 * sizes[fit] * k), np.float64)
                    for k, (feature, last_bin, missing_left, *numbers) in zip(
                            mine, self.chosen(fit, total.reshape(len(mine), 2, -1)), strict=True):
                        found.append((fit, k, int(feature), int(last_bin), bool(missing_left), *map(float, numbers)))
            mail.lay("splits", [json.dumps(found).encode()])
            with mail.files("splits") as files:
                met = sorted(tuple(x) for file in files for x in json.loads(file.read()))
            mail.next_turn()
            return {fit: [x[2:] for x in group] for fit, group in groupby(met, key=lambda x: x[0])}

        for splits in self.grown(blocks, range(len(self.n_columns)), meet):
            if not me:
                yield splits

    @staticmethod
    def packed(fit: int, turn: int, nodes: list[int], splits: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*((fit, turn, n, *s) for n, s in zip(nodes, splits, strict=True)), strict=True))
        kinds = [pa.int32()] * 5 + [pa.bool_()] + [pa.float64()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _SPLIT_NAMES)

    def margins(self, fit: int, bins: np.ndarray, margin: np.ndarray) -> np.ndarray:
        for trees in self.pending:
            margin = margin + trees[fit].value[_nodes(trees[fit], bins, self.missing[fit], self.settings.depth)]
        return margin

    def written(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with the pending trees added to their margins."""
        for fit, bins, y, margin in _read_blocks(batches, self.n_columns):
            yield _block_row(fit, bins, y, self.margins(fit, bins, margin))


def _splits(found: DataFrame) -> list[tuple]:
    table = found.toArrow().sort_by([(c, "ascending") for c in ("fit", "turn", "node")])
    return list(zip(*(column.to_pylist() for column in table.columns), strict=True))


def _grow_level_by_level(blocks: DataFrame, parts: int, level: _Level, forests: Sequence[Forest]) -> None:
    """One more tree for every fit, a job a level: histograms of the partitions meet by (fit, node)."""
    settings = level.settings
    level.trees = [Tree.empty(settings.depth) for _ in forests]
    level.open = [[1] for _ in forests]
    for level.depth in range(settings.depth):
        wide = min(parts, sum(map(len, level.open)))
        if not wide:
            break
        found = (blocks.mapInArrow(level.partial, "fit int, node int, sums binary").repartition(wide, "fit", "node")
                 .mapInArrow(level.merged, SPLITS))
        level.open = [[] for _ in forests]
        for fit, _, node, *split in _splits(found):
            level.open[fit] += level.trees[fit].grow(node, split, settings)
    for fit, (forest, tree) in enumerate(zip(forests, level.trees, strict=True)):
        forest.trees.append(tree)
        level.turned(fit)
    level.pending = [*level.pending, level.trees]


def _whole_fits(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Fit, predictors and targets of fits that lie here one behind another, each with all of its rows."""
    parts = ((int(fit), batch.filter(pa.compute.equal(batch.column("fit"), fit)))
             for batch in batches for fit in np.unique(batch.column("fit").to_numpy()))
    for fit, group in groupby(parts, key=lambda part: part[0]):
        read = [(_matrix(batch, columns).astype(np.float32), batch.column("y").to_numpy()) for _, batch in group]
        yield fit, np.concatenate([x for x, _ in read], 1), np.concatenate([y for _, y in read])


def _grow_alone(rows: DataFrame, columns: Sequence[str], forests: Sequence[Forest], settings: Settings) -> None:
    """Bins and all trees in one job, of fits of at most ``ROWS_A_PARTITION`` rows each that lie in one partition each. Bins
    come from all rows of the fit at once, so that they do not depend on the order in which these arrive."""
    for forest in forests:
        forest.trees = [Tree.empty(settings.depth) for _ in range(settings.trees)]
    bare = [replace(forest, trees=[]) for forest in forests]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fit, x, y in _whole_fits(batches, columns):
            weights = np.where(y == 1, bare[fit].weight, 1.0)
            x = x[[columns.index(c) for c in bare[fit].task.columns]]
            edges, bins = [], np.empty(x.shape, np.uint8)
            for i, values in enumerate(x.astype(np.float64)):
                there = ~np.isnan(values)
                edges.append(cuts_of(values[there], weights[there], settings.max_bins))
                bins[i] = np.where(there, np.searchsorted(edges[i], values, "right"), len(edges[i]) + 1)
            level = _Level(bare[fit:fit + 1], [np.array([len(own) + 1 for own in edges])], settings)
            level.trees, level.open = [Tree.empty(0)], [[]]
            block = _Held(0, bins, y, np.full(len(y), bare[fit].start))
            ends = [np.append(own, np.inf) for own in edges]  # past the last cut only missing values go right
            for splits in level.grown([block], [0], lambda sums: {0: level.chosen(0, sums[0])}):  # noqa: B023
                at = zip(splits.column("feature").to_pylist(), splits.column("bin").to_pylist(), strict=True)
                cut = [0.0 if f < 0 else ends[f][min(b, len(ends[f]) - 1)] for f, b in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fit] * len(cut), pa.int32()), *splits.columns[1:], pa.array(cut, pa.float64())], [*_SPLIT_NAMES, "cut"])

    for fit, turn, node, *split, cut in _splits(rows.mapInArrow(grow, f"{SPLITS}, cut double")):
        tree = forests[fit].trees[turn]
        if tree.grow(node, split, settings):
            tree.cut[node] = cut


def _grow_side_by_side(blocks: DataFrame, level: _Level, forests: Sequence[Forest]) -> None:
    """All trees in one job, of fits that lie in several partitions whose tasks run side by side."""
    level.trees, level.open = [Tree.empty(0)] * len(forests), [[] for _ in forests]
    for forest in forests:
        forest.trees += [Tree.empty(level.settings.depth) for _ in range(level.settings.trees)]
    with shared_folder(blocks.sparkSession, "boosting") as level.folder:
        found = _splits(blocks.mapInArrow(level.side_by_side, SPLITS, barrier=True))
    for fit, turn, node, *split in found:
        forests[fit].trees[turn].grow(node, split, level.settings)


def _spread(rows: DataFrame, forests: Sequence[Forest], parts: int) -> DataFrame:
    """Rows in ``parts`` even partitions, each fit in as few neighbouring ones as it needs, so that sums meet in few tasks."""
    ends = np.cumsum([f.rows for f in forests])
    number = lambda values: f"element_at(array({', '.join(f'{v}D' for v in values)}), fit + 1)"
    sizes = [f.rows for f in forests]
    at = f"floor(({number(ends - sizes)} + rand(11) * {number(sizes)}) * {parts}D / {ends[-1]}D)"
    return rows.withColumn("__part", F.expr(f"CAST(least({at}, {parts - 1}) AS INT)")).repartitionById(parts, "__part").drop("__part")


def _started(rows: DataFrame, tasks: Sequence[Task]) -> list[Forest]:
    """Weights and first margins, that of the weighted mean target, from one aggregate."""
    sums = {r["fit"]: r for r in rows.groupBy("fit").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), F.min("y").alias("least"), F.max("y").alias("most")).collect()}
    out = []
    for i, task in enumerate(tasks):
        if i not in sums:
            raise ValueError(f"fit {task.name} has no training rows")
        n, total, least, most = (sums[i][c] for c in ("n", "total", "least", "most"))
        if task.squared:
            out.append(Forest(task, total / n, 1.0, n, reach=max(most - least, 1e-9)))
            continue
        weight = (n - total) / max(total, 1) if task.positive_weight is None else task.positive_weight
        share = min(max(weight * total / (weight * total + n - total or 1), 1e-6), 1 - 1e-6)
        out.append(Forest(task, float(np.log(share / (1 - share))), float(weight), n, reach=max(weight, 1) * max(abs(most), 1)))
    return out


def fit_many(design: DataFrame, tasks: Sequence[Task], settings: Settings = Settings()) -> list[Forest]:
    """Fit all ``tasks`` on ``design`` together. Rows without a target train nothing. ``design`` is read two or three times:
    persist it or give a written table."""
    if not tasks:
        return []
    ship_package(design.sparkSession)
    columns = _predictors(tasks)
    rows = _rows_of_fits(design, tasks, [t.rows for t in tasks], columns).where("y IS NOT NULL")
    forests = _started(rows, tasks)
    total = sum(f.rows for f in forests)
    if max(f.rows for f in forests) <= ROWS_A_PARTITION:
        parts = min(len(tasks), 4096)
        alone = rows.repartitionById(parts, F.col("fit") % parts)
        _grow_alone(alone if parts == len(tasks) else alone.sortWithinPartitions("fit"), columns, forests, settings)
        return forests
    slots = tasks_at_once(design.sparkSession)
    side_by_side = total <= slots * HELD_ROWS
    if not side_by_side and slots and len(tasks) > 1:
        half = len(tasks) // 2
        return fit_many(design, tasks[:half], settings) + fit_many(design, tasks[half:], settings)
    parts = -(-total // ROWS_A_PARTITION)
    if side_by_side:
        held = _spread(rows, forests, min(-(-total // ROWS_SIDE_BY_SIDE), slots))
    else:
        held = rows.repartition(parts)
    held = held.persist(StorageLevel.MEMORY_AND_DISK)
    cuts = _fit_cuts(held, forests, columns, settings.max_bins)
    own = [[cuts.get((i, columns.index(c)), np.zeros(0)) for c in t.columns] for i, t in enumerate(tasks)]
    level = _Level(forests, [np.array([len(c) + 1 for c in edges]) for edges in own], settings)
    blocks = cut_lineage(_to_blocks(held, forests, columns, cuts))
    held.unpersist()
    if side_by_side:
        _grow_side_by_side(blocks, level, forests)
    else:
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        for t in range(settings.trees):
            if len(level.pending) == CUT_EVERY:
                written = cut_lineage(blocks.mapInArrow(level.written, BLOCKS))
                blocks.unpersist()
                blocks, level.pending = written.persist(StorageLevel.MEMORY_AND_DISK), []
            _grow_level_by_level(blocks, parts, level, forests)
        blocks.unpersist()
    for forest, edges in zip(forests, own, strict=True):
        forest.trees = [tree.with_cuts(edges) for tree in forest.trees]
    return forests


# ---- scores --------------------------------------------------------------


def predictions(design: DataFrame, forests: Sequence[Forest], conditions: Sequence[str], keep: Sequence[str] = (),
                depth: int = Settings.depth) -> DataFrame:
    """(fit, y, ``keep``, score): the rows that meet a fit's condition, scored by it, all fits in one pass."""
    ship_package(design.sparkSession)
    columns = _predictors([f.task for f in forests])
    positions = [[columns.index(c) for c in f.task.columns] for f in forests]
    rows = _rows_of_fits(design, [f.task for f in forests], conditions, columns, keep)
    kept = ["fit", "y", *(f"kept_{i}" for i in range(len(keep)))]
    shared = design.sparkSession.sparkContext.broadcast(list(forests))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            fits, x = batch.column("fit").to_numpy(), _matrix(batch, columns)
            out = np.zeros(len(fits))
            for fit in np.unique(fits).tolist():
                mine = fits == fit
                out[mine] = models[fit].scores(x[positions[fit]][:, mine], depth)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out)], [*kept, "score"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.select(*kept).dtypes)
    return rows.mapInArrow(score, f"{schema}, score double").withColumnsRenamed(dict(zip(kept[2:], keep, strict=True)))
