"""Boosted trees over binned rows: many models at once, one pass over the rows per tree level for all of them.

Rows are binned once to a byte per feature and packed in blocks. A pass sends each task's histograms (gradients, weights
and counts per model, node, feature and bin) to the driver, which picks the splits; of two siblings only the smaller one
is counted, the other is what the parent's histogram leaves. Leaf values of quantile models come from histograms of the
residuals, refined until the few values around the wanted rank can be looked at (Friedman 2001). Every SETTLED rounds the
blocks are written anew with the models' predictions, so a round costs the same however many trees there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lotwise.scale import settle

BINS = 256
# A block takes so many bytes: readers of parquet hold 4,096 values at once, whatever their size. So many rows are worked on
# at once. The driver gets the sums of so many tasks, and so many bytes, at a time; beyond that they are merged before.
BLOCK_BYTES, BLOCK_ROWS, MERGED, COLLECTED = 4 << 10, 1 << 16, 64, 64 << 20
# Cells of a residual histogram; the values around a rank are looked at once a leaf has so many there at most, or its share
# of what the driver may get.
CELLS, LOOKED_AT, ALL_LOOKED_AT = 2048, 256, 1 << 21
SETTLED = 10
LEAST_GAIN = 1e-12


@dataclass(frozen=True)
class Spec:
    """One model: `alpha` is the quantile it predicts, None the mean. `columns` are places in the row's feature array;
    rows with `fold` are left out of its training. `monotone` gives 1 (never falls) or -1 for some columns. Held rows, if
    there are any, stop it after `patience` rounds without a lower loss on them, and the trees up to the best round stay.
    """

    alpha: float | None
    columns: tuple[int, ...]
    step: float = 0.1
    rounds: int = 100
    depth: int = 4
    min_rows: int = 20
    fold: int | None = None
    monotone: Mapping[int, int] = field(default_factory=dict)
    patience: int = 50


@dataclass
class Tree:
    """A complete tree: node i has the children 2i + 1 (bin <= cut) and 2i + 2. A node that isn't split sends its rows
    to the left, so it ends in its leftmost leaf."""

    feature: list[int]
    cut: list[int]
    value: list[float]
    rows: list[float]
    gain: list[float]

    @property
    def depth(self) -> int:
        return len(self.value).bit_length() - 1


def empty_tree(depth: int) -> Tree:
    inner = (1 << depth) - 1
    return Tree([-1] * inner, [BINS - 1] * inner, [0.0] * (1 << depth), [0.0] * (2 * inner + 1), [0.0] * inner)


def nodes_at(tree: Tree, x, depth: int) -> np.ndarray:
    """Place of each row among the nodes of one level; `x` holds bins, a row per feature."""
    n, path = x.shape[1], []

    def goes(node: int) -> np.ndarray | None:
        feature = tree.feature[node]
        return x[feature] > tree.cut[node] if feature >= 0 else None

    def right(first: int, width: int, level: int) -> np.ndarray | None:
        """Whether rows go to the right, by the side they took `level` levels below the root; None: none does."""
        if width == 1:
            return goes(first)
        low, high, side = right(first, width // 2, level + 1), right(first + width // 2, width // 2, level + 1), path[level]
        if side is None or high is None and low is None:
            return low
        if low is None:
            return np.logical_and(high, side, out=high)
        if high is None:
            return np.greater(low, side, out=low)
        np.logical_xor(high, low, out=high)
        np.logical_and(high, side, out=high)
        return np.logical_xor(low, high, out=low)

    kind = np.uint8 if depth <= 8 else np.uint16
    place = np.zeros(n, kind)
    for level in range(depth):
        path.append(right((1 << level) - 1, 1 << level, 0))
        np.left_shift(place, 1, out=place)
        if path[-1] is not None:
            np.bitwise_or(place, path[-1].view(np.uint8), out=place)
    return place


def add_trees(f: np.ndarray, trees: Sequence[Tree], x) -> np.ndarray:
    """Add the values of `trees`, one after the other, to `f`."""
    at, value = np.empty(len(f), np.intp), np.empty(len(f))
    for tree in trees:
        np.copyto(at, nodes_at(tree, x, tree.depth))
        f += np.take(np.asarray(tree.value, float), at, out=value, mode="clip")
    return f


# ---------------------------------------------------------------------------------------------------------- binning

def cut_points(rows: DataFrame, features: str, n: int, fold: str | None = None, fold_of: Sequence[int | None] = ()) -> list[list[float]]:
    """For each place of the array `features`, up to 255 distinct values that part its rows evenly, all below the largest.
    Column i leaves out the rows of fold `fold_of[i]`. One aggregate of mergeable sketches."""
    levels = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])

    def sketch(i: int) -> Column:
        value = F.get(F.col(features), F.lit(i))
        if fold and i < len(fold_of) and fold_of[i] is not None:
            value = F.when(F.col(fold) != fold_of[i], value)
        return F.struct(F.percentile_approx(value, levels, 10_000).alias("cuts"), F.max(value).alias("high"))

    row = rows.agg(*[sketch(i).alias(f"c{i}") for i in range(n)]).first()
    out = []
    for i in range(n):
        c = row[f"c{i}"]
        out.append(sorted({v for v in c.cuts or [] if v < c.high}))
    return out


def binned(x: np.ndarray, cuts: Sequence[Sequence[float]]) -> np.ndarray:
    """Rows of feature values -> bins, a row per feature; bin b holds what is at most cut b and above the one before."""
    out = np.empty((len(cuts), len(x)), np.uint8)
    for i, c in enumerate(cuts):
        out[i] = np.searchsorted(np.asarray(c, float), x[:, i], side="left") if len(c) else 0
    return out


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


BLOCK = "x binary, y binary, w binary, fold binary, held binary, f binary"
KINDS = {"y": "<f8", "w": "<f8", "fold": "<i4", "held": "u1", "f": "<f8"}


def _cut(columns: Sequence[np.ndarray | None], n_models: int) -> pa.RecordBatch:
    """Arrays with a line per row, cut into blocks of few rows; what isn't there is an empty value."""
    n, width = columns[0].shape
    each = max(1, BLOCK_BYTES // (8 * n_models + width + 21))
    ends, data = np.append(np.arange(0, n, each), n), []
    for c in columns:
        values = np.empty(0, np.uint8) if c is None else np.ascontiguousarray(c)
        offsets = (ends * (values.nbytes // n)).astype("<i4")
        data.append(pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)]))
    return pa.RecordBatch.from_arrays(data, names=["x", *KINDS])


def blocks(rows: DataFrame, features: str, label: str, cuts: list[list[float]], n_models: int, *, fold: str | None = None,
           held: str | None = None, weight: str | None = None) -> DataFrame:
    """`rows` with a label, packed where they are: bins and labels, and weights, folds and held flags if there are any. The
    predictions come with the first settled round."""
    width, names = len(cuts), {"w": weight, "fold": fold, "held": held}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = binned(_lists(batch.column("x"), width), cuts)
                more = [
                    batch.column(c).to_numpy(zero_copy_only=False).astype(d) if c == "y" or names.get(c) else None for c, d in KINDS.items()]
                yield _cut([x.T, *more], n_models)

    read = rows.where(F.col(label).isNotNull()).select(
        F.col(features).alias("x"), F.col(label).cast("double").alias("y"),
        *([F.col(weight).cast("double").alias("w")] if weight else []),
        *([F.coalesce(F.col(fold).cast("int"), F.lit(-1)).alias("fold")] if fold else []),
        *([F.coalesce(F.col(held).cast("boolean"), F.lit(False)).cast("tinyint").alias("held")] if held else []))
    packed = settle(read.mapInArrow(pack, BLOCK))
    n, tasks, cores = packed.count(), n_tasks(packed), rows.sparkSession.sparkContext.defaultParallelism
    # a small table may come in fewer parts than there are cores
    return settle(packed.repartition(min(n, cores))) if tasks < min(n, cores) else packed


def n_tasks(df: DataFrame) -> int:
    return df.select(F.spark_partition_id()).distinct().count()


class _Block:
    """Some rows: bins and predictions with a line per feature and model; weights, folds, held flags and predictions are
    None if there are none."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w, fold, held, f):
        self.n, self.x, self.y, self.w, self.fold = len(y), np.ascontiguousarray(x.T), np.ascontiguousarray(y), w, fold
        self.held = None if held is None else held.astype(bool)
        self.f = None if f is None else _turned(f)
        self.parts: dict[tuple, _Part] = {}

    def _part(self, spec: Spec, held: bool) -> "_Part":
        fold = None if self.fold is None else spec.fold
        if (fold, held) not in self.parts:
            keep = [] if self.held is None else [self.held if held else ~self.held]
            if fold is not None:
                keep.append(self.fold != fold)
            self.parts[fold, held] = _Part(self, np.flatnonzero(np.logical_and.reduce(keep)) if keep else None)
        return self.parts[fold, held]

    def training(self, spec: Spec) -> "_Part":
        """The rows that train a model."""
        return self._part(spec, False)

    def watched(self, spec: Spec) -> "_Part | None":
        return None if self.held is None else self._part(spec, True)


class _Part:
    """Some rows of a block, None for all; models that learn from the same rows share it. `part[c]` are the bins of a
    column."""

    def __init__(self, block: _Block, rows: np.ndarray | None):
        self.block, self.rows, self.n = block, rows, block.n if rows is None else len(rows)
        self.y, self.w, self.shape = self.of(block.y), self.of(block.w), (len(block.x), self.n)
        self.columns: dict[int, np.ndarray] = {}
        self.bins: dict[int, np.ndarray] = {}

    def of(self, values: np.ndarray | None) -> np.ndarray | None:
        return values if values is None or self.rows is None else values[self.rows]

    def only(self, rows: np.ndarray) -> "_Part":
        return _Part(self.block, rows if self.rows is None else self.rows[rows])

    def __getitem__(self, c: int) -> np.ndarray:
        if c not in self.columns:
            self.columns[c] = self.of(self.block.x[c])
        return self.columns[c]

    def counts(self, c: int) -> np.ndarray:
        """How many rows are in each bin of a column."""
        if c not in self.bins:
            self.bins[c] = np.bincount(self[c], minlength=BINS)
        return self.bins[c]

    def predictions(self, m: int, starts: Sequence[float], fresh: Mapping[int, list[Tree]]) -> np.ndarray:
        f = np.full(self.n, starts[m]) if self.block.f is None else self.of(self.block.f[m]) + starts[m]
        return add_trees(f, fresh[m], self)


def _turned(f: np.ndarray, rows: int = 1024) -> np.ndarray:
    """`f` with lines and columns exchanged, some rows at a time, which stay in the processor's cache."""
    out = np.empty(f.shape[::-1])
    for at in range(0, len(f), rows):
        out[:, at:at + rows] = f[at:at + rows].T
    return out


def _values_of(column: pa.Array, kind: str) -> np.ndarray | None:
    """The numbers in the blocks of a batch, one after the other; None if all are empty."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, "<i8" if pa.types.is_large_binary(column.type) else "<i4")
    first, last = int(ends[column.offset]), int(ends[column.offset + len(column)])
    return np.frombuffer(data, kind, (last - first) // np.dtype(kind).itemsize, first) if last > first else None


def _each_block(batches: Iterator[pa.RecordBatch], n_models: int) -> Iterator[_Block]:
    for batch in batches:
        if not len(batch):
            continue
        x, (y, w, fold, held, f) = _values_of(batch.column("x"), "u1"), (_values_of(batch.column(c), d) for c, d in KINDS.items())
        x = x.reshape(len(y), -1) if x is not None else np.empty((len(y), 0), np.uint8)
        f = None if f is None else f.reshape(-1, n_models)
        for at in range(0, len(y), BLOCK_ROWS):
            yield _Block(*(None if c is None else c[at:at + BLOCK_ROWS] for c in (x, y, w, fold, held, f)))


# --------------------------------------------------------------------------------------------------------- training

class Trainer:
    """Trains `specs` together over the same blocks."""

    def __init__(self, rows: DataFrame, features: str, width: int, label: str, specs: Sequence[Spec], *, fold: str | None = None,
                 held: str | None = None, weight: str | None = None, fold_of: Sequence[int | None] = (), exact: bool = True,
                 settled: int = SETTLED):
        self.specs, self.exact, self.settled = list(specs), exact, settled
        self.cuts = cut_points(rows, features, width, fold, fold_of)
        self.data = blocks(rows, features, label, self.cuts, len(self.specs), fold=fold, held=held, weight=weight)
        self.tasks = n_tasks(self.data)
        self.starts = [0.0] * len(specs)
        self.trees: list[list[Tree]] = [[] for _ in specs]
        self.stored = [0] * len(specs)
        self.start_stored = False
        self.best: list[tuple[int, float | None]] = [(0, None)] * len(specs)
        self.passes = 0

    # one pass: `work(model, spec, block, predict) -> (sums, maxima)` for the models in `active`, about `numbers` in all;
    # `predict` gives the model's predictions for a part of the block
    def _pass(self, active: Sequence[int], work: Callable, numbers: int = 0) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        specs, n_models, fresh, starts = self.specs, len(self.specs), self._fresh(active), self._fresh_starts()
        self.passes += 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list[np.ndarray]] = {}
            for block in _each_block(batches, n_models):
                for m in active:
                    _add(total, m, *work(m, specs[m], block, lambda part, m=m: part.predictions(m, starts, fresh)))
            yield _packed(total)

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for i in range(len(batch)):
                    _add(total, batch.column(0)[i].as_py(), *(np.frombuffer(batch.column(c)[i].as_buffer(), "<f8") for c in (1, 2)))
            yield _packed(total)

        schema = "model int, added binary, top binary"
        parts, n = self.data.mapInArrow(run, schema), self.tasks
        while n > MERGED or n > 1 and 8 * numbers * n > COLLECTED:
            n = math.ceil(n / (MERGED if n > MERGED else 8))
            parts = parts.repartition(n).mapInArrow(join, schema)
        total: dict[int, list[np.ndarray]] = {}
        for r in parts.collect():
            _add(total, r.model, np.frombuffer(r.added, "<f8"), np.frombuffer(r.top, "<f8"))
        return {m: (a, t) for m, (a, t) in total.items()}

    def _fresh(self, active: Sequence[int]) -> dict[int, list[Tree]]:
        return {m: self.trees[m][self.stored[m]:] for m in active}

    def _fresh_starts(self) -> list[float]:
        return [0.0] * len(self.specs) if self.start_stored else self.starts

    def _settle(self) -> None:
        """Write the blocks anew with all predictions so far."""
        n_models, fresh, starts = len(self.specs), self._fresh(range(len(self.specs))), self._fresh_starts()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _each_block(batches, n_models):
                whole = _Part(block, None)
                f = np.stack([whole.predictions(m, starts, fresh) for m in range(n_models)], axis=1)
                yield _cut([block.x.T, block.y, block.w, block.fold, block.held, f], n_models)

        self.data = settle(self.data.mapInArrow(run, BLOCK))
        self.stored, self.start_stored = [len(t) for t in self.trees], True

    def fit(self) -> "Trainer":
        everyone = list(range(len(self.specs)))
        # the start is the value of a tree that is one leaf
        stats = self._pass(everyone, _root_stats)
        roots = {m: empty_tree(0) for m in stats}
        limits = {m: (-t[0], t[1]) for m, (_, t) in stats.items()}
        self._fill(roots, {m: a for m, (a, _) in stats.items()}, limits)
        self.starts = [roots[m].value[0] if m in roots else 0.0 for m in everyone]
        active = [m for m in stats if stats[m][0][2] > 0 and self.specs[m].rounds > 0]
        r = 0
        while active:
            r += 1
            grown, active = self._grow(active)
            for m in active:
                self.trees[m].append(grown[m])
            active = [m for m in active if r < self.specs[m].rounds]
            if active and r % self.settled == 0:
                self._settle()
        watched = [m for m in everyone if self.best[m][1] is not None]
        if watched:
            self._judge({m: s for m, (s, _) in self._pass(watched, _root_stats).items()})
            for m in watched:
                self.trees[m] = self.trees[m][:self.best[m][0]]
        return self

    def _judge(self, sums: Mapping[int, np.ndarray]) -> list[int]:
        """Compare the loss on the watched rows; the models that go on."""
        going = []
        for m, s in sums.items():
            if s[4] > 0:
                loss, n = s[3] / s[4], len(self.trees[m])
                if self.best[m][1] is None or loss < self.best[m][1]:
                    self.best[m] = (n, loss)
                elif n - self.best[m][0] >= self.specs[m].patience:
                    continue
            going.append(m)
        return going

    def _grow(self, active: list[int]) -> tuple[dict[int, Tree], list[int]]:
        """One tree for each active model, level by level; models that stop are left out."""
        trees = {m: empty_tree(self.specs[m].depth) for m in active}
        held: dict[int, dict[int, np.ndarray]] = {m: {} for m in active}
        limits: dict[int, tuple[float, float]] = {}
        root_sums: dict[int, np.ndarray] = {}
        for level in range(max((self.specs[m].depth for m in active), default=0)):
            wanted = {m: _wanted(trees[m], level) for m in active if level < self.specs[m].depth}
            wanted = {m: w for m, w in wanted.items() if w}
            if not wanted:
                break
            numbers = sum(3 * BINS * len(self.specs[m].columns) * len(w) for m, w in wanted.items())
            found = self._pass(list(wanted), _histograms(trees, wanted, level), numbers)
            if level == 0:
                root_sums = {m: a[:5] for m, (a, _) in found.items()}
                limits = {m: (-t[0], t[1]) for m, (_, t) in found.items()}
                active = self._judge(root_sums)
                wanted = {m: w for m, w in wanted.items() if m in active}
            for m in wanted:
                spec, sums = self.specs[m], found[m][0][5:]
                sums = _three(sums.reshape(len(wanted[m]), len(spec.columns), BINS, -1), spec)
                for slot, node in enumerate(wanted[m]):
                    held[m][node] = sums[slot]
                    if level:
                        # the sibling is what is left of the parent
                        held[m][node - 1 if node % 2 == 0 else node + 1] = held[m][(node - 1) // 2] - sums[slot]
                first = (1 << level) - 1
                for node in range(first, 2 * first + 1):
                    if node in held[m]:
                        _split(trees[m], node, held[m][node], spec)
        quantile = {m: trees[m] for m in active if self.specs[m].alpha is not None}
        self._fill(quantile, root_sums, limits)
        for m in active:
            spec = self.specs[m]
            if spec.alpha is None:
                _mean_values(trees[m], held[m], spec)
            trees[m].value = [spec.step * v for v in trees[m].value]
        return trees, active

    def _fill(self, trees: Mapping[int, Tree], sums: Mapping[int, np.ndarray], limits: Mapping[int, tuple[float, float]]) -> None:
        """Values of the leaves: quantiles of the residuals in them (means, for a model of the mean without splits)."""
        for m, tree in trees.items():
            if self.specs[m].alpha is None:
                tree.value = [float(sums[m][0] / sums[m][1]) if sums[m][1] else 0.0]
        todo = {m: t for m, t in trees.items() if self.specs[m].alpha is not None and sums[m][2] > 0}
        # per model and leaf: (from, to, first cell, last cell) of each refinement, and how many rows come before
        paths: dict[int, dict[int, list]] = {m: {leaf: [(*limits[m], 0, CELLS - 1)] for leaf in range(len(t.value))} for m, t in todo.items()}
        ranks: dict[int, dict[int, tuple[float, int]]] = {m: {} for m in todo}
        looked: dict[int, dict[int, list]] = {m: {} for m in todo}
        few = max(LOOKED_AT, ALL_LOOKED_AT // max(1, sum(map(len, paths.values()))))
        first = True
        while any(paths.values()):
            open_ = {m: p for m, p in paths.items() if p}
            found = self._pass(list(open_), _cells(todo, open_), CELLS * sum(map(len, open_.values())))
            after: dict[int, dict[int, list]] = {m: {} for m in todo}
            for m, leaves in open_.items():
                counts = found[m][0].reshape(len(leaves), CELLS)
                if first:
                    _bounded_cells(todo[m], self.specs[m], counts, limits[m], ranks[m])
                for count, (leaf, path) in zip(counts, leaves.items()):
                    n = count.sum()
                    if first:
                        todo[m].rows[len(todo[m].value) - 1 + leaf] = float(n)
                        if not n:
                            continue
                        ranks[m][leaf] = (self.specs[m].alpha * (n - 1), 0)
                    at, before = ranks[m][leaf]
                    ends = before + np.cumsum(count)
                    low, high = (int(np.searchsorted(ends, k, side="right")) for k in (math.floor(at), math.ceil(at)))
                    a, b, _, _ = path[-1]
                    inside = count[low:high + 1].sum()
                    start = int(ends[low] - count[low])
                    step = (b - a) / CELLS
                    if not self.exact or b <= a:
                        todo[m].value[leaf] = _between(at, count, ends, a, step)
                        continue
                    ranks[m][leaf] = (at, start)
                    path = [*path[:-1], (a, b, low, high)]
                    if inside <= few or step * (high - low + 1) <= abs(a) * 1e-15:
                        looked[m][leaf] = path
                    else:
                        after[m][leaf] = [*path, (a + low * step, a + (high + 1) * step, 0, CELLS - 1)]
            paths, first = after, False
        if any(looked.values()):
            open_ = {m: p for m, p in looked.items() if p}
            values = self._values(todo, open_)
            for m, leaves in open_.items():
                for leaf in leaves:
                    v, ends = values[m, leaf]
                    at, before = ranks[m][leaf]
                    low, high = (v[np.searchsorted(ends, k - before, side="right")] for k in (math.floor(at), math.ceil(at)))
                    todo[m].value[leaf] = float(low + (high - low) * (at - math.floor(at)))
        for m, tree in todo.items():
            if self.specs[m].monotone:
                _in_bounds(tree, ranks[m].get("bounds"))

    def _values(self, trees: Mapping[int, Tree], paths: Mapping[int, dict[int, list]]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """The residuals in the last cells of `paths`, few by now: distinct values, and how many rows are up to each."""
        specs, n_models, fresh, starts = self.specs, len(self.specs), self._fresh(list(paths)), self._fresh_starts()
        schema = pa.schema([("model", pa.int32()), ("leaf", pa.int32()), ("v", pa.binary()), ("n", pa.binary())])
        self.passes += 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[tuple[int, int], list[np.ndarray]] = {}
            for block in _each_block(batches, n_models):
                for m, leaves in paths.items():
                    part = block.training(specs[m])
                    place, residual = nodes_at(trees[m], part, trees[m].depth), part.y - part.predictions(m, starts, fresh)
                    for leaf, path in leaves.items():
                        r = residual[place == leaf]
                        for a, b, low, high in path:
                            cell = _cell(r, a, b)
                            r = r[(cell >= low) & (cell <= high)]
                        if len(r):
                            kept.setdefault((m, leaf), []).append(r)
            for (m, leaf), parts in kept.items():
                v, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pylist([{"model": m, "leaf": leaf, "v": v.astype("<f8").tobytes(), "n": n.astype("<i8").tobytes()}], schema)

        out: dict[tuple[int, int], list] = {}
        for r in self.data.mapInArrow(run, "model int, leaf int, v binary, n binary").collect():
            out.setdefault((r.model, r.leaf), []).append((np.frombuffer(r.v, "<f8"), np.frombuffer(r.n, "<i8")))
        merged = {}
        for k, parts in out.items():
            v, place = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
            merged[k] = v, np.cumsum(np.bincount(place, np.concatenate([n for _, n in parts]))).astype(np.int64)
        return merged


def _add(total: dict[int, list[np.ndarray]], m: int, added: np.ndarray, top: np.ndarray) -> None:
    if m in total:
        total[m] = [total[m][0] + added, np.maximum(total[m][1], top)]
    else:
        total[m] = [np.array(added, float), np.array(top, float)]


def _packed(total: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), *[pa.array([v[i].tobytes() for v in total.values()], pa.binary()) for i in (0, 1)]],
        names=["model", "added", "top"])


def _loss(spec: Spec, residual: np.ndarray) -> np.ndarray:
    if spec.alpha is None:
        return residual * residual
    return np.maximum(spec.alpha * residual, (spec.alpha - 1) * residual)


Predict = Callable[[_Part], np.ndarray]


def _root_stats(m: int, spec: Spec, block: _Block, predict: Predict) -> tuple[np.ndarray, np.ndarray]:
    """[weighted residuals, weights, rows of training, loss and rows of the watched], [-least, greatest residual]."""
    part = block.training(spec)
    return _stats(spec, block, predict, part.y - predict(part))


def _stats(spec: Spec, block: _Block, predict: Predict, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`_root_stats`, with the residuals of training."""
    part, watched = block.training(spec), block.watched(spec)
    if part.w is None:
        # only models of the mean need the sum
        total, weight = r.sum() if spec.alpha is None else 0.0, len(r)
    else:
        total, weight = (r * part.w).sum(), part.w.sum()
    loss, n = (0.0, 0) if watched is None else (_loss(spec, watched.y - predict(watched)).sum(), watched.n)
    sums = np.array([total, weight, len(r), loss, n], float)
    return sums, np.array([-r.min(), r.max()]) if len(r) else np.array([-np.inf, -np.inf])


def _wanted(tree: Tree, level: int) -> list[int]:
    """The nodes of a level to count: the smaller child of every split node above."""
    if level == 0:
        return [0]
    first = (1 << (level - 1)) - 1
    return [
        2 * i + 1 if tree.rows[2 * i + 1] <= tree.rows[2 * i + 2] else 2 * i + 2
        for i in range(first, 2 * first + 1) if tree.feature[i] >= 0]


def _histograms(trees: Mapping[int, Tree], wanted: Mapping[int, list[int]], level: int) -> Callable:
    """A pass's work: `_root_stats`, then per wanted node, column and bin what `_three` makes gradients, weights and rows
    of."""
    def work(m: int, spec: Spec, block: _Block, predict: Predict) -> tuple[np.ndarray, np.ndarray]:
        part, n, slot = block.training(spec), len(wanted[m]), None
        if level:
            slots = np.full(1 << level, -1, np.int16)
            for i, node in enumerate(wanted[m]):
                slots[node - ((1 << level) - 1)] = i
            slot = np.take(slots, nodes_at(trees[m], part, level), mode="clip")
            rows = np.flatnonzero(slot >= 0)
            part, slot = part.only(rows), slot[rows]
        residual, w, x = part.y - predict(part), part.w, [part[c] for c in spec.columns]
        stats, top = _stats(spec, block, predict, residual) if level == 0 else (np.zeros(5), np.zeros(2))
        plain = w is None and spec.alpha is not None
        if plain and level == 0:
            # gradients have two values, so two counts are enough; the rows on the side with more are what the others leave
            below = residual < 0
            fewer = 2 * np.count_nonzero(below) <= part.n
            rows = np.flatnonzero(below if fewer else ~below)
            out = []
            for c, column in zip(spec.columns, x, strict=True):
                side = np.bincount(column[rows], minlength=BINS)
                rest = part.counts(c) - side
                out.append(np.stack([rest, side] if fewer else [side, rest], axis=-1)[None])
            return np.concatenate([stats, np.stack(out, axis=1).ravel() if out else np.empty(0)]), top
        if plain:
            base, size, sums = (residual < 0) * np.int64(BINS), 2 * BINS, None
        else:
            g = residual if spec.alpha is None else np.where(residual < 0, spec.alpha - 1, spec.alpha)
            base, size, sums = np.zeros(len(residual), np.int64), BINS, (g, None) if w is None else (g * w, w, None)
        if slot is not None:
            base = base + slot * np.int64(size)
        out, at = [], np.empty(len(base), np.int64)
        for column in x:
            # widened first: adding numbers of two kinds takes longer
            np.copyto(at, column)
            at += base
            if sums is None:
                out.append(np.bincount(at, minlength=n * size).reshape(n, 2, BINS).transpose(0, 2, 1))
            else:
                out.append(np.stack([np.bincount(at, weights, minlength=n * size).reshape(n, BINS) for weights in sums], axis=-1))
        return np.concatenate([stats, np.stack(out, axis=1).ravel() if out else np.empty(0)]), top

    return work


def _three(sums: np.ndarray, spec: Spec) -> np.ndarray:
    """(gradient, weight, rows) per node, column and bin, of the sums that `_histograms` sends: these three, or without
    weights (gradient, rows) of a mean, and of a quantile the rows above and below the prediction."""
    if sums.shape[-1] == 3:
        return sums
    if spec.alpha is None:
        return sums[..., [0, 1, 1]]
    rows = sums.sum(axis=-1)
    return np.stack([spec.alpha * sums[..., 0] + (spec.alpha - 1) * sums[..., 1], rows, rows], axis=-1)


def _split(tree: Tree, node: int, sums: np.ndarray, spec: Spec) -> None:
    """Pick the best split of a node from its histograms (columns x bins x (gradient, weight, rows))."""
    total = sums[0].sum(axis=0)
    tree.rows[node] = float(total[2])
    left = np.cumsum(sums, axis=1)[:, :-1]
    right = total - left
    can = (left[..., 2] >= spec.min_rows) & (right[..., 2] >= spec.min_rows) & (left[..., 1] > 0) & (right[..., 1] > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean_left, mean_right = left[..., 0] / left[..., 1], right[..., 0] / right[..., 1]
        gain = left[..., 0] * mean_left + right[..., 0] * mean_right - total[0] * total[0] / total[1]
    for c, column in enumerate(spec.columns):
        if spec.monotone.get(column):
            can[c] &= spec.monotone[column] * (mean_right[c] - mean_left[c]) >= 0
    gain = np.where(can, gain, -np.inf)
    # equal gains but for rounding: the first column and the lowest cut
    best = gain.max(initial=-np.inf)
    if not best > LEAST_GAIN * max(1.0, float(total[1])):
        return
    c, cut = np.unravel_index(int(np.argmax(gain >= best - 1e-9 * abs(best))), gain.shape)
    tree.feature[node], tree.cut[node], tree.gain[node] = int(spec.columns[c]), int(cut), float(best)
    tree.rows[2 * node + 1], tree.rows[2 * node + 2] = float(left[c, cut, 2]), float(right[c, cut, 2])


def _ends(tree: Tree) -> dict[int, int]:
    """The node in which each reachable leaf ends -> the leaf: nodes without split go on to the left."""
    inner, out = len(tree.feature), {}

    def walk(node: int, leaf: int, width: int) -> None:
        if node >= inner or tree.feature[node] < 0:
            out[node] = leaf
            return
        walk(2 * node + 1, leaf, width // 2)
        walk(2 * node + 2, leaf + width // 2, width // 2)

    walk(0, 0, len(tree.value))
    return out


def _mean_values(tree: Tree, held: Mapping[int, np.ndarray], spec: Spec) -> None:
    """Mean gradient in every node, and from them the leaves, within the bounds that monotone splits set."""
    means = {}
    for node, sums in held.items():
        g, w, _ = sums[0].sum(axis=0)
        means[node] = g / w if w else 0.0
        if node < len(tree.feature) and tree.feature[node] >= 0:
            c = spec.columns.index(tree.feature[node])
            left = sums[c, :tree.cut[node] + 1].sum(axis=0)
            right = sums[c, tree.cut[node] + 1:].sum(axis=0)
            means[2 * node + 1], means[2 * node + 2] = left[0] / left[1], right[0] / right[1]
    for node, leaf in _ends(tree).items():
        tree.value[leaf] = float(means.get(node, 0.0))
        tree.rows[len(tree.value) - 1 + leaf] = tree.rows[node]
    _in_bounds(tree, (spec, means))


def _in_bounds(tree: Tree, known: tuple[Spec, Mapping[int, float]] | None) -> None:
    """Carry bounds down the tree: below a split of a monotone column, the values of one side stay on their side of the
    middle between the two nodes' values, so no two rows that differ only there are out of order."""
    if known is None:
        return
    spec, values = known
    ends, inner = _ends(tree), len(tree.feature)

    def walk(node: int, low: float, high: float) -> None:
        if node in ends:
            tree.value[ends[node]] = min(max(tree.value[ends[node]], low), high)
            return
        left, right = 2 * node + 1, 2 * node + 2
        sign = spec.monotone.get(tree.feature[node], 0)
        middle = min(max((values[left] + values[right]) / 2, low), high)
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[sign]
        walk(left, *bounds[0])
        walk(right, *bounds[1])

    if spec.monotone and inner:
        walk(0, -math.inf, math.inf)


def _cell(residual: np.ndarray, a: float, b: float) -> np.ndarray:
    if b <= a or not math.isfinite(CELLS / (b - a)):
        return np.zeros(len(residual), np.int64)
    place = (residual - a) * (CELLS / (b - a))
    return np.clip(place, 0, CELLS - 1, out=place).astype(np.int64)


def _cells(trees: Mapping[int, Tree], paths: Mapping[int, dict[int, list]]) -> Callable:
    """A pass's work: how many residuals of each open leaf are in each cell of its last refinement."""
    def work(m: int, spec: Spec, block: _Block, predict: Predict) -> tuple[np.ndarray, np.ndarray]:
        part = block.training(spec)
        place, residual = nodes_at(trees[m], part, trees[m].depth), part.y - predict(part)
        leaves = paths[m]
        if all(len(path) == 1 for path in leaves.values()) and len(leaves) == len(trees[m].value):
            a, b, _, _ = next(iter(leaves.values()))[0]
            return np.bincount(place * np.int64(CELLS) + _cell(residual, a, b), minlength=len(leaves) * CELLS).astype(float), np.zeros(1)
        out = []
        for leaf, path in leaves.items():
            r = residual[place == leaf]
            for a, b, low, high in path[:-1]:
                cell = _cell(r, a, b)
                r = r[(cell >= low) & (cell <= high)]
            out.append(np.bincount(_cell(r, *path[-1][:2]), minlength=CELLS).astype(float))
        return np.concatenate(out), np.zeros(1)

    return work


def _between(at: float, count: np.ndarray, ends: np.ndarray, a: float, step: float) -> float:
    """A quantile from cell counts, values spread evenly in their cell."""
    def value(k: int) -> float:
        cell = int(np.searchsorted(ends, k, side="right"))
        return a + step * (cell + (k - (ends[cell] - count[cell]) + 0.5) / count[cell])

    low, high = value(math.floor(at)), value(math.ceil(at))
    return float(low + (high - low) * (at - math.floor(at)))


def _bounded_cells(tree: Tree, spec: Spec, counts: np.ndarray, limits: tuple[float, float], ranks: dict) -> None:
    """Values of all nodes of a monotone tree, from the cells of the leaves below them."""
    if not spec.monotone:
        return
    values, n_leaves, (a, b) = {}, len(tree.value), limits
    for node in range(2 * n_leaves - 1):
        level = (node + 1).bit_length() - 1
        width = n_leaves >> level
        first = (node - ((1 << level) - 1)) * width
        count = counts[first:first + width].sum(axis=0)
        if count.sum():
            values[node] = _between(spec.alpha * (count.sum() - 1), count, np.cumsum(count), a, (b - a) / CELLS)
    ranks["bounds"] = (spec, values)


# ---------------------------------------------------------------------------------------------------------- models

@dataclass
class HistModel:
    """A fitted model over an array of features: `cuts` of every place, a start and trees (values with the step)."""

    cuts: list[list[float]]
    start: float
    trees: list[Tree]

    def first(self, rounds: int) -> "HistModel":
        """The model as it was after `rounds` rounds."""
        return replace(self, trees=self.trees[:rounds])

    def on_bins(self, x: np.ndarray) -> np.ndarray:
        return add_trees(np.full(x.shape[1], self.start), self.trees, x)

    @property
    def used(self) -> list[int]:
        return sorted({f for t in self.trees for f in t.feature if f >= 0})

    def importances(self) -> list[float]:
        """Share of each feature in the gain of all splits; they add up to 1, unused ones are 0."""
        total = [0.0] * len(self.cuts)
        for tree in self.trees:
            for f, gain in zip(tree.feature, tree.gain):
                if f >= 0:
                    total[f] += gain
        whole = sum(total)
        return [t / whole for t in total] if whole else total

    def to_json(self) -> dict:
        return {"cuts": self.cuts, "start": self.start, "trees": [[t.feature, t.cut, t.value, t.rows, t.gain] for t in self.trees]}

    @classmethod
    def from_json(cls, data: Mapping) -> "HistModel":
        return cls([list(map(float, c)) for c in data["cuts"]], float(data["start"]), [Tree(*t) for t in data["trees"]])


def train(rows: DataFrame, features: str, width: int, label: str, specs: Sequence[Spec], **how) -> list[HistModel]:
    """Train all `specs` in the same passes over `rows`; see Trainer."""
    done = Trainer(rows, features, width, label, specs, **how).fit()
    return [HistModel(done.cuts, start, trees) for start, trees in zip(done.starts, done.trees)]


def predict(features: Column, models: Sequence[HistModel]) -> Column:
    """Array of the models' predictions for an array of features, in one Arrow pass over all trees. Models with the same
    cuts are binned once."""
    models = list(models)
    width = len(models[0].cuts) if models else 0

    @F.arrow_udf("array<double>")
    def score(x: pa.Array) -> pa.Array:
        values = _lists(x, width)
        bins: dict[int, np.ndarray] = {}
        out = np.empty((len(values), len(models)))
        for i, model in enumerate(models):
            if id(model.cuts) not in bins:
                bins[id(model.cuts)] = binned(values, model.cuts)
            out[:, i] = model.on_bins(bins[id(model.cuts)])
        offsets = np.arange(0, out.size + 1, max(len(models), 1), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    return score(features)


def _weights(size: int) -> list[float]:
    """Shapley weight of a coalition of s out of `size` players, without the one in question."""
    return [math.factorial(s) * math.factorial(size - s - 1) / math.factorial(size) for s in range(size)]


def leaf_tables(tree: Tree) -> Iterator[tuple[list[tuple[int, int, bool]], list[int], np.ndarray]]:
    """For each leaf that rows reach: the conditions of its path (feature, cut, goes right), its features, and a table
    [pattern of features whose conditions a row meets, feature] of contributions, by path-dependent Shapley values
    (Lundberg et al. 2018): a feature that isn't in a coalition goes either way as the training rows did."""
    inner = len(tree.feature)

    def walk(node: int, leaf: int, width: int, path: list, shares: dict[int, float]):
        if node >= inner or tree.feature[node] < 0:
            value, features = tree.value[leaf], list(shares)
            size = len(features)
            if not size or not value:
                return
            table = np.zeros((1 << size, size))
            weight = _weights(size)
            for pattern in range(1 << size):
                meets = [pattern >> i & 1 for i in range(size)]
                for j in range(size):
                    # sum over coalitions of the others, by their size
                    sums = [1.0] + [0.0] * (size - 1)
                    for i in range(size):
                        if i != j:
                            for s in range(size - 1, -1, -1):
                                sums[s] = sums[s] * shares[features[i]] + (sums[s - 1] * meets[i] if s else 0.0)
                    table[pattern, j] = value * (meets[j] - shares[features[j]]) * sum(w * s for w, s in zip(weight, sums))
            yield path, features, table
            return
        f, n = tree.feature[node], tree.rows[node]
        for side, child in enumerate((2 * node + 1, 2 * node + 2)):
            share = tree.rows[child] / n if n else 0.0
            yield from walk(
                child, leaf + side * (width // 2), width // 2, [*path, (f, tree.cut[node], bool(side))], {**shares, f: shares.get(f, 1.0) * share})

    yield from walk(0, 0, len(tree.value), [], {})


def expected_value(model: HistModel) -> float:
    """Mean prediction over the training rows of each tree."""
    out = model.start
    for tree in model.trees:
        total = sum(tree.rows[node] for node in _ends(tree))
        out += sum(tree.rows[node] * tree.value[leaf] for node, leaf in _ends(tree).items()) / total if total else 0.0
    return out


def contributions_on_bins(model: HistModel, x: np.ndarray, tables: Sequence[list] | None = None) -> np.ndarray:
    """What each feature adds to the predictions; `tables` are the `leaf_tables` of the trees, if they are known."""
    out = np.zeros((len(model.cuts), x.shape[1]))
    for leaves in tables or map(leaf_tables, model.trees):
        for path, features, table in leaves:
            pattern = np.zeros(x.shape[1], np.int64)
            for i, feature in enumerate(features):
                meets = np.ones(x.shape[1], bool)
                for f, cut, right in path:
                    if f == feature:
                        meets &= (x[f] > cut) == right
                pattern |= meets.astype(np.int64) << i
            found = table[pattern]
            for i, feature in enumerate(features):
                out[feature] += found[:, i]
    return out


def contributions(features: Column, model: HistModel) -> Column:
    """Array of what each feature adds to the prediction; with `expected_value` they add up to it, for every row."""
    width, tables = len(model.cuts), [list(leaf_tables(tree)) for tree in model.trees]

    @F.arrow_udf("array<double>")
    def explain(x: pa.Array) -> pa.Array:
        values = _lists(x, width)
        out = contributions_on_bins(model, binned(values, model.cuts), tables).T
        offsets = np.arange(0, out.size + 1, max(width, 1), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(out).ravel()))

    return explain(features)
