"""Gradient-boosted histogram trees for all folds at once.

Columns are binned once. A level of the trees of every fold comes from one scan: each task adds up gradients per (fold, node,
column, bin), a shuffle adds the tasks, and the best split of every node is read from that table, whose size depends on the
parameters alone. Rows keep one score per fold, written anew every few rounds, so that a scan applies few trees.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldline.operators.quantiles import radix_quantiles
from foldline.session import cut_lineage, discard

#: Rounds after which the scores of the rows are written.
REFRESH = 8


@dataclass(frozen=True)
class Boosting:
    """Parameters. ``patience`` rounds without a better held-out loss end a fold; its best round counts. With patience 0 all rounds run and count."""

    rounds: int = 50
    depth: int = 5
    rate: float = 0.05
    bins: int = 64
    min_rows: int = 20
    ridge: float = 1.0
    patience: int = 10
    classify: bool = False


@dataclass
class Tree:
    """Nodes in heap order: split column (-1: leaf), last bin that goes left, and the value of a leaf."""

    column: np.ndarray
    last: np.ndarray
    value: np.ndarray

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            c = self.column[at]
            go = c >= 0
            if not go.any():
                return at
            right = bins[rows, np.maximum(c, 0)] > self.last[at]
            at = np.where(go, 2 * at + 1 + right, at)

    def __call__(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(bins)]


@dataclass
class FoldTrees:
    """Trees, start value and best number of rounds of every fold, with the bin edges that all share."""

    cols: tuple[str, ...]
    edges: list[np.ndarray]
    folds: list
    start: np.ndarray
    params: Boosting
    trees: list[list[Tree]]
    losses: list[list[float]]
    best: list[int] = field(default_factory=list)
    gains: np.ndarray | None = None
    binned: DataFrame | None = None

    def importances(self) -> dict[str, float]:
        """Share of the gain that splits on each column had, averaged over the folds."""
        total = self.gains.sum(axis=1, keepdims=True)
        return dict(zip(self.cols, map(float, (self.gains / np.where(total > 0, total, 1.0)).mean(axis=0))))

    def _scores(self, bins: np.ndarray, k: int) -> np.ndarray:
        s = self.start[k] + sum((t(bins) for t in self.trees[k][: self.best[k]]), start=np.zeros(len(bins)))
        return 1 / (1 + np.exp(-s)) if self.params.classify else s

    def oof(self, out: str = "pred") -> DataFrame:
        """The fitted rows that have a fold, each scored by the trees that did not see it."""
        lean = replace(self, binned=None)  # tasks get the trees alone
        return _apply(self.binned.filter("__fold >= 0"), lean._each, out).drop("__bins", "__fold", "__y", "__w", "__s")

    def _each(self, bins: np.ndarray, fold: np.ndarray) -> np.ndarray:
        score = np.zeros(len(bins))
        for k in range(len(self.folds)):
            mine = fold == k
            if mine.any():
                score[mine] = self._scores(bins[mine], k)
        return score

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """New rows, scored by every fold's trees and averaged, in one scan."""
        rows = _with_bins(df, self.cols, self.edges)
        lean = replace(self, binned=None)

        def mean(bins, _):
            return np.mean([lean._scores(bins, k) for k in range(len(lean.folds))], axis=0)

        return _apply(rows.withColumn("__fold", F.lit(0)), mean, out).drop("__bins", "__fold")


    def score(self, df: DataFrame, fold: str | None = None, out: str = "pred") -> DataFrame:
        """Rows of a fitted fold, scored by the trees that did not see them; all other rows as :meth:`predict` does."""
        index = F.lit(-1)
        for k, f in enumerate(self.folds if fold else ()):
            index = F.when(F.col(f"`{fold}`") == F.lit(f), F.lit(k)).otherwise(index)
        lean = replace(self, binned=None)

        def each(bins, k):
            got, rest = lean._each(bins, k), k < 0
            if rest.any():
                got[rest] = np.mean([lean._scores(bins[rest], j) for j in range(len(lean.folds))], axis=0)
            return got

        rows = _with_bins(df, self.cols, self.edges).withColumn("__fold", index)
        return _apply(rows, each, out).drop("__bins", "__fold")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _apply(df: DataFrame, score, out: str) -> DataFrame:
    """Add ``score(bins, fold)`` to rows with ``__bins`` and ``__fold``."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])  # mapInArrow takes no names with dots
    at_bins, at_fold = names.index("__bins"), names.index("__fold")

    def run(batches):
        for b in batches:
            bins = b.column(at_bins)
            got = score(_matrix(bins, len(bins.flatten()) // max(1, len(bins))), b.column(at_fold).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, "pred"])

    schema = T.StructType([*plain.schema.fields, T.StructField("pred", T.DoubleType())])
    return plain.mapInArrow(run, schema).toDF(*names, out)


def bin_edges(df: DataFrame, cols: Sequence[str], bins: int) -> list[np.ndarray]:
    """Cut points of each column: its distinct exact quantiles, at most ``bins`` - 1 of them."""
    q = radix_quantiles(df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)]), [f"x{i}" for i in range(len(cols))], [i / bins for i in range(1, bins)])
    return [np.unique(x[~np.isnan(x)]) for x in q[0]]


def _with_bins(df: DataFrame, cols: Sequence[str], edges: list[np.ndarray]) -> DataFrame:
    """Add ``__bins``: 0 for missing, else one more than the number of cut points below the value."""
    ready = df.withColumn("__bins", F.array(*[F.col(f"`{c}`").cast("double") for c in cols]))
    names, at = ready.columns, len(df.columns)
    plain = ready.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches):
        for b in batches:
            x = _matrix(b.column(at), len(cols)).astype(float)
            codes = np.stack([np.where(np.isnan(x[:, i]), 0, np.searchsorted(e, x[:, i]) + 1) for i, e in enumerate(edges)], axis=1).astype(np.int16)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(cols)), pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], lists], names=b.schema.names)

    schema = T.StructType([*plain.schema.fields[:-1], T.StructField(f"c{at}", T.ArrayType(T.ShortType()))])
    return plain.mapInArrow(run, schema).toDF(*names)


def fit_folds(df: DataFrame, y: str, cols: Sequence[str], fold: str, params: Boosting = Boosting(), chained: bool = False, weight: str | None = None) -> FoldTrees:
    """Boost every fold's trees on the rows of other folds and of none, its own rows deciding when to stop.

    ``chained`` trains a fold on earlier folds and on rows of none. Rows without y take part in nothing. Missing values have a
    bin of their own that goes left with the smallest values. ``df`` is read once and written; the scans for the edges read that.
    """
    cols = tuple(cols)
    rows = cut_lineage(df.filter(F.col(f"`{y}`").isNotNull()))
    folds = sorted(r[0] for r in rows.select(F.col(f"`{fold}`")).distinct().collect() if r[0] is not None)
    edges = bin_edges(rows, cols, params.bins)
    index = F.lit(-1)
    for k, f in enumerate(folds):
        index = F.when(F.col(f"`{fold}`") == F.lit(f), F.lit(k)).otherwise(index)
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    binned = _with_bins(rows, cols, edges).withColumns({"__fold": index, "__y": F.col(f"`{y}`").cast("double"), "__w": w})
    binned = cut_lineage(binned.withColumn("__s", F.array(*[F.lit(0.0)] * len(folds)).cast("array<double>")))
    discard(rows)
    sums = {r["__fold"]: (r["n"], r["t"]) for r in binned.groupBy("__fold").agg(F.sum("__w").alias("n"), F.sum(F.col("__w") * F.col("__y")).alias("t")).collect()}
    start = np.zeros(len(folds))
    for k in range(len(folds)):
        parts = [sums[b] for b in sums if (b < k if chained else b != k)]
        n = sum(p[0] for p in parts)
        mean = sum(p[1] for p in parts) / n if n else 0.0
        start[k] = np.log(np.clip(mean, 1e-6, 1 - 1e-6) / (1 - np.clip(mean, 1e-6, 1 - 1e-6))) if params.classify else mean
    model = FoldTrees(cols, edges, folds, start, params, [[] for _ in folds], [[] for _ in folds])
    model.gains = np.zeros((len(folds), len(cols)))
    _boost(model, binned, chained)
    model.binned = binned
    return model


def _boost(model: FoldTrees, binned: DataFrame, chained: bool) -> None:
    p, live, state, written = model.params, list(range(len(model.folds))), binned, 0
    for done in range(p.rounds + 1):
        if done - written >= REFRESH:
            fresh = _refreshed(model, state, written)
            if state is not binned:
                discard(state)
            state, written = fresh, done
        # the first level of a round also has the held-out loss of the rounds before
        grown = {k: Tree(np.full(2 ** (p.depth + 1) - 1, -1), np.zeros(2 ** (p.depth + 1) - 1, np.int64), np.zeros(2 ** (p.depth + 1) - 1)) for k in live}
        for level in range(p.depth):
            cells, losses = _level(model, state, written, grown, live, level, chained, done == p.rounds)
            if level == 0:
                for k in live:
                    model.losses[k].append(losses[k])
                live = [k for k in live if not p.patience or len(model.losses[k]) - 1 - int(np.argmin(model.losses[k])) < p.patience]
                if not live or done == p.rounds:
                    break
            if not any([_split(model, k, grown[k], cells[k], level) for k in live]):
                break
        if not live or done == p.rounds:
            break
        for k in live:
            model.trees[k].append(grown[k])
    model.best = [int(np.argmin(x)) if p.patience else len(t) for x, t in zip(model.losses, model.trees)]
    if state is not binned:
        discard(state)


def _refreshed(model: FoldTrees, state: DataFrame, written: int) -> DataFrame:
    """``state`` with the trees since the last writing in its scores."""
    trees, width, columns = [t[written:] for t in model.trees], len(model.folds), len(model.cols)

    def run(batches):
        for b in batches:
            bins, s = _matrix(b.column(0), columns), _matrix(b.column(4), width).copy()
            for k, grown in enumerate(trees):
                for t in grown:
                    s[:, k] += t(bins)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * width), pa.array(s.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], lists], names=b.schema.names)

    lean = state.select("__bins", "__fold", "__y", "__w", "__s")
    return cut_lineage(lean.mapInArrow(run, lean.schema))


def _level(model: FoldTrees, state: DataFrame, written: int, grown: dict[int, Tree], live: list[int], level: int, chained: bool, losses_only: bool):
    """Sums of gradient, curvature and rows per (fold, node, column, bin) of a level, and the held-out loss of each fold."""
    width, bins_most, first = len(model.cols), max((len(e) for e in model.edges), default=0) + 2, 2**level - 1
    nodes, k_all, classify, start = 2**level, len(model.folds), model.params.classify, model.start
    recent = {k: model.trees[k][written:] for k in live}
    partial = {k: grown[k] for k in live}
    size = nodes * width * bins_most

    def run(batches):
        acc, loss = {k: np.zeros((3, size)) for k in live}, {k: np.zeros(2) for k in live}
        for b in batches:
            bins, fold = _matrix(b.column(0), width), b.column(1).to_numpy(zero_copy_only=False)
            y, w = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            s = _matrix(b.column(4), k_all)
            for k in live:
                # levels below the first need the training rows alone
                train = fold < k if chained else fold != k
                use = slice(None) if level == 0 or train.all() else np.flatnonzero(train)
                mine, yk, wk, train = bins[use], y[use], w[use], train[use]
                score = start[k] + s[use, k] + sum((t(mine) for t in recent[k]), start=np.zeros(len(yk)))
                mean = 1 / (1 + np.exp(-score)) if classify else score
                if level == 0:
                    own = fold == k
                    q = np.clip(mean[own], 1e-12, 1 - 1e-12) if classify else mean[own]
                    each = -(y[own] * np.log(q) + (1 - y[own]) * np.log(1 - q)) if classify else (y[own] - q) ** 2
                    loss[k] += (w[own] @ each, w[own].sum())
                if losses_only:
                    continue
                node = np.where(train, partial[k].leaf(mine) - first, -1)
                here = np.flatnonzero(node >= 0)
                g = (wk * (yk - mean))[here]
                h = (wk * mean * (1 - mean) if classify else wk)[here]
                node, equal = node[here] * width, not classify and bool((h == 1.0).all())
                for c in range(width):
                    cell = (node + c) * bins_most + mine[here, c]
                    count = np.bincount(cell, minlength=size)
                    acc[k][0] += np.bincount(cell, g, size)
                    acc[k][1] += count if equal else np.bincount(cell, h, size)
                    acc[k][2] += count
        for k in live:
            at = np.flatnonzero(acc[k][2])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, k, np.int32)), pa.array(np.append(at, -1)), *[pa.array(np.append(a[at], x)) for a, x in zip(acc[k], (*loss[k], 0.0))]], names=["k", "cell", "g", "h", "n"])

    lean = state.select("__bins", "__fold", "__y", "__w", "__s")
    found = lean.mapInArrow(run, "k int, cell long, g double, h double, n double").groupBy("k", "cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
    k_of, cell, *sums = (found.column(i).to_numpy() for i in range(5))
    cells, losses = {}, {}
    for k in live:
        mine = (k_of == k) & (cell >= 0)
        table = np.zeros((3, size))
        for i in range(3):
            table[i, cell[mine]] = sums[i][mine]
        cells[k] = table.reshape(3, nodes, width, bins_most)
        end = (k_of == k) & (cell < 0)
        losses[k] = float(sums[0][end].sum() / sums[1][end].sum()) if sums[1][end].sum() else 0.0
    return cells, losses


def _split(model: FoldTrees, k: int, tree: Tree, cells: np.ndarray, level: int) -> bool:
    """Split the nodes of a level where that gains; the first column and bin win ties. Whether any was split."""
    p, any_split = model.params, False
    weight = lambda g, h: g * g / (h + p.ridge) if p.ridge else np.divide(g * g, h, out=np.zeros_like(g), where=h > 0)
    value = lambda g, h: p.rate * g / (h + p.ridge) if h + p.ridge > 0 else 0.0
    for node in range(cells.shape[1]):
        g, h, n = cells[:, node]
        total = g[0].sum(), h[0].sum(), n[0].sum()
        at = 2**level - 1 + node
        if not total[2]:
            continue
        if level == 0:
            tree.value[at] = value(total[0], total[1])
        left = [np.cumsum(a, axis=1)[:, :-1] for a in (g, h, n)]
        right = [t - a for t, a in zip(total, left)]
        gain = weight(left[0], left[1]) + weight(right[0], right[1]) - weight(np.array(total[0]), np.array(total[1]))
        gain = np.where((left[2] >= p.min_rows) & (right[2] >= p.min_rows), gain, -np.inf)
        best = int(np.argmax(gain))
        if gain.flat[best] <= 1e-12 * max(1.0, abs(float(total[0]))):
            continue
        c, last = np.unravel_index(best, gain.shape)
        tree.column[at], tree.last[at] = c, last
        model.gains[k, c] += gain[c, last]
        for child, side in ((2 * at + 1, left), (2 * at + 2, right)):
            tree.value[child] = value(side[0][c, last], side[1][c, last])
        any_split = True
    return any_split
