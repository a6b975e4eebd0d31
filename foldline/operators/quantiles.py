"""Exact quantiles of many columns and row sets at once, by radix selection.

A double is mapped to a 64-bit key of the same order. Every scan of the table counts, for all targets together, how many
rows continue a target's known digits with each next digit; eight scans fix all 64 bits. Nothing is sorted or shuffled but
counts, and the number of jobs depends neither on the columns nor on the sets nor on the probabilities.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT = 8
SCANS = 64 // DIGIT
#: Targets that share their scans: a task counts ``2**DIGIT`` cells for each.
MOST_TARGETS = 1 << 16
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SIGN = np.uint64(1 << 63)


def sort_keys(x: np.ndarray) -> np.ndarray:
    """Unsigned keys in the order of the doubles; both zeros are one value and not-a-number is the largest."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    bits = x.view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def from_keys(keys: np.ndarray) -> np.ndarray:
    keys = np.asarray(keys, np.uint64)
    return np.where(keys & _SIGN, keys ^ _SIGN, ~keys).view(np.float64)


def _mixed(unit: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    h = (prefix ^ (unit.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * _SPREAD
    return h ^ (h >> np.uint64(29))


def _digit_counts(df: DataFrame, cols: Sequence[str], unit: str, pairs: dict[int, tuple[np.ndarray, np.ndarray]], scan: int) -> dict[int, np.ndarray]:
    """Per column a table (pair, digit) of counts; a pair is a unit and the digits known so far."""
    tables = {}
    for c, (units, prefixes) in pairs.items():
        h = _mixed(units, prefixes)
        order = np.argsort(h, kind="stable")
        # more than one place a hash only where hashes of pairs collide
        tables[c] = h[order], units[order], prefixes[order], order, np.unique(prefixes), int(np.unique(h, return_counts=True)[1].max())
    left = np.uint64(64 - DIGIT * (scan + 1))
    wanted = sorted(pairs)

    def run(batches):
        counts = {c: np.zeros(len(tables[c][0]) << DIGIT, np.int64) for c in wanted}
        for batch in batches:
            units = pc.fill_null(batch.column(0), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, c in enumerate(wanted):
                hs, us, ps, _, known, most = tables[c]
                x = batch.column(1 + i)
                k = sort_keys(x.drop_null().to_numpy(zero_copy_only=False)) >> left
                u = units if x.null_count == 0 else units[x.is_valid().to_numpy(zero_copy_only=False)]
                if scan:
                    prefix = k >> np.uint64(DIGIT)
                    go = known[np.minimum(np.searchsorted(known, prefix), len(known) - 1)] == prefix
                    k, u, prefix = k[go], u[go], prefix[go]
                else:
                    prefix = np.zeros(len(k), np.uint64)
                digit = (k & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
                h = _mixed(u, prefix)
                first = np.searchsorted(hs, h)
                for step in range(most):
                    at = np.minimum(first + step, len(hs) - 1)
                    hit = (hs[at] == h) & (us[at] == u) & (ps[at] == prefix) & (first + step < len(hs))
                    counts[c] += np.bincount((at[hit] << DIGIT) + digit[hit], minlength=len(counts[c]))
        for c in wanted:
            cell = np.flatnonzero(counts[c])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), c, np.int32)), pa.array(cell), pa.array(counts[c][cell])], names=["c", "cell", "n"])

    slim = df.select(F.col(unit).cast("int").alias("u"), *[F.col(cols[c]).cast("double").alias(f"x{c}") for c in wanted])
    found = slim.mapInArrow(run, "c int, cell long, n long").groupBy("c", "cell").agg(F.sum("n").alias("n")).toArrow()
    out = {c: np.zeros((len(pairs[c][0]), 1 << DIGIT), np.int64) for c in wanted}
    column, cell, n = (found.column(i).to_numpy() for i in range(3))
    for c in wanted:
        mine = column == c
        flat = np.zeros(out[c].size, np.int64)
        flat[cell[mine]] = n[mine]
        out[c][tables[c][3]] = flat.reshape(out[c].shape)
    return out


class _Targets:
    """Ranks to find in (column, set of units): what is known of their keys and how many rows lie below it."""

    def __init__(self, column, members, prefix, rank):
        self.column, self.members, self.prefix, self.rank = column, members, prefix, rank

    def pairs(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        found: dict[int, set] = {}
        for c, m, p in zip(self.column, self.members, self.prefix):
            found.setdefault(c, set()).update((u, int(p)) for u in m)
        out = {}
        for c, ps in found.items():
            ps = sorted(ps)
            out[c] = np.array([u for u, _ in ps], np.int64), np.array([p for _, p in ps], np.uint64)
        return out

    def counts_of(self, pairs, counts) -> np.ndarray:
        """(target, digit) counts over the units of each target's set."""
        at = {c: {(int(u), int(p)): i for i, (u, p) in enumerate(zip(*pairs[c]))} for c in pairs}
        return np.stack([sum(counts[c][at[c][u, int(p)]] for u in m) for c, m, p in zip(self.column, self.members, self.prefix)])


def radix_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], unit: str | None = None, sets: Sequence[Sequence[int]] = ((0,),)) -> np.ndarray:
    """Interpolated quantiles ``[set, column, probability]``; not-a-number where a set has no value in a column.

    ``unit`` is an integer column that tells which basic part a row belongs to, each set a union of parts (all folds but
    one, a single group); rows of no set do not count. Nulls do not count, not-a-number is the largest value. Values are
    the doubles of the columns, quantiles those of the built-in exact percentile.
    """
    placed = df if unit else df.withColumn("__unit", F.lit(0))
    unit = unit or "__unit"
    out = np.full((len(sets), len(cols), len(probs)), np.nan)
    keys = [(s, c) for s in range(len(sets)) for c in range(len(cols)) if len(sets[s])]
    widest = max((len(s) for s in sets), default=1) or 1
    # at most two keys for each probability, each in every unit of its set
    step = max(1, MOST_TARGETS // (2 * max(1, len(probs)) * widest))
    for at in range(0, len(keys), step):
        _select(placed, cols, probs, unit, sets, keys[at : at + step], out)
    return out


def _select(df, cols, probs, unit, sets, keys, out) -> None:
    first = _Targets([c for _, c in keys], [tuple(sets[s]) for s, _ in keys], np.zeros(len(keys), np.uint64), None)
    pairs = first.pairs()
    by_key = first.counts_of(pairs, _digit_counts(df, cols, unit, pairs, 0))
    total = by_key.sum(axis=1)
    column, members, which, rank, place = [], [], [], [], []
    for i, (s, c) in enumerate(keys):
        if total[i]:
            for j, p in enumerate(probs):
                h = float(p) * (total[i] - 1)
                for r in (int(np.floor(h)), int(np.ceil(h))):
                    column.append(c), members.append(tuple(sets[s])), which.append(i), rank.append(r)
                place.append((s, c, j, h))
    if not rank:
        return
    t = _Targets(column, members, np.zeros(len(rank), np.uint64), np.array(rank, np.int64))
    _descend(t, by_key[which])
    for scan in range(1, SCANS):
        pairs = t.pairs()
        _descend(t, t.counts_of(pairs, _digit_counts(df, cols, unit, pairs, scan)))
    low, high = from_keys(t.prefix[::2]), from_keys(t.prefix[1::2])
    for (s, c, j, h), lo, hi in zip(place, low, high):
        out[s, c, j] = lo if lo == hi or np.isnan(lo) else (np.ceil(h) - h) * lo + (h - np.floor(h)) * hi


def _descend(t: _Targets, counts: np.ndarray) -> None:
    """Fix the next digit of every target: the first whose running count passes the rank."""
    below = np.cumsum(counts, axis=1)
    digit = (below <= t.rank[:, None]).sum(axis=1)
    t.rank = t.rank - np.where(digit > 0, np.take_along_axis(below, np.maximum(digit - 1, 0)[:, None], 1)[:, 0], 0)
    t.prefix = (t.prefix << np.uint64(DIGIT)) | digit.astype(np.uint64)


def set_of(value: Column, values: Sequence) -> Column:
    """Place of ``value`` in ``values``, for the unit column of few parts; null elsewhere."""
    out = F.lit(None).cast("int")
    for i, v in enumerate(values):
        out = F.when(value.eqNullSafe(F.lit(v)), F.lit(i)).otherwise(out)
    return out


def training_quantiles(df: DataFrame, cols: Sequence[str], fold: str, probs: Sequence[float]) -> DataFrame:
    """Long ``(fold, column, q)``: per fold the quantiles of each column over the rows of all other folds.

    Rows without a fold train every fold. A column without values there has no quantiles (null).
    """
    found = [r[0] for r in df.select(fold).distinct().sort(fold).collect()]
    folds = [f for f in found if f is not None]
    q = radix_quantiles(df.withColumn("__unit", set_of(F.col(fold), found)), cols, probs, "__unit", [[i for i, g in enumerate(found) if g != f] for f in folds])
    known = [[[None if np.isnan(v) else float(v) for v in q[i, j]] for j in range(len(cols))] for i in range(len(folds))]
    rows = [(f, c, known[i][j] if known[i][j][:1] != [None] else None) for i, f in enumerate(folds) for j, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, f"`{fold}` {df.schema[fold].dataType.simpleString()}, column string, q array<double>")
