"""Sufficient statistics: one pass over the rows serves every blend, ridge or correlation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.session import cut_lineage, small_methods

JVM_COLUMNS = 24
#: Rows of a batch that are centred and multiplied at once: their matrices stay in a core's cache.
SLICE_ROWS = 1024


def scalar_stats(df: DataFrame, **aggs: Column) -> Column:
    """One-row aggregate of ``df`` as a scalar subquery; read fields with ``[...]``."""
    return df.agg(F.struct(*[c.alias(n) for n, c in aggs.items()]).alias("s")).scalar()


def product_sums(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Weighted sums of products over rows in which every column is present.

    Returns one row per group: ``n``, ``w`` and an array ``g`` holding the upper triangle (row by row)
    of ``Z'WZ`` with ``Z = [1, cols...]``. Few columns stay inside code generation; many columns use
    one matrix product per Arrow batch and a distributed sum of the partial triangles.
    """
    by = list(by)
    ready = df.dropna(subset=list(cols))
    z: list[Column] = [F.lit(1.0), *[F.col(c).cast("double") for c in cols]]
    if len(cols) <= JVM_COLUMNS:
        wt = F.col(weight).cast("double") if weight else F.lit(1.0)
        cells = [F.sum(wt * z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]
        agg = [F.count("*").alias("n"), F.sum(wt).alias("w"), F.array(*cells).alias("g")]
        return ready.groupBy(*by).agg(*agg) if by else ready.agg(*agg)
    return _product_sums_batched(ready, cols, by, weight)


def _product_sums_batched(df: DataFrame, cols: Sequence[str], by: list[str], weight: str | None) -> DataFrame:
    p = len(cols) + 1
    upper = np.triu_indices(p)
    lean = df.select(
        *by,
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"),
        F.array(*[F.col(c).cast("double") for c in cols]).alias("__x"),
    )
    key_schema = lean.select(*by).schema if by else None
    width = len(cols)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple, list] = {}
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            z = np.column_stack([np.ones(n), x])
            w = batch.column("__w").to_numpy(zero_copy_only=False)
            types = {k: batch.column(k).type for k in by}
            keys = list(zip(*[batch.column(k).to_pylist() for k in by])) if by else [()] * n
            codes: dict[tuple, int] = {}
            label = np.fromiter((codes.setdefault(k, len(codes)) for k in keys), dtype=np.int64, count=n)
            for key, code in codes.items():
                pick = label == code
                zk, wk = z[pick], w[pick]
                tri = ((zk * wk[:, None]).T @ zk)[upper]
                slot = acc.setdefault(key, [0, 0.0, np.zeros(len(tri))])
                slot[0] += int(pick.sum())
                slot[1] += float(wk.sum())
                slot[2] += tri
        for key, (n, w, tri) in acc.items():
            size = len(tri)
            columns = {k: pa.array([v] * size, type=types[k]) for k, v in zip(by, key)}
            columns |= {
                "idx": pa.array(np.arange(size, dtype=np.int32)),
                "val": pa.array(tri),
                "n": pa.array(np.where(np.arange(size) == 0, n, 0).astype(np.int64)),
                "w": pa.array(np.where(np.arange(size) == 0, w, 0.0)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    keys_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_schema.fields) + ", " if by else ""
    parts = lean.mapInArrow(partial, f"{keys_ddl}idx int, val double, n long, w double")
    cells = parts.groupBy(*by, "idx").agg(F.sum("val").alias("val"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    agg = [
        F.sum("n").alias("n"),
        F.sum("w").alias("w"),
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "val"))), lambda s: s["val"]).alias("g"),
    ]
    return cells.groupBy(*by).agg(*agg) if by else cells.agg(*agg)


PAIR_FIELDS = ("n", "mx", "my", "xy", "xx", "yy")


def _merged(a: Sequence, b: Sequence) -> list:
    """Counts, means and centred products of two disjoint sets of rows together: NumPy arrays or columns alike."""
    (n, mx, my, xy, xx, yy), (m, ox, oy, zxy, zxx, zyy) = a, b
    dx, dy = ox - mx, oy - my
    share = m / (n + m)
    w = n * share
    return [n + m, mx + dx * share, my + dy * share, xy + zxy + dx * dy * w, xx + zxx + dx * dx * w, yy + zyy + dy * dy * w]


def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(i, j, n, mx, my, xy, xx, yy)`` for every pair of columns i < j: count and means of the rows in which both are
    present, and their products about these means.

    Each column is evaluated once. Per Arrow batch the products of ``[x * m, x^2 * m, m]`` with the null masks ``m`` are
    taken about the batch's own means; moments of batches, then of tasks, are merged pairwise by the shift of their means,
    so no sum cancels and no pass for the means is needed. A pair's merge reads one row a task; these rows are written once.
    NaN counts as missing.
    Pairs without a common row have ``n = 0``; an empty table gives no rows.
    """
    p = len(cols)
    a, b = (v.astype(np.int32) for v in np.triu_indices(p, 1))
    lean = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("__x"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p)
            centre = np.nan_to_num(np.nansum(x, axis=0) / np.maximum((x == x).sum(axis=0), 1))
            n, xx, xqm = np.zeros((p, p)), np.zeros((p, p)), np.zeros((2 * p, p))
            for at in range(0, len(x), SLICE_ROWS):
                part = x[at : at + SLICE_ROWS]
                known = part == part
                m, both = known.astype(float), np.empty((len(part), 2 * p))
                both[:, :p] = np.where(known, part - centre, 0.0)
                np.square(both[:, :p], out=both[:, p:])
                n += m.T @ m
                xx += both[:, :p].T @ both[:, :p]
                xqm += both.T @ m
            n, xy, xm, qm = n[a, b], xx[a, b], xqm[:p], xqm[p:]
            rows = np.maximum(n, 1)
            dx, dy = xm[a, b] / rows, xm[b, a] / rows
            found = [n, centre[a] + dx, centre[b] + dy, xy - dx * dy * n, qm[a, b] - dx * dx * n, qm[b, a] - dy * dy * n]
            if held is None:
                held = found
                continue
            both = _merged([np.where(held[0] + n > 0, held[0], 1e-300), *held[1:]], found)
            held = [np.where(n == 0, h, np.where(held[0] == 0, f, t)) for h, f, t in zip(held, found, both)]
        if held is not None and len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *map(pa.array, held)], names=["i", "j", *PAIR_FIELDS])

    fields = ", ".join(f"{f} double" for f in PAIR_FIELDS)
    with small_methods(df.sparkSession):
        parts = cut_lineage(lean.mapInArrow(partial, f"i int, j int, {fields}"))
    none = F.struct(*[F.lit(0.0).alias(f) for f in PAIR_FIELDS])

    def merge(held: Column, found: Column) -> Column:
        both = _merged([held[f] for f in PAIR_FIELDS], [found[f] for f in PAIR_FIELDS])
        return F.when(found["n"] == 0, held).when(held["n"] == 0, found).otherwise(F.struct(*[v.alias(f) for v, f in zip(both, PAIR_FIELDS)]))

    lists = parts.groupBy("i", "j").agg(F.collect_list(F.struct(*PAIR_FIELDS)).alias("parts"))
    return lists.select("i", "j", F.aggregate("parts", none, merge).alias("s")).select("i", "j", "s.*")


def pair_correlation() -> Column:
    """Correlation from the columns of :func:`pair_moments`; null where either column is constant on the common rows."""

    def varies(v: str, mean: str) -> Column:
        return F.col(v) > 1e-24 * F.col("n") * F.col(mean) * F.col(mean)

    return F.when((F.col("n") > 0) & varies("xx", "mx") & varies("yy", "my"), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))


def unpack(g: Sequence[float], p: int) -> np.ndarray:
    """Symmetric matrix from an upper triangle stored row by row."""
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = np.asarray(g, dtype=float)
    return out + np.triu(out, 1).T


def collect_moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> dict:
    """Small matrices on the driver: ``{group key: (n, Z'WZ)}``; groups must be few (folds, segments)."""
    rows = product_sums(df, cols, by, weight).collect()
    return {tuple(r[k] for k in by): (r["n"], unpack(r["g"], len(cols) + 1)) for r in rows}


def centred(m: np.ndarray) -> np.ndarray:
    """Centred cross products of the non-constant columns of ``Z'Z``."""
    return m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / m[0, 0]


def shift_to_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Subtract column means first, so that later sums of products do not cancel."""
    means = df.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in cols]).first()
    return df.withColumns({c: F.col(c).cast("double") - F.lit(float(means[c] or 0.0)) for c in cols})
