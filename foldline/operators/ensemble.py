"""Ensembles: blends, weight search on sufficient statistics, stacking and candidate selection.

Rows are aggregated once (per fold or segment); every weight vector is then scored on small matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.operators.metrics import EPS, TAIL_COMPOSITE, banded, get_metric, segment_bounds
from foldline.operators.moments import centred, collect_moments, shift_to_means
from foldline.operators.ranks import ecdf_map, exact_quantiles, rank_gauss, zscore

FEASIBLE = 1e-10


def weighted_sum(weights: dict[str, float]) -> Column:
    """Linear blend of wide prediction columns."""
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.lit(float(w)) * F.col(name)
    return out


def normalised(weights: dict[str, float]) -> dict[str, float]:
    """Weights summing to one; an all-zero set becomes equal weights."""
    total = sum(weights.values())
    return {k: (v / total if total else 1.0 / len(weights)) for k, v in weights.items()}


def blend(oof: DataFrame, id: str, version: str, pred: str, weights: dict[str, float]) -> DataFrame:
    """Weighted average over a long prediction table."""
    w = F.create_map(*[F.lit(x) for kv in normalised(weights).items() for x in kv])
    used = oof.filter(F.col(version).isin(*weights))
    return used.groupBy(id).agg(F.sum(F.element_at(w, F.col(version)) * F.col(pred)).alias(pred))


# ---------------------------------------------------------------- statistics


@dataclass(frozen=True)
class BlendStats:
    """Small matrices that score any blend: centred products, and residual products of ``y - stream``."""

    streams: tuple[str, ...]
    n: int
    cov: np.ndarray
    with_y: np.ndarray
    yy: float
    residual: np.ndarray

    def pearson(self, w: np.ndarray) -> np.ndarray:
        w = np.atleast_2d(np.asarray(w, dtype=float))
        var = np.einsum("ij,jk,ik->i", w, self.cov, w)
        den = np.sqrt(np.maximum(var, 0.0) * self.yy)
        return np.divide(w @ self.with_y, den, out=np.full(len(w), -1.0), where=den > 0)

    def rmse(self, w: np.ndarray) -> np.ndarray:
        """For weights that sum to one."""
        w = np.atleast_2d(np.asarray(w, dtype=float))
        return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", w, self.residual, w), 0.0) / self.n)


def blend_stats(oof: DataFrame, y: str, streams: Sequence[str], by: Sequence[str] = ()) -> dict[tuple, BlendStats]:
    """Statistics per group over rows in which all streams are present, in one pass."""
    streams = tuple(streams)
    rows = oof.dropna(subset=[y, *streams])
    means = rows.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in [y, *streams]]).first()
    shift = {c: float(means[c] or 0.0) for c in [y, *streams]}
    lean = rows.select(*by, *[(F.col(c).cast("double") - shift[c]).alias(c) for c in [y, *streams]])
    out = {}
    offset = np.array([shift[y] - shift[s] for s in streams])
    for key, (n, m) in collect_moments(lean, [y, *streams], by).items():
        out[key] = _from_moments(streams, n, m, offset)
    return out


def _from_moments(streams: tuple[str, ...], n: int, m: np.ndarray, offset: np.ndarray) -> BlendStats:
    c = centred(m)
    # residual r_i = (y - s_i) = shifted residual + offset_i
    sums = m[0, 1] - m[0, 2:]
    raw = m[1, 1] - m[1, 2:][:, None] - m[1, 2:][None, :] + m[2:, 2:]
    residual = raw + np.outer(sums, offset) + np.outer(offset, sums) + m[0, 0] * np.outer(offset, offset)
    return BlendStats(streams, n, c[1:, 1:], c[0, 1:], float(c[0, 0]), residual)


# ---------------------------------------------------------------- weight search


def compositions(total: int, parts: int) -> np.ndarray:
    """All ways to split ``total`` into ``parts`` ordered non-negative integers."""
    if parts == 1:
        return np.array([[total]])
    blocks = []
    for first in range(total + 1):
        rest = compositions(total - first, parts - 1)
        blocks.append(np.column_stack([np.full(len(rest), first), rest]))
    return np.vstack(blocks)


def simplex_grid(stats: BlendStats, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Every grid weight vector with its Pearson correlation."""
    w = compositions(step, len(stats.streams)) / step
    return w, stats.pearson(w)


def nnls_from_gram(g: np.ndarray, c: np.ndarray, tol: float = 1e-12, rounds: int = 1000) -> np.ndarray:
    """Minimise ``w'Gw - 2c'w`` over non-negative ``w`` (active sets)."""
    k = len(c)
    w = np.zeros(k)
    free = np.zeros(k, dtype=bool)
    scale = max(1.0, float(np.abs(c).max(initial=0.0)))
    for _ in range(rounds):
        grad = c - g @ w
        grad[free] = -np.inf
        j = int(np.argmax(grad))
        if grad[j] <= tol * scale:
            break
        free[j] = True
        while True:
            idx = np.flatnonzero(free)
            s = np.zeros(k)
            s[idx] = np.linalg.lstsq(g[np.ix_(idx, idx)], c[idx], rcond=None)[0]
            if np.all(s[idx] > 0):
                w = s
                break
            bad = idx[s[idx] <= 0]
            gap = w[bad] - s[bad]
            step = float(np.min(np.where(gap > 0, w[bad] / np.where(gap > 0, gap, 1), 0.0)))
            w = w + step * (s - w)
            free &= w > tol
            w[~free] = 0.0
            if not free.any():
                break
    return w


def max_pearson_weights(stats: BlendStats) -> tuple[np.ndarray, float]:
    """Weights on the simplex with the highest correlation.

    Correlation ignores scale, so the optimum over the non-negative cone is a convex least-squares
    problem; if every stream correlates negatively, the least bad vertex or equal weights remain.
    """
    k = len(stats.streams)
    candidates = [np.full(k, 1.0 / k), *np.eye(k)]
    w = nnls_from_gram(stats.cov, stats.with_y)
    if w.sum() > 0:
        candidates.insert(0, w / w.sum())
    scores = stats.pearson(np.array(candidates))
    best = int(np.argmax(scores))
    return candidates[best], float(scores[best])


def nelder_mead(fn, start: np.ndarray, rounds: int = 2000, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """Derivative-free minimum by reflecting, stretching and shrinking a simplex of points."""
    k = len(start)
    pts = [np.asarray(start, dtype=float)]
    for i in range(k):
        p = pts[0].copy()
        p[i] = p[i] * 1.05 if p[i] else 0.00025
        pts.append(p)
    val = [fn(p) for p in pts]
    for _ in range(rounds):
        order = np.argsort(val, kind="stable")
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) < tol and max(np.abs(pts[-1] - pts[0])) < tol:
            break
        mid = np.mean(pts[:-1], axis=0)
        far = pts[-1]
        reach = lambda t: mid + t * (mid - far)
        r = reach(1.0)
        fr = fn(r)
        if fr < val[0]:
            e = reach(2.0)
            fe = fn(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            c = reach(0.5) if fr < val[-1] else reach(-0.5)
            fc = fn(c)
            if fc < min(fr, val[-1]):
                pts[-1], val[-1] = c, fc
            else:
                pts = [pts[0], *[pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]]
                val = [val[0], *[fn(p) for p in pts[1:]]]
    best = int(np.argmin(val))
    return pts[best], float(val[best])


#: Losses that are means of a row's error, as functions of the target (rows, 1) and the blends (rows, candidates).
ROW_LOSSES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "mae": lambda y, p: np.abs(y - p),
    "mse": lambda y, p: (y - p) ** 2,
    "log_loss": lambda y, p: -(y * np.log(np.clip(p, EPS, 1 - EPS)) + (1 - y) * np.log1p(-np.clip(p, EPS, 1 - EPS))),
}


def weight_losses(oof: DataFrame, y: str, streams: Sequence[str], weights: np.ndarray, losses: Sequence[str] = ("mae", "mse", "log_loss")) -> np.ndarray:
    """Mean losses ``[candidate, loss]`` of many weight vectors from one scan: a matrix product per batch, sums per task.

    Rows in which the target or any stream is missing do not count; without any row the losses are not-a-number.
    """
    weights = np.atleast_2d(np.asarray(weights, float))
    lean = oof.select(F.array(*[F.col(f"`{c}`").cast("double") for c in (y, *streams)]).alias("x"))
    fns = [ROW_LOSSES[n] for n in losses]

    def run(batches):
        sums, n = np.zeros((len(fns), len(weights))), 0
        for batch in batches:
            whole = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            step = max(1, (1 << 20) // len(weights))
            for at in range(0, len(whole), step):  # the products of a slice fit a few megabytes, whatever the candidates
                x = whole[at : at + step]
                x = x[~np.isnan(x).any(axis=1)]
                blends = x[:, 1:] @ weights.T
                sums += np.stack([f(x[:, :1], blends).sum(axis=0) for f in fns])
                n += len(x)
        i, j = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(j.ravel()), pa.array(i.ravel()), pa.array(sums.ravel()), pa.array(np.full(sums.size, n))], names=["c", "l", "v", "n"])

    found = lean.mapInArrow(run, "c long, l long, v double, n long").groupBy("c", "l").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    out = np.full((len(weights), len(fns)), np.nan)
    for r in found:
        if r["n"]:
            out[r["c"], r["l"]] = r["v"] / r["n"]
    return out


def optimize_weights(oof: DataFrame, y: str, streams: Sequence[str], metric: str = "rmse", rounds: int = 40) -> tuple[dict[str, float], float]:
    """Weights (absolute, normalised) that optimise a metric.

    RMSE, MSE and Pearson run on one aggregation. Other metrics use a pattern search that scores all neighbours of the
    current point in a single pass over the rows per round: mean losses by :func:`weight_losses` at every step length.
    """
    streams = list(streams)
    k = len(streams)
    norm = lambda v: np.abs(v) / max(np.abs(v).sum(), 1e-300)
    _, direction = get_metric(metric)
    if metric in ("rmse", "mse", "pearson", "weighted_pearson"):
        stats = blend_stats(oof, y, streams)[()]
        if metric in ("rmse", "mse"):
            fn = lambda v: float(stats.rmse(norm(v))[0])
        else:
            fn = lambda v: -float(stats.pearson(norm(v))[0])
        starts = [np.full(k, 1.0 / k), *(np.eye(k) * 0.9 + 0.1 / k)]
        found = [nelder_mead(fn, s) for s in starts]
        v, f = min(found, key=lambda t: t[1])
        score = -f if direction == "maximize" else (f * f if metric == "mse" else f)
        return dict(zip(streams, norm(v))), score
    sign = 1.0 if direction == "minimize" else -1.0

    def scores(points: list[np.ndarray]) -> list[float]:
        loss = {"logloss": "log_loss"}.get(metric, metric)
        if loss in ROW_LOSSES:
            return weight_losses(oof, y, streams, np.array(points), [loss])[:, 0].tolist()
        wide = oof.select(y, *[weighted_sum(dict(zip(streams, p))).alias(f"b{i}") for i, p in enumerate(points)])
        fn = get_metric(metric)[0]
        long = wide.unpivot([y], [f"b{i}" for i in range(len(points))], "cand", "p")
        got = {r["cand"]: r["value"] for r in fn(long, y, "p", ["cand"]).collect()}
        return [sign * float(got[f"b{i}"]) for i in range(len(points))]

    best = np.full(k, 1.0 / k)
    best_score = scores([best])[0]
    if {"logloss": "log_loss"}.get(metric, metric) in ROW_LOSSES:
        # a scan scores any number of candidates: every step length of every direction at once, until none is better
        steps = 0.25 / 2.0 ** np.arange(9)
        for _ in range(rounds):
            moves = [norm(np.maximum(best + s * step * e, 0)) for step in steps for e in np.eye(k) for s in (1, -1) if (best + s * step * e).max() > 0]
            vals = scores(moves)
            i = int(np.argmin(vals))
            if not vals[i] < best_score - 1e-12:
                break
            best, best_score = moves[i], vals[i]
        return dict(zip(streams, best)), sign * best_score
    step = 0.25
    for _ in range(rounds):
        moves = [norm(best + s * step * e) for e in np.eye(k) for s in (1, -1) if (best + s * step * e).max() > 0]
        moves = [norm(np.maximum(m, 0)) for m in moves]
        vals = scores(moves)
        i = int(np.argmin(vals))
        if vals[i] < best_score - 1e-12:
            best, best_score = moves[i], vals[i]
        else:
            step /= 2
            if step < 1e-3:
                break
    return dict(zip(streams, best)), sign * best_score


def segment_stats(oof: DataFrame, order: Sequence[str], y: str, streams: Sequence[str], segments: Sequence[str]) -> dict[str, BlendStats]:
    """Blend statistics of overlapping time segments from one pass over disjoint bands."""
    streams = tuple(streams)
    lean = shift_to_means(oof.select(*order, y, *streams), [y, *streams])
    rows, members = banded(lean, order, segment_bounds(lean.count(), segments))
    per_band = {k[0]: v for k, v in collect_moments(rows, [y, *streams], ["band"]).items()}
    out = {}
    for name, bands in members.items():
        have = [per_band[b] for b in bands if b in per_band]
        n, m = sum(h[0] for h in have), sum(h[1] for h in have)
        out[name] = _from_moments(streams, n, m, np.zeros(len(streams)))
    return out


def composite_scores(stats: dict[str, BlendStats], w: np.ndarray, weights: dict[str, float] = TAIL_COMPOSITE) -> np.ndarray:
    return sum(share * stats[name].pearson(w) for name, share in weights.items())


def random_weight_search(
    stats: dict[str, BlendStats], base: np.ndarray, samples: int = 1000, seed: int = 42, top: int = 50, box: float = 0.08
) -> list[dict]:
    """Weights drawn around a base vector, kept inside a box, scored on all segments at once.

    Draws come from Dirichlet laws of three concentrations and from clipped Gaussian steps; the best
    ``top`` over all draws are returned.
    """
    rng = np.random.default_rng(seed)
    base = np.asarray(base, dtype=float)
    draws = [base[None, :]]
    draws += [rng.dirichlet((base + 0.002) * s, size=samples) for s in (360, 220, 140)]
    noisy = np.clip(base + rng.normal(0, 0.018, size=(samples, len(base))), 0, 0.65)
    draws.append(noisy / noisy.sum(axis=1, keepdims=True))
    w = np.vstack(draws)
    lo, hi = np.maximum(base - box, 0), np.minimum(base + box, 0.70)
    w = w[np.all((w >= lo) & (w <= hi), axis=1)]
    if not len(w):
        raise ValueError("no weights inside the box")
    total = composite_scores(stats, w)
    best = np.argsort(-total, kind="stable")[:top]
    per = {name: s.pearson(w[best]) for name, s in stats.items()}
    return [
        {"weights": w[i], "composite": float(total[i]), **{name: float(v[r]) for name, v in per.items()}}
        for r, i in enumerate(best)
    ]


# ---------------------------------------------------------------- transforms and simple blends


def transform_preds(ref: DataFrame, df: DataFrame, col: str, kind: str, rank_self: bool = False) -> DataFrame:
    """``raw``, ``zscore``, ``ranknorm`` or ``clip001`` of a prediction column under its OOF distribution."""
    if kind == "raw":
        return df
    if kind == "zscore":
        return zscore(df, col, ref, out=col)
    if kind == "ranknorm":
        return rank_gauss(df, col, out=col) if rank_self else ecdf_map(ref, df, col, out=col)
    if kind == "clip001":
        q = exact_quantiles(ref, col, [0.001, 0.999]).scalar()
        v = F.col(col).cast("double")
        return df.withColumn(col, F.when(v.isNotNull(), F.least(F.greatest(v, q[0]), q[1])))
    raise ValueError("transform must be raw, zscore, ranknorm or clip001")


def blend_curve(oof: DataFrame, y: str, a: str, b: str, points: int = 41) -> DataFrame:
    """Exact RMSE of ``(1-w) a + w b`` along a weight grid from three sums."""
    d = F.col(b) - F.col(a)
    r = F.col(y) - F.col(a)
    sums = oof.agg(F.count("*").alias("n"), F.sum(d * d).alias("dd"), F.sum(d * r).alias("dr"), F.sum(r * r).alias("rr"))
    w = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("step")
    grid = sums.select("*", w).withColumn("weight", F.col("step") / float(points - 1))
    sse = F.col("rr") - 2 * F.col("weight") * F.col("dr") + F.col("weight") * F.col("weight") * F.col("dd")
    return grid.select("weight", F.sqrt(F.greatest(sse, F.lit(0.0)) / F.col("n")).alias("rmse"))


def fold_shrink(oof: DataFrame, y: str, a: str, b: str, fold: str) -> DataFrame:
    """Pull of ``a`` toward ``b`` per fold, fitted on the other folds: ``sum(d r) / sum(d^2)``."""
    d = F.col(b) - F.col(a)
    r = F.col(y) - F.col(a)
    per = oof.groupBy(fold).agg(F.sum(d * d).alias("dd"), F.sum(d * r).alias("dr"))
    tot = per.agg(F.struct(F.sum("dd").alias("dd"), F.sum("dr").alias("dr"))).scalar()
    return per.select(fold, F.try_divide(tot["dr"] - F.col("dr"), tot["dd"] - F.col("dd")).alias("alpha"))


def fixed_ensemble(oof: DataFrame, y: str, a: str, b: str, weight_a: float, fold: str) -> DataFrame:
    """RMSE per fold of a fixed two-stream blend and of its parts."""
    e = oof.withColumn("__blend", weight_a * F.col(a) + (1 - weight_a) * F.col(b))
    score = lambda c: F.sqrt(F.avg((F.col(y) - F.col(c)) * (F.col(y) - F.col(c))))
    return e.groupBy(fold).agg(
        F.count("*").alias("rows"), score(a).alias("rmse_a"), score(b).alias("rmse_b"), score("__blend").alias("rmse_blend")
    )


def average_blend(df: DataFrame, a: str, b: str, ref: DataFrame, y: str, lo: float = 0.01, hi: float = 0.99, out: str = "blend") -> DataFrame:
    """Mean of two predictions clipped to target quantiles."""
    q = exact_quantiles(ref, y, [lo, hi]).scalar()
    return df.withColumn(out, F.least(F.greatest((F.col(a) + F.col(b)) / 2, q[0]), q[1]))


def group_mean(oof: DataFrame, id: str, version: str, pred: str, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Mean prediction of each named group of versions."""
    member: dict[str, list[str]] = {}
    for g, versions in groups.items():
        for v in versions:
            member.setdefault(v, []).append(g)
    of = F.create_map(*[x for v, gs in member.items() for x in (F.lit(v), F.array(*[F.lit(g) for g in gs]))])
    used = oof.filter(F.col(version).isin(*member))
    return used.select(id, pred, F.explode(F.element_at(of, F.col(version))).alias("group")).groupBy(id, "group").agg(F.avg(pred).alias(pred))


def parse_groups(text: str) -> dict[str, list[str]]:
    """``name:v1+v2,other:v3`` as group members."""
    out: dict[str, list[str]] = {}
    for chunk in filter(None, (c.strip() for c in text.split(","))):
        name, sep, members = chunk.partition(":")
        versions = [v.strip() for v in members.split("+") if v.strip()]
        if not sep or not versions:
            raise ValueError(f"invalid group {chunk!r}")
        out[name.strip()] = versions
    return out


def anchor_spec(meta: DataFrame, col: str, name: str, fallback: Sequence[str]) -> DataFrame:
    """``(name, version, weight)`` of recorded anchor weights, normalised; equal fallback weights otherwise."""
    w = F.from_json(F.get_json_object(col, "$.weights"), "map<string,double>")
    models = F.from_json(F.get_json_object(col, "$.models"), "array<string>")
    pairs = F.filter(
        F.transform(models, lambda m: F.struct(F.coalesce(F.get_json_object(m, "$.version"), m).alias("version"))),
        lambda s: F.coalesce(F.try_element_at(w, s["version"]), F.lit(0.0)) > 1e-12,
    )
    kept = F.transform(pairs, lambda s: F.struct(s["version"].alias("version"), F.try_element_at(w, s["version"]).alias("weight")))
    equal = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(1.0 / len(fallback)).alias("weight")) for v in fallback])
    rows = meta.select(name, F.inline(F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(equal)))
    total = rows.groupBy(name).agg(F.sum("weight").alias("__t"))
    return rows.join(total, name).select(name, "version", (F.col("weight") / F.col("__t")).alias("weight"))


def pool_scan(stats: dict[str, BlendStats], pools: dict[str, Sequence[str]], splits: Sequence[tuple[str, str]]) -> list[dict]:
    """Non-negative weights of stream pools fitted on one segment and scored on another."""
    out = []
    for fit_on, score_on in splits:
        a, b = stats[fit_on], stats[score_on]
        for pool, names in pools.items():
            idx = [a.streams.index(n) for n in names]
            w = np.zeros(len(a.streams))
            w[idx] = nnls_from_gram(a.cov[np.ix_(idx, idx)], a.with_y[idx])
            total = w.sum()
            shares = w / total if total > 0 else w
            out.append(
                {
                    "pool": pool, "fit_on": fit_on, "score_on": score_on, "active": int((w > 0).sum()),
                    "fit_corr": float(a.pearson(shares)[0]), "eval_corr": float(b.pearson(shares)[0]),
                    "weights": {n: float(shares[a.streams.index(n)]) for n in names},
                }
            )
    return out


# ---------------------------------------------------------------- exact simplex least squares


@dataclass
class SimplexFit:
    """Weights of the best support, its squared error and the record of every support tried."""

    streams: tuple[str, ...]
    weights: np.ndarray
    sse: float
    rows: int
    support: str
    audit: list[dict] = field(default_factory=list)


@dataclass(frozen=True)
class DeltaStats:
    """Sums over rows of ``d = stream_i - stream_0`` and ``r = y - stream_0``."""

    n: int
    gram: np.ndarray
    cross: np.ndarray
    rr: float

    def __add__(self, other: DeltaStats) -> DeltaStats:
        return DeltaStats(self.n + other.n, self.gram + other.gram, self.cross + other.cross, self.rr + other.rr)

    def __sub__(self, other: DeltaStats) -> DeltaStats:
        return DeltaStats(self.n - other.n, self.gram - other.gram, self.cross - other.cross, self.rr - other.rr)

    def sse(self, w: np.ndarray) -> float:
        v = np.asarray(w)[1:]
        return float(self.rr - 2 * self.cross @ v + v @ self.gram @ v)


def delta_stats(oof: DataFrame, y: str, streams: Sequence[str], by: Sequence[str] = ()) -> dict[tuple, DeltaStats]:
    """One pass; differences to the first stream keep nearly equal streams apart numerically."""
    base = F.col(streams[0]).cast("double")
    lean = oof.select(*by, (F.col(y).cast("double") - base).alias("r"), *[(F.col(s).cast("double") - base).alias(f"d{i}") for i, s in enumerate(streams[1:])])
    cols = ["r", *[f"d{i}" for i in range(len(streams) - 1)]]
    return {k: DeltaStats(n, m[2:, 2:], m[1, 2:], float(m[1, 1])) for k, (n, m) in collect_moments(lean, cols, by).items()}


def simplex_ls(stats: DeltaStats, streams: Sequence[str]) -> SimplexFit:
    """Exact least squares over the simplex: the optimum on the affine hull of every stream subset.

    All ``2^k - 1`` supports are solved. Ties within rounding prefer more weight on the first stream,
    then less on each following one.
    """
    k = len(streams)
    # products of residuals y - stream_i, from the deltas: r - d_i with d_0 = 0
    d = np.zeros((k, k))
    d[1:, 1:] = stats.gram
    c = np.concatenate([[0.0], stats.cross])
    audit = []
    for size in range(1, k + 1):
        for s in combinations(range(k), size):
            idx = list(s)
            kkt = np.zeros((size + 1, size + 1))
            kkt[:size, :size] = d[np.ix_(idx, idx)]
            kkt[:size, size] = kkt[size, :size] = 1.0
            rhs = np.concatenate([c[idx], [1.0]])
            sol = np.linalg.lstsq(kkt, rhs, rcond=1e-13)[0]
            gap = float(np.abs(kkt @ sol - rhs).max())
            scale = max(1.0, float(np.abs(rhs).max()), float(np.abs(kkt).sum(axis=1).max()) * max(1.0, float(np.abs(sol).max())))
            w = np.zeros(k)
            w[idx] = sol[:size]
            solved = bool(np.isfinite(w).all() and gap <= 1e-9 * scale)
            feasible = bool(solved and (w >= -FEASIBLE).all() and abs(w.sum() - 1) <= 1e-9)
            if feasible:
                w = np.maximum(w, 0.0)
                w = w / w.sum()
            audit.append(
                {"support": "+".join(streams[i] for i in idx), "feasible": feasible, "weights": w, "sse": stats.sse(w) if feasible else None}
            )
    ok = [a for a in audit if a["feasible"]]
    low = min(a["sse"] for a in ok)
    slack = 64 * np.finfo(float).eps * max(1.0, abs(low), stats.rr)
    tied = [a for a in ok if a["sse"] <= low + slack]
    top = max(a["weights"][0] for a in tied)
    tied = [a for a in tied if a["weights"][0] >= top - FEASIBLE]
    for i in range(1, k):
        least = min(a["weights"][i] for a in tied)
        tied = [a for a in tied if a["weights"][i] <= least + FEASIBLE]
    pick = min(tied, key=lambda a: a["support"])
    return SimplexFit(tuple(streams), pick["weights"], float(pick["sse"]), stats.n, pick["support"], audit)


def verify_fits(oof: DataFrame, y: str, streams: Sequence[str], fits: dict, by: str | None = None, rtol: float = 1e-6) -> dict:
    """Direct squared errors of fitted weights in one more pass; raises where the formula disagrees.

    With ``by``, the fit of group ``g`` is evaluated on all rows outside ``g``.
    """
    aggs = []
    for i, (g, fit) in enumerate(fits.items()):
        e = F.col(y) - weighted_sum(dict(zip(streams, fit.weights)))
        inside = F.lit(True) if by is None or g is None else F.col(by) != F.lit(g)
        aggs.append(F.sum(F.when(inside, e * e)).alias(f"s{i}"))
    row = oof.agg(*aggs).first()
    out = {}
    for i, (g, fit) in enumerate(fits.items()):
        direct = float(row[f"s{i}"])
        if abs(direct - fit.sse) > rtol * max(1.0, direct):
            raise ValueError(f"squared error of fit {g} does not match the rows: {direct} vs {fit.sse}")
        out[g] = direct
    return out


def nested_stack(
    oof: DataFrame, y: str, streams: Sequence[str], fold: str, meta: dict | None = None, out: str = "stack"
) -> tuple[DataFrame, dict, SimplexFit]:
    """Cross-fitted simplex stack.

    The weights applied to fold ``f`` come from the other folds, using the stream columns listed for
    ``f`` in ``meta`` where given; the final fit uses every row. Statistics of all folds come from one
    aggregation per distinct column list.
    """
    streams = list(streams)
    base = {k[0]: v for k, v in delta_stats(oof, y, streams, [fold]).items()}
    total = sum(list(base.values())[1:], start=list(base.values())[0])
    fits = {}
    for f in sorted(base):
        if meta and f in meta:
            other = {k[0]: v for k, v in delta_stats(oof.filter(F.col(fold) != f), y, meta[f], [fold]).items()}
            train = sum(list(other.values())[1:], start=list(other.values())[0])
        else:
            train = total - base[f]
        fits[f] = simplex_ls(train, streams)
    blend_col = F.lit(None).cast("double")
    for f, fit in fits.items():
        blend_col = F.when(F.col(fold) == F.lit(f), weighted_sum(dict(zip(streams, fit.weights)))).otherwise(blend_col)
    return oof.withColumn(out, blend_col), fits, simplex_ls(total, streams)


# ---------------------------------------------------------------- nested candidate selection


def nested_select(summary: DataFrame, fold: str, candidate: str, sse: str, rows: str) -> DataFrame:
    """Per fold the candidate with the lowest pooled RMSE on the other folds, and its held-out RMSE.

    The row with a null fold is the final choice over all folds. Ties take the smaller name. Failed rows, which have no squared
    error, take no part.
    """
    per = summary.filter(F.col(sse).isNotNull()).groupBy(fold, candidate).agg(F.sum(sse).alias("s"), F.sum(rows).alias("n"))
    total = per.groupBy(candidate).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    held = per.join(total, candidate).select(
        fold, candidate,
        F.sqrt((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("select_rmse"),
        F.sqrt(F.col("s") / F.col("n")).alias("held_out_rmse"), F.col("n").alias("rows"),
    )
    final = total.select(
        F.lit(None).cast(per.schema[fold].dataType).alias(fold), candidate, F.sqrt(F.col("ts") / F.col("tn")).alias("select_rmse"),
        F.lit(None).cast("double").alias("held_out_rmse"), F.col("tn").alias("rows"),
    )
    both = held.unionByName(final)
    rest = [c for c in both.columns if c != fold]
    best = both.groupBy(fold).agg(F.min_by(F.struct(*rest), F.struct("select_rmse", candidate)).alias("b"))
    return best.select(fold, "b.*")


def materialize_oof(candidates: DataFrame, selection: DataFrame, fold: str, candidate: str, names: Sequence[str], out: str = "pred") -> DataFrame:
    """Each row's prediction from the candidate column chosen for its fold."""
    chosen = selection.filter(F.col(fold).isNotNull()).select(fold, F.col(candidate).alias("__c"))
    values = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    return candidates.join(chosen, fold).withColumn(out, F.element_at(values, F.col("__c"))).drop("__c")
