"""Small recurrences used inside Spark tasks; each works on one piece of a sequence with a small state."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

# Tasks receive these functions with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---------------------------------------------------------------- beam alignment


@dataclass(frozen=True)
class BeamConfig:
    name: str
    beam_size: int
    move_cost: float
    emission_scale: float
    smooth_radius: int


# The six alignment settings.
BEAM_CONFIGS = (
    BeamConfig("balanced", 10, 20.0, 144.0, 2),
    BeamConfig("loose", 10, 8.0, 64.0, 2),
    BeamConfig("conservative", 8, 35.0, 220.0, 1),
    BeamConfig("smooth", 10, 14.0, 90.0, 5),
    BeamConfig("very_loose", 20, 4.0, 36.0, 3),
    BeamConfig("middle", 12, 12.0, 100.0, 3),
)


def beam_start(place: int, count: int):
    """State of ``count`` beams that all start at one position: beam number, position and cost arrays."""
    return np.arange(count), np.full(count, place, dtype=np.int64), np.zeros(count)


def beam_forward(signals, curve, state, sizes, fees, scales, max_step: int = 2):
    """Extend several beams at once over a piece of their signals ``(rows, beams)``.

    The state lists live positions grouped by beam, cheapest first. Returns per row the beam numbers,
    positions and parents (ranks within the beam) that were kept, and the state at the end.
    """
    sizes, fees, scales = np.asarray(sizes), np.asarray(fees, dtype=float), np.asarray(scales, dtype=float)
    which, place, cost = state
    n, steps = len(curve), np.arange(-max_step, max_step + 1)
    kept = []
    for row in signals:
        rank = np.arange(len(which)) - np.searchsorted(which, which, side="left")
        nxt = (place[:, None] + steps).ravel()
        ok = (nxt >= 0) & (nxt < n)
        src = np.repeat(np.arange(len(which)), len(steps))[ok]
        nxt, beam = nxt[ok], which[src]
        gap = row[beam] - curve[nxt]
        total = cost[src] + gap * gap / scales[beam] + fees[beam] * np.abs(np.tile(steps, len(which))[ok])
        # cheapest arrival per beam and position, the earliest one on ties
        key = beam * n + nxt
        order = np.lexsort((total, key))
        starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        best, met = order[starts], np.minimum.reduceat(order, starts)
        chosen = best[np.lexsort((met, total[best], beam[best]))]
        of = beam[chosen]
        chosen = chosen[np.arange(len(of)) - np.searchsorted(of, of, side="left") < sizes[of]]
        kept.append((beam[chosen], nxt[chosen], rank[src[chosen]]))
        which, place, cost = beam[chosen], nxt[chosen], total[chosen]
    return kept, (which, place, cost)


def beam_backward(kept, beam: int, pointer: int):
    """Positions of one beam's best path over a piece, from its last row back, and the pointer before it."""
    path = np.zeros(len(kept), dtype=np.int64)
    for t in range(len(kept) - 1, -1, -1):
        which, place, parent = kept[t]
        at = int(np.searchsorted(which, beam)) + pointer
        path[t], pointer = place[at], int(parent[at])
    return path, pointer


def beam_lanes(signals, curves, places, sizes, fees, scales, max_step: int = 2):
    """Best paths ``(rows, beams)`` of several entities, row by row side by side; the same as of each alone.

    ``signals`` has one array ``(rows, beams)`` an entity, ``curves`` its curve and ``places`` the start on it.
    """
    many, order = len(sizes), np.argsort([-len(s) for s in signals], kind="stable")
    lengths = np.array([len(signals[i]) for i in order])
    base = np.cumsum(lengths) - lengths
    flat_signal, flat_curve = np.concatenate([signals[i] for i in order]), np.concatenate([curves[i] for i in order])
    sizes_of = np.array([len(curves[i]) for i in order])
    n, shift = np.repeat(sizes_of, many), np.repeat(np.cumsum(sizes_of) - sizes_of, many)
    sizes, fees, scales = (np.tile(np.asarray(v, dtype=t), len(order)) for v, t in ((sizes, np.int64), (fees, float), (scales, float)))
    which, place = np.arange(len(n)), np.repeat(np.array([places[i] for i in order], dtype=np.int64), many)
    cost, steps, widest, kept = np.zeros(len(n)), np.arange(-max_step, max_step + 1), int(n.max()), []
    away = np.abs(steps)
    for t in range(lengths[0]):
        # the longest come first, so the beams that go on are the first ones
        alive = int(np.searchsorted(-lengths, -t, side="left"))
        if which[-1] >= alive * many:
            end = np.searchsorted(which, alive * many)
            which, place, cost = which[:end], place[:end], cost[:end]
        row = flat_signal[base[:alive] + t].ravel()
        nxt = place[:, None] + steps
        ok = ((nxt >= 0) & (nxt < n[which][:, None])).ravel()
        total = cost[:, None] + np.square(row[which][:, None] - flat_curve.take(shift[which][:, None] + nxt, mode="clip")) / scales[which][:, None] + fees[which][:, None] * away
        key = (which[:, None] * widest + nxt).ravel()
        src = np.flatnonzero(ok)
        key, total = key[src], total.ravel()[src]
        sort = np.lexsort((total, key))
        starts = np.flatnonzero(np.r_[True, key[sort][1:] != key[sort][:-1]])
        best, met = sort[starts], np.minimum.reduceat(sort, starts)
        beam = which[src[best] // len(steps)]
        by = np.lexsort((met, total[best], beam))
        chosen, of = best[by], beam[by]
        first = np.searchsorted(of, np.arange(alive * many))
        chosen = chosen[np.arange(len(of)) - first[of] < sizes[of]]
        parent = src[chosen] // len(steps)
        rank = parent - np.searchsorted(which, which)[parent]
        which, place, cost = which[parent], nxt.ravel()[src[chosen]], total[chosen]
        kept.append((np.searchsorted(which, np.arange(alive * many)), place.astype(np.int32), rank.astype(np.int32)))
    paths, pointer = np.zeros((len(flat_signal), many), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
    for t in range(lengths[0] - 1, -1, -1):
        first, place, rank = kept[t]
        at = first + pointer[: len(first)]
        paths[base[: len(first) // many] + t] = place[at].reshape(-1, many)
        pointer[: len(first)] = rank[at]
    out = [None] * len(order)
    for j, i in enumerate(order):
        out[i] = paths[base[j] : base[j] + lengths[j]]
    return out


def signal_rows(slices: list, width: int) -> np.ndarray:
    """Signals, the fourth column of record batches, as one array of rows."""
    return np.concatenate([b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for b in slices])


# ---------------------------------------------------------------- particle filter


@dataclass(frozen=True)
class ParticleParams:
    """Fixed values of the motion model and of resampling."""

    particles: int = 500
    initial_spread: float = 4.5
    rate_spread: float = 0.01
    momentum: float = 0.998
    velocity_noise: float = 0.002
    position_noise: float = 0.005
    resample_position_noise: float = 0.1
    resample_velocity_noise: float = 0.001
    resample_share: float = 0.5
    margin: float = 100.0


class ParticleFilter:
    """Surface and rate particles of one entity and seed, advanced row by row."""

    def __init__(self, curve, low: float, high: float, step: float, sigma: float, surface: float, rate: float, md: float, seed: int, p: ParticleParams):
        self.curve, self.low, self.high, self.step, self.sigma, self.p = curve, low, high, step, sigma, p
        self.rng = np.random.default_rng(seed)
        n = p.particles
        self.surface = surface + p.initial_spread * self.rng.standard_normal(n)
        self.rate = rate + p.rate_spread * self.rng.standard_normal(n)
        self.weight = np.full(n, 1.0 / n)
        self.md = md
        self.log_likelihood = 0.0

    def expected(self, tvt):
        at = np.clip((tvt - self.low) / self.step, 0.0, len(self.curve) - 1.0)
        i = np.minimum(at.astype(np.int64), len(self.curve) - 2)
        f = at - i
        return self.curve[i] * (1 - f) + self.curve[i + 1] * f

    def advance(self, md: float, z: float, signal: float) -> float:
        p, rng, n = self.p, self.rng, self.p.particles
        gap = max(md - self.md, 1.0)
        self.md = md
        self.rate = p.momentum * self.rate + p.velocity_noise * rng.standard_normal(n)
        moved = self.surface + self.rate * gap + p.position_noise * rng.standard_normal(n)
        tvt = np.clip(moved - z, self.low - p.margin, self.high + p.margin)
        self.surface = tvt + z
        if np.isfinite(signal):
            off = (signal - self.expected(tvt)) / self.sigma
            like = np.maximum(np.exp(-0.5 * np.minimum(off * off, 600.0)), 1e-300)
            self.log_likelihood += float(np.log(max(float(self.weight @ like), 1e-300)))
            w = self.weight * like
            total = w.sum()
            self.weight = w / total if total > 0 else np.full(n, 1.0 / n)
            if 1.0 / float(self.weight @ self.weight) < p.resample_share * n:
                marks = rng.uniform(0.0, 1.0 / n) + np.arange(n) / n
                src = np.minimum(np.searchsorted(np.cumsum(self.weight), marks, side="left"), n - 1)
                self.surface = self.surface[src] + p.resample_position_noise * rng.standard_normal(n)
                self.rate = self.rate[src] + p.resample_velocity_noise * rng.standard_normal(n)
                self.weight = np.full(n, 1.0 / n)
        return float(self.weight @ (self.surface - z))


def particle_lanes(filters: list[ParticleFilter], moves: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Predictions and log likelihoods of several filters, each advanced over its rows ``(md, z, signal)``, row by row side by side.

    The filters draw from their own generators as :meth:`ParticleFilter.advance` does and end in the same state. All have the same parameters.
    """
    p, order = filters[0].p, np.argsort([-len(m[0]) for m in moves], kind="stable")
    lanes, n, many = [filters[i] for i in order], p.particles, len(order)
    lengths = np.array([len(moves[i][0]) for i in order])
    base = np.cumsum(lengths) - lengths
    md, z, signal = (np.concatenate([moves[i][c] for i in order]) for c in range(3))
    surface, rate, weight = (np.stack([getattr(f, a) for f in lanes]) for a in ("surface", "rate", "weight"))
    low, high, step, sigma, at_md, ll = (np.array([getattr(f, a) for f in lanes], dtype=float) for a in ("low", "high", "step", "sigma", "md", "log_likelihood"))
    sizes = np.array([len(f.curve) for f in lanes])
    curve, shift = np.concatenate([f.curve for f in lanes]), np.cumsum(sizes) - sizes
    preds, lls, noise, even = np.empty(len(md)), np.empty(len(md)), np.empty((many, 2 * n)), np.arange(n) / n
    for t in range(lengths[0]):
        a = int(np.searchsorted(-lengths, -t, side="left"))
        now = base[:a] + t
        gap = np.maximum(md[now] - at_md[:a], 1.0)
        at_md[:a] = md[now]
        for i in range(a):
            lanes[i].rng.standard_normal(out=noise[i])
        rate[:a] = p.momentum * rate[:a] + p.velocity_noise * noise[:a, :n]
        moved = surface[:a] + rate[:a] * gap[:, None] + p.position_noise * noise[:a, n:]
        tvt = np.clip(moved - z[now, None], low[:a, None] - p.margin, high[:a, None] + p.margin)
        surface[:a] = tvt + z[now, None]
        seen = np.flatnonzero(np.isfinite(signal[now]))
        if len(seen):
            place = np.clip((tvt[seen] - low[seen, None]) / step[seen, None], 0.0, (sizes[seen] - 1.0)[:, None])
            i = np.minimum(place.astype(np.int64), (sizes[seen] - 2)[:, None])
            f, i = place - i, i + shift[seen, None]
            off = (signal[now][seen, None] - (curve[i] * (1 - f) + curve[i + 1] * f)) / sigma[seen, None]
            like = np.maximum(np.exp(-0.5 * np.minimum(off * off, 600.0)), 1e-300)
            w = weight[seen]
            ll[seen] += np.log(np.maximum(np.vecdot(w, like), 1e-300))
            w = w * like
            total = w.sum(axis=1)
            w = np.where((total > 0)[:, None], w / np.where(total > 0, total, 1.0)[:, None], 1.0 / n)
            weight[seen] = w
            for j in seen[1.0 / np.vecdot(w, w) < p.resample_share * n]:
                rng = lanes[j].rng
                marks = rng.uniform(0.0, 1.0 / n) + even
                src = np.minimum(np.searchsorted(np.cumsum(weight[j]), marks, side="left"), n - 1)
                surface[j] = surface[j][src] + p.resample_position_noise * rng.standard_normal(n)
                rate[j] = rate[j][src] + p.resample_velocity_noise * rng.standard_normal(n)
                weight[j] = 1.0 / n
        preds[now], lls[now] = np.vecdot(weight[:a], surface[:a] - z[now, None]), ll[:a]
    out = [None] * many
    for j, i in enumerate(order):
        f = filters[i]
        f.surface, f.rate, f.weight, f.md, f.log_likelihood = surface[j].copy(), rate[j].copy(), weight[j].copy(), float(at_md[j]), float(ll[j])
        out[i] = preds[base[j] : base[j] + lengths[j]], lls[base[j] : base[j] + lengths[j]]
    return out


# ---------------------------------------------------------------- offset x rate lattice


@dataclass(frozen=True)
class LatticeConfig:
    name: str
    momentum: float
    rate_noise: float
    position_noise: float
    start_sigma: float
    initial_rate_sigma: float


# The two smoother settings and the lattice constants.
LATTICE_CONFIGS = (
    LatticeConfig("hmm_slow", 0.998, 0.002, 0.175, 0.75, 0.01),
    LatticeConfig("hmm_flex", 0.998, 0.004, 0.35, 0.75, 0.02),
)
BLOCK_ROWS = 21
OFFSET_STEP = 0.5
HALF_WIDTHS = (64.0, 128.0)
RATE_STATES = 33
RATE_SPAN = 0.12
STUDENT_DF = 4.0
TEMPER = 20.0
OUT_OF_SUPPORT = 12.0
EDGE_MASS = 0.01
OFFSET_EDGE_CELLS = 3
RATE_EDGE_CELLS = 2
FLOOR = -1e30
REACHED = -1e29


def lattice_grids(initial_rate: float, half_width: float):
    offsets = np.arange(-half_width, half_width + 0.5 * OFFSET_STEP, OFFSET_STEP)
    span = max(RATE_SPAN, abs(float(initial_rate)) + 0.04)
    return offsets, np.linspace(-span, span, RATE_STATES)


def block_emission(md, z, gr, anchor_md: float, anchor_u: float, offsets, rates, curve_x, curve_v, slope: float, intercept: float, scale: float):
    """Log emission of one block on the lattice; missing signal rows say nothing.

    The losses of rows are logs of factors: their product takes one logarithm a cell, not one a row.
    """
    places = anchor_u + offsets
    product, total = np.ones((len(rates), len(offsets))), np.zeros((len(rates), len(offsets)))
    # in units of the scale times the root of the degrees of freedom a loss is the log of one and a square
    unit = scale * np.sqrt(STUDENT_DF)
    curve, level = (slope * np.asarray(curve_v, dtype=float) + intercept) / unit, np.asarray(gr, dtype=float) / unit
    low, high = float(curve.min()), float(curve.max())
    at, bound = np.empty_like(product), 1.0
    for i in np.flatnonzero(np.isfinite(gr)):
        moved = rates * (md[i] - anchor_md) - z[i]
        np.add(places[None, :], moved[:, None], out=at)
        off = np.interp(at, curve_x, curve)
        off -= level[i]
        off *= off
        off += 1.0
        # only cells at either end can lie outside the curve
        first = int(np.searchsorted(places, curve_x[0] - moved.min() + 1e-6, side="right"))
        last = max(first, int(np.searchsorted(places, curve_x[-1] - moved.max() - 1e-6, side="left")))
        for cells in (slice(0, first), slice(last, len(places))):
            if cells.start == cells.stop:
                continue
            out = (at[:, cells] < curve_x[0]) | (at[:, cells] > curve_x[-1])
            off[:, cells][out] = 1.0
            total[:, cells][out] -= OUT_OF_SUPPORT
        top = 1.0 + float(max((high - level[i]) ** 2, (low - level[i]) ** 2))
        if bound * top > 1e300:
            total -= 0.5 * (STUDENT_DF + 1.0) * np.log(product)
            product[:], bound = 1.0, 1.0
        product *= off
        bound *= top
    total -= 0.5 * (STUDENT_DF + 1.0) * np.log(product)
    return (total / TEMPER).T


def _log_rate_transition(rates, gap: float, c: LatticeConfig):
    keep = c.momentum**gap
    den = 1.0 - c.momentum * c.momentum
    var = c.rate_noise**2 * ((1.0 - keep * keep) / den if den > 1e-12 else gap)
    z = (rates[None, :] - keep * rates[:, None]) / np.sqrt(max(var, 1e-12))
    t = -0.5 * z * z
    top = t.max(axis=1, keepdims=True)
    return t - top - np.log(np.exp(t - top).sum(axis=1, keepdims=True))


def _position_kernel(offsets, rates, gap: float, centre_move: float, c: LatticeConfig):
    """Central shift per rate, kernel radius and log weights ``(kernel, rate)``."""
    step = offsets[1] - offsets[0]
    travelled = rates * ((1.0 - c.momentum**gap) / (1.0 - c.momentum) if abs(1.0 - c.momentum) > 1e-12 else gap)
    mean = (travelled - centre_move) / step
    sigma = max(c.position_noise * np.sqrt(gap), 0.35 * step) / step
    radius = max(2, int(np.ceil(4.0 * sigma)))
    centre = np.floor(mean + 0.5).astype(np.int64)
    kernel = np.arange(-radius, radius + 1)[:, None]
    logw = -0.5 * ((kernel + centre[None, :] - mean[None, :]) / sigma) ** 2
    logw -= logw.max(axis=0)
    logw -= np.log(np.exp(logw).sum(axis=0))
    return centre, radius, logw


def _position_moves(offsets, rates, gap: float, centre_move: float, c: LatticeConfig):
    """Central shift per rate, kernel radius, log weights ``(kernel, rate)`` and log normalisers per source.

    A source near the grid end keeps only the moves that stay inside, so its weights are renormalised
    over a run of kernel entries, read from their cumulative sums.
    """
    centre, radius, logw = _position_kernel(offsets, rates, gap, centre_move, c)
    n, width = len(offsets), 2 * radius + 1
    cum = np.vstack([np.zeros(len(rates)), np.cumsum(np.exp(logw), axis=0)])
    at = np.arange(n)[:, None] + centre[None, :] - radius
    lo = np.clip(-at, 0, width)
    hi = np.clip(n - at, 0, width)
    cols = np.arange(len(rates))[None, :]
    mass = np.where(hi > lo, cum[hi, cols] - cum[np.minimum(lo, hi), cols], 0.0)
    norm = np.where(mass > 1e-300, np.log(np.maximum(mass, 1e-300)), FLOOR)
    return centre, radius, logw, norm


def _norm(lattice):
    top = lattice.max()
    if top <= REACHED:
        raise ValueError("lattice is unreachable")
    return top + np.log(np.exp(np.maximum(lattice - top, -745.0)).sum())


def lattice_start(offsets, rates, initial_rate: float, c: LatticeConfig):
    a = -0.5 * (offsets[:, None] / c.start_sigma) ** 2 - 0.5 * ((rates[None, :] - initial_rate) / c.initial_rate_sigma) ** 2
    return a - _norm(a)


def _spread(table, centre, radius: int, logw, sign: int):
    """Log sum over the kernel of ``table`` read at ``p - sign * shift``, outside the grid nothing."""
    n, m = table.shape
    width = n + 2 * radius
    rolled = np.full((m, width), FLOOR)
    for j, move in enumerate((sign * centre + radius).tolist()):
        lo, hi = max(0, -move), min(n, width - move)
        if lo < hi:
            rolled[j, lo + move : hi + move] = table[lo:hi, j]
    terms = np.empty((2 * radius + 1, m, n))
    for k in range(-radius, radius + 1):
        np.add(rolled[:, radius - sign * k : radius - sign * k + n], logw[k + radius][:, None], out=terms[k + radius])
    top = terms.max(axis=0)
    live = top > REACHED
    safe = np.where(live, top, 0.0)
    terms -= safe
    # the largest term is 1, so what lies below may be anything too small to count; subnormal numbers are slow
    np.maximum(terms, -700.0, out=terms)
    total = np.exp(terms, out=terms).sum(axis=0)
    return np.where(live, safe + np.log(np.maximum(total, 1e-300)), FLOOR).T


def _mix(table, transition):
    """Log of a matrix product over rates, rows scaled by their maximum."""
    top = table.max(axis=1, keepdims=True)
    mixed = np.exp(np.maximum(table - top, -745.0)) @ transition
    return np.where(mixed > 0, top + np.log(np.maximum(mixed, 1e-300)), FLOOR)


def lattice_moves(offsets, rates, gap: float, centre_move: float, c: LatticeConfig):
    """What both passes need of the move between two blocks: position kernels and the rate transition."""
    return *_position_moves(offsets, rates, gap, centre_move, c), np.exp(_log_rate_transition(rates, gap, c))


def lattice_forward(alpha, emission, offsets, rates, gap: float, centre_move: float, c: LatticeConfig, moves=None):
    """One forward step; returns the normalised lattice and its log normaliser."""
    centre, radius, logw, norm, transition = moves or lattice_moves(offsets, rates, gap, centre_move, c)
    ready = np.where(norm > REACHED, alpha - norm, FLOOR)
    after = _spread(ready, centre, radius, logw, 1)
    cur = _mix(after, transition) + emission
    z = _norm(cur)
    return np.maximum(cur - z, FLOOR), z


def lattice_backward(beta, emission, offsets, rates, gap: float, centre_move: float, c: LatticeConfig, moves=None):
    """One backward step across the move into a block with this emission."""
    centre, radius, logw, norm, transition = moves or lattice_moves(offsets, rates, gap, centre_move, c)
    after = _mix(emission + beta, transition.T)
    out = _spread(after, centre, radius, logw, -1)
    out = np.where(norm > REACHED, out - norm, FLOOR)
    return np.maximum(out - _norm(out), FLOOR)


def lattice_summary(alpha, beta, offsets, rates) -> tuple[float, float, float, float, float, float]:
    """Posterior mean and std of offset and rate, and the mass in the edge cells of both axes."""
    p = alpha + beta
    p = np.exp(np.maximum(p - p.max(), -745.0))
    p /= p.sum()
    return _moments(p.sum(axis=1), p.sum(axis=0), offsets, rates)


def _moments(po, pr, offsets, rates) -> tuple[float, float, float, float, float, float]:
    mo, mr = float(po @ offsets), float(pr @ rates)
    so = np.sqrt(max(float(po @ offsets**2) - mo * mo, 0.0))
    sr = np.sqrt(max(float(pr @ rates**2) - mr * mr, 0.0))
    eo = float(po[:OFFSET_EDGE_CELLS].sum() + po[-OFFSET_EDGE_CELLS:].sum())
    er = float(pr[:RATE_EDGE_CELLS].sum() + pr[-RATE_EDGE_CELLS:].sum())
    return mo, float(so), mr, float(sr), eo, er


# The same recurrence on shares instead of their logs, ``(rate, offset)``: no logarithm a cell and step, but cells below ``DROPPED`` of the
# whole are lost. ``lattice_smooth`` proves that no lost cell could have mattered, or says so.
DROPPED = 1e-290
#: Log share of the mass that may go on the way: cells are lost at e^-656 together, and what they add must stay below e^-60.
LEFT = -590.0


def linear_moves(offsets, rates, gap: float, centre_move: float, c: LatticeConfig):
    """Shift per rate, kernel radius, weights ``(kernel, rate)``, inverse share of each source's moves that stay inside, and the rate transition."""
    centre, radius, logw = _position_kernel(offsets, rates, gap, centre_move, c)
    weights, n, width = np.exp(logw), len(offsets), 2 * radius + 1
    cum = np.vstack([np.zeros(len(rates)), np.cumsum(weights, axis=0)])
    inverse, first = np.ones((len(rates), n)), centre - radius
    # sources whose moves all stay inside need no share
    low, high = min(n, max(0, int(-first.min()))), max(0, n - width - int(first.max()) + 1)
    ends = np.arange(n) if low >= high else np.r_[0:low, high:n]
    at, cols = ends[None, :] + first[:, None], np.arange(len(rates))[:, None]
    lo, hi = np.clip(-at, 0, width), np.clip(n - at, 0, width)
    mass = np.where(hi > lo, cum[hi, cols] - cum[np.minimum(lo, hi), cols], 0.0)
    inverse[:, ends] = np.where(mass > 1e-300, 1.0 / np.maximum(mass, 1e-300), 0.0)
    return centre, radius, weights, inverse, np.exp(_log_rate_transition(rates, gap, c))


def _linear_spread(table, centre, radius: int, weights, sign: int):
    """Sum over the kernel of ``table`` read at ``p - sign * shift``, outside the grid nothing."""
    m, n = table.shape
    width = n + 2 * radius
    rolled = np.zeros((m, width))
    for j, move in enumerate((sign * centre + radius).tolist()):
        lo, hi = max(0, -move), min(n, width - move)
        if lo < hi:
            rolled[j, lo + move : hi + move] = table[j, lo:hi]
    out, term = np.zeros((m, n)), np.empty((m, n))
    for k in range(-radius, radius + 1):
        np.multiply(rolled[:, radius - sign * k : radius - sign * k + n], weights[k + radius][:, None], out=term)
        out += term
    return out


def lattice_smooth(ems, gaps, shifts, offsets, rates, initial_rate: float, c: LatticeConfig, enough: float = np.inf):
    """Both passes over all blocks: summaries (as :func:`lattice_summary`) and log likelihoods up to each block.

    None where cells lost on the way might matter: their paths gain at most what the best emissions give, so they cannot if the kept mass
    has not shrunk below ``LEFT`` against these; going back, the largest cell must not outweigh what the forward shares meet. An empty list
    as soon as a block has more than ``enough`` on the offset edge.
    """
    start = lattice_start(offsets, rates, initial_rate, c).T
    alpha, moves, likes, alphas, totals, ll, left = np.exp(start), [], [], [], [], 0.0, 0.0
    alpha[alpha < DROPPED] = 0.0
    for gap, shift, e in zip(gaps, shifts, ems):
        top = float(e.max())
        like, move = np.exp(e.T.astype(float) - top), linear_moves(offsets, rates, gap, shift, c)
        centre, radius, weights, inverse, transition = move
        alpha = (transition.T @ _linear_spread(alpha * inverse, centre, radius, weights, 1)) * like
        total = float(alpha.sum())
        if not total > 0.0:
            return None
        left += np.log(total)
        if not left > LEFT:
            return None
        alpha /= total
        alpha[alpha < DROPPED] = 0.0
        ll += np.log(total) + top
        moves.append(move)
        likes.append(like)
        alphas.append(alpha)
        totals.append(ll)
    beta, got = np.ones(alpha.shape), []
    for i in range(len(alphas) - 1, -1, -1):
        if i < len(alphas) - 1:
            centre, radius, weights, inverse, transition = moves[i + 1]
            beta = _linear_spread(transition @ (likes[i + 1] * beta), centre, radius, weights, -1) * inverse
            top = float(beta.max())
            if not top > 0.0:
                return None
            beta /= top
            beta[beta < DROPPED] = 0.0
        p = alphas[i] * beta
        met = float(p.sum())
        if not met > np.exp(LEFT):
            return None
        got.append(_moments(p.sum(axis=0) / met, p.sum(axis=1) / met, offsets, rates))
        if got[-1][4] > enough:
            return []
    return got[::-1], totals


# ---------------------------------------------------------------- nearest donors


def _number(batch: pa.RecordBatch, col: str) -> np.ndarray:
    return batch.column(col).cast(pa.float64()).to_numpy(zero_copy_only=False)


def query_arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Position, scale, id and barred folds of queries."""
    numbers = {c: _number(batch, c) for c in ("__qx", "__qy", "__sdx", "__sdy", "__qf", "__of")}
    return {"id": batch.column("__qid").to_numpy(zero_copy_only=False), **numbers}


def nearest(d: dict, q: dict, k: int, among: np.ndarray | None = None):
    """The ``k`` nearest of donors in order of their ids: query rows, donors, distances and their two parts."""
    xy, fold, ids = (d[c] if among is None else d[c][among] for c in ("xy", "fold", "id"))
    m, rows = len(ids), len(q["id"])
    cx = (xy[None, :, 0] - q["__qx"][:, None]) / q["__sdx"][:, None]
    cy = (xy[None, :, 1] - q["__qy"][:, None]) / q["__sdy"][:, None]
    dist = np.sqrt(cx * cx + cy * cy)
    barred = q["id"][:, None] == ids[None, :]
    for col in ("__qf", "__of"):
        barred |= q[col][:, None] == fold[None, :]
    dist[barred] = np.inf
    if m > 4 * k:
        # cut to everything not farther than the k-th distance, then order that stably by id
        limit = np.partition(dist, k - 1, axis=1)[:, k - 1 : k]
        width = int((dist <= limit).sum(axis=1).max())
        near = np.sort(np.argpartition(dist, min(width, m) - 1, axis=1)[:, :width], axis=1)
    else:
        near = np.broadcast_to(np.arange(m), (rows, m))
    order = np.argsort(np.take_along_axis(dist, near, axis=1), axis=1, kind="stable")[:, :k]
    pick = np.take_along_axis(near, order, axis=1)
    at_row = np.repeat(np.arange(rows), pick.shape[1])
    flat = pick.ravel()
    good = np.isfinite(dist[at_row, flat])
    at_row, flat = at_row[good], flat[good]
    found = flat if among is None else among[flat]
    return at_row, found, dist[at_row, flat], cx[at_row, flat], cy[at_row, flat]


def near_structs(d: dict, found, rows: int) -> pa.ListArray:
    """Found donors as one list of structs a query."""
    at_row, flat, dist, cx, cy = found
    fold, cells = d["fold"][flat], d["s"][flat]
    surfaces = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel()))
    structs = pa.StructArray.from_arrays(
        [pa.array(dist), pa.array(cx), pa.array(cy), pa.array(d["id"][flat]), pa.array(np.nan_to_num(fold).astype(np.int32), mask=np.isnan(fold)), surfaces],
        names=["d", "cx", "cy", "id", "fold", "s"],
    )
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at_row, minlength=rows))]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, structs)


def plane_values(near: pa.ListArray, k: int, count: int, ridge: float, eps: float = 1e-6) -> list[np.ndarray]:
    """Each surface at the query, by the plane through its ``k`` neighbours (see ``spatial.plane_weights``); NaN with fewer, or without a plane.

    Sums run neighbour by neighbour, so that they are those of the column expressions to the last bit.
    """
    sizes = np.diff(near.offsets.to_numpy())
    full, items = np.flatnonzero(sizes == k), near.flatten()
    take = (near.offsets.to_numpy()[:-1] - near.offsets.to_numpy()[0])[full][:, None] + np.arange(k)
    number = lambda a: np.asarray(a.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=float)
    names = [items.type.field(i).name for i in range(items.type.num_fields)]
    column = lambda c: items.flatten()[names.index(c)]
    dist, cx, cy = (number(column(c))[take] for c in ("d", "cx", "cy"))
    cells = number(column("s").flatten()).reshape(-1, count)[take] if len(full) else np.empty((0, k, count))
    out = [np.full(len(near), np.nan) for _ in range(count)]

    def added(parts: np.ndarray) -> np.ndarray:
        acc = np.zeros(len(full))
        for i in range(k):
            acc = acc + parts[:, i]
        return acc

    with np.errstate(all="ignore"):
        raw = 1.0 / np.maximum(dist, eps)
        w = raw / added(raw)[:, None]
        a, b, c, d, e = added(w * (cx * cx)) + ridge, added(w * (cx * cy)), added(w * (cy * cy)) + ridge, added(w * cx), added(w * cy)
        c1, c2, c3 = b * e - c * d, b * d - a * e, a * c - b * b
        det = d * c1 + e * c2 + c3
        det[det == 0] = np.nan
        share = w * ((c1[:, None] * cx + c2[:, None] * cy + c3[:, None]) / det[:, None])
        for i in range(count):
            out[i][full] = added(share * cells[:, :, i])
    return out


def half_parts(cuts: np.ndarray, values: np.ndarray) -> pd.Series:
    """Parts a value reaches: its own and, as part of the margin, the nearer neighbour. A part is two halves between cuts."""
    half = np.searchsorted(cuts, values, side="right")
    own, other, last = half // 2, half // 2 + np.where(half % 2, 1, -1), len(cuts) // 2
    return pd.Series([[a, b] if 0 <= b <= last else [a] for a, b in zip(own.tolist(), other.tolist())])


CELL_BASE = 1 << 31


def half_of(cuts: np.ndarray, values: np.ndarray) -> pd.Series:
    return pd.Series(np.searchsorted(cuts, values, side="right"))


def home_cell(xs: np.ndarray, ys: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> pd.Series:
    strip = np.searchsorted(xs, x, side="right") // 2
    block = np.zeros(len(x), np.int64)
    for i in np.unique(strip):
        at = strip == i
        block[at] = np.searchsorted(ys[i], y[at], side="right") // 2
    return pd.Series(strip * CELL_BASE + block)


def reached_cells(xs: np.ndarray, ys: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> pd.Series:
    return pd.Series([[i * CELL_BASE + b for i in strips for b in half_parts(ys[i], np.array([v]))[0]] for strips, v in zip(half_parts(xs, x), y)])


def _reach(cuts: np.ndarray, part: int) -> tuple[float, float]:
    lo, hi = 2 * part - 2, 2 * part + 2
    return (cuts[lo] if lo >= 0 else -np.inf), (cuts[hi] if hi < len(cuts) else np.inf)


def cell_reach(xs: np.ndarray, ys: list[np.ndarray], cell: int) -> tuple[float, float, float, float]:
    """Bounds of a cell with its margin; donors outside are on or beyond the upper ones or below the lower ones."""
    strip, block = divmod(cell, CELL_BASE)
    return *_reach(xs, strip), *_reach(ys[strip], block)


#: Parts along x of the donors of a cell.
SLABS = 16


def slab_reach(q: dict, far: np.ndarray, x0: float, x1: float) -> tuple[np.ndarray, np.ndarray]:
    """Which queries reach donors between ``x0`` and ``x1`` within ``far``, and how far along y they do there; a little more than exact."""
    over = np.maximum(np.maximum(x0 - q["__qx"], q["__qx"] - x1), 0.0) / q["__sdx"]
    up = q["__sdy"] * np.sqrt(np.maximum(far * far - over * over, 0.0))
    return over <= far * (1 + 1e-12), up * (1 + 1e-9) + 4 * np.spacing(np.minimum(np.abs(q["__qy"]) + up, 1e300))


class HeldDonors:
    """Donors of one cell and its margin, in order of their ids, with their order along y."""

    def __init__(self, parts: list[pa.StructArray]):
        cols = list(zip(*[p.flatten() for p in parts])) or [()] * 5
        ids, fold, x, y = (np.concatenate([c.to_numpy(zero_copy_only=False) for c in cs]) if cs else np.empty(0) for cs in cols[:4])
        s = np.concatenate([np.asarray(c.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(c), -1) if len(c.flatten()) else np.empty((len(c), 0)) for c in cols[4]]) if cols[4] else np.empty((0, 0))
        by_id = np.argsort(ids, kind="stable")
        self.count = len(ids)
        self.d = {"id": ids[by_id], "fold": fold[by_id].astype(float), "xy": np.column_stack([x, y])[by_id].astype(float), "s": s[by_id]}
        self.by_y = np.argsort(self.d["xy"][:, 1], kind="stable")
        self.y = self.d["xy"][self.by_y, 1]
        # slabs along x of about equally many donors, equal x in one, each in order of y
        x, y = self.d["xy"].T
        cuts = np.unique(np.sort(x)[np.arange(1, SLABS) * len(x) // SLABS]) if len(x) else np.empty(0)
        slab = np.searchsorted(cuts, x, side="right")
        order = np.lexsort((y, slab))
        parts = np.split(order, np.searchsorted(slab[order], np.arange(1, len(cuts) + 1)))
        self.slabs = [(p, y[p], x[p].min(), x[p].max()) for p in parts if len(p)]

    def _within(self, q: dict, far: np.ndarray) -> np.ndarray:
        """Donors that may be no farther than ``far`` from one of the queries: of each slab those in reach along y, given the way to the slab along x."""
        found = []
        for rows, y, x0, x1 in self.slabs:
            hit, up = slab_reach(q, far, x0, x1)
            if hit.any():
                at, up = q["__qy"][hit], up[hit]
                lo, hi = np.searchsorted(y, (at - up).min(), side="left"), np.searchsorted(y, (at + up).max(), side="right")
                found.append(rows[lo:hi])
        return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)

    def search(self, block: pa.RecordBatch, k: int, reach, spans: tuple[np.ndarray, np.ndarray], inner: tuple[int, int]) -> tuple[pa.ListArray, np.ndarray]:
        """Neighbours of queries close in y, and which queries need donors beyond ``reach``.

        ``spans`` are the smallest and largest x of the donors in each half strip, ``inner`` the half strips that reach holds.
        """
        q, rows = query_arrays(block), block.num_rows
        lo, hi = np.searchsorted(self.y, q["__qy"].min(), side="left"), np.searchsorted(self.y, q["__qy"].max(), side="right")
        first = self._bound(nearest(self.d, q, k, np.sort(self.by_y[max(0, lo - 8 * k) : hi + 8 * k])), rows, k)
        far = first * (1 + 1e-9)
        if np.isfinite(far).all():
            found = nearest(self.d, q, k, self._within(q, far))
        else:
            found = nearest(self.d, q, k)
        far = self._bound(found, rows, k) * (1 + 1e-9)
        y0, y1 = reach[2:]
        beyond = np.zeros(rows, dtype=bool)
        for half in np.flatnonzero(spans[0] <= spans[1]) if not np.isinf(reach).all() else ():
            hit, up = slab_reach(q, far, spans[0][half], spans[1][half])
            if inner[0] <= half < inner[1]:
                hit &= (q["__qy"] - up <= y0) | (q["__qy"] + up >= y1)
            beyond |= hit
        return near_structs(self.d, found, rows), beyond

    @staticmethod
    def _bound(found, rows: int, k: int) -> np.ndarray:
        at_row, _, dist, *_ = found
        bound = np.zeros(rows)
        np.maximum.at(bound, at_row, dist)
        return np.where(np.bincount(at_row, minlength=rows) >= k, bound, np.inf)


# ---------------------------------------------------------------- ledger decisions


@dataclass(frozen=True)
class Policy:
    """Rules for a submission: mode, daily budget, direction and the margin over the best so far."""

    max_daily: int = 2
    threshold: float = 0.0
    direction: str = "minimize"
    mode: str = "api"


def decide_one(state: tuple, day, valid: bool, cv, force: bool, policy: Policy) -> tuple[str, tuple]:
    """Decision for one event and the new ``(best, day, used)`` of its ledger."""
    best, last_day, used = state
    if day != last_day:
        last_day, used = day, 0
    if not valid:
        return "invalid", (best, last_day, used)
    if policy.mode != "api":
        return f"{policy.mode}_required", (best, last_day, used)
    if used >= policy.max_daily:
        return "queued_budget", (best, last_day, used)
    sign = 1.0 if policy.direction == "maximize" else -1.0
    scored = cv is not None and cv == cv
    if not force and scored and best is not None and sign * cv < sign * best + policy.threshold:
        return "queued_threshold", (best, last_day, used)
    if scored and (best is None or sign * cv > sign * best):
        best = cv
    return "accepted", (best, last_day, used + 1)
