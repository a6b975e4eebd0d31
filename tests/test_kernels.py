"""Recurrences against direct definitions on small grids."""

import numpy as np
import pytest

from foldline.operators import kernels as K


def _direct_moves(offsets, rates, gap, move, c):
    step = offsets[1] - offsets[0]
    n, m = len(offsets), len(rates)
    p = np.zeros((n, n, m))
    for j, r in enumerate(rates):
        mean = (r * (1 - c.momentum**gap) / (1 - c.momentum) - move) / step
        sigma = max(c.position_noise * np.sqrt(gap), 0.35 * step) / step
        radius = max(2, int(np.ceil(4 * sigma)))
        centre = int(np.floor(mean + 0.5))
        for src in range(n):
            w = {s: np.exp(-0.5 * ((s - mean) / sigma) ** 2) for s in range(centre - radius, centre + radius + 1) if 0 <= src + s < n}
            total = sum(w.values())
            for s, v in w.items():
                p[src, src + s, j] = v / total
    return p


@pytest.mark.parametrize("config", K.LATTICE_CONFIGS)
@pytest.mark.parametrize("move", [0.0, 0.7, -1.3])
def test_forward_backward_matches_enumeration(config, move):
    rng = np.random.default_rng(1)
    offsets, rates = np.arange(-4, 4.25, 0.5), np.linspace(-0.1, 0.1, 5)
    steps = 4
    ems = [rng.normal(size=(len(offsets), len(rates))) for _ in range(steps)]
    gaps, moves = [5.0, 9.0, 21.0, 3.0], [0.0, move, 0.2, -move]
    alpha = K.lattice_start(offsets, rates, 0.01, config)
    a = np.exp(alpha)
    dense, logs = [], []
    for e, g, mv in zip(ems, gaps, moves):
        alpha, _ = K.lattice_forward(alpha, e, offsets, rates, g, mv, config)
        logs.append(alpha)
        t = np.exp(K._log_rate_transition(rates, g, config))
        p = _direct_moves(offsets, rates, g, mv, config)
        a = np.einsum("sj,sdj->dj", a, p) @ t * np.exp(e)
        a /= a.sum()
        dense.append(a)
    for got, want in zip(logs, dense):
        np.testing.assert_allclose(np.exp(got), want, atol=1e-10)
    beta, b = np.zeros_like(alpha), np.ones_like(a)
    for i in range(steps - 1, 0, -1):
        beta = K.lattice_backward(beta, ems[i], offsets, rates, gaps[i], moves[i], config)
        t = np.exp(K._log_rate_transition(rates, gaps[i], config))
        p = _direct_moves(offsets, rates, gaps[i], moves[i], config)
        b = np.einsum("sdj,dj->sj", p, (np.exp(ems[i]) * b) @ t.T)
        b /= b.sum()
        np.testing.assert_allclose(np.exp(beta) / np.exp(beta).sum(), b, atol=1e-10)
        post = dense[i - 1] * b
        post /= post.sum()
        got = K.lattice_summary(logs[i - 1], beta, offsets, rates)
        assert got[0] == pytest.approx(float(post.sum(axis=1) @ offsets), abs=1e-9)
        assert got[2] == pytest.approx(float(post.sum(axis=0) @ rates), abs=1e-9)


def test_missing_signal_is_neutral():
    offsets, rates = K.lattice_grids(0.0, 4.0)
    nothing = np.full(3, np.nan)
    e = K.block_emission(np.arange(3.0), np.zeros(3), nothing, 1.0, 5.0, offsets, rates, np.array([0.0, 5, 10]), np.array([1.0, 2, 3]), 1, 0, 10)
    assert not e.any()


def test_block_emission_is_the_sum_of_losses():
    """The product of factors equals the sum of logs, also where it has to be split and outside the curve."""
    rng = np.random.default_rng(5)
    offsets, rates = K.lattice_grids(0.0, 16.0)
    x, v = np.arange(100.0, 140.0, 10.0), np.array([50.0, 90.0, 20.0, 60.0])
    for big in (1.0, 1e20):
        md, z, gr = np.arange(30.0), -0.25 * np.arange(30.0), big * rng.normal(60, 20, 30)
        gr[4] = np.nan
        got = K.block_emission(md, z, gr, 10.0, 110.0, offsets, rates, x, v, 1.1, -3.0, 9.0)
        at = (110.0 + offsets)[:, None, None] + rates[None, :, None] * (md - 10.0) - z
        off = (gr - (1.1 * np.interp(at, x, v) - 3.0)) / 9.0
        loss = np.where((at < x[0]) | (at > x[-1]), K.OUT_OF_SUPPORT, 2.5 * np.log1p(off * off / 4.0))
        loss[:, :, 4] = 0.0
        np.testing.assert_allclose(got, -loss.sum(axis=2) / K.TEMPER, rtol=1e-10)


def _brute_beam(signal, curve, start, fee, scale, max_step):
    best = {start: (0.0, [])}
    for v in signal:
        nxt = {}
        for at, (cost, path) in best.items():
            for s in range(-max_step, max_step + 1):
                to = at + s
                if 0 <= to < len(curve):
                    c = cost + (v - curve[to]) ** 2 / scale + fee * abs(s)
                    if to not in nxt or c < nxt[to][0]:
                        nxt[to] = (c, [*path, to])
        best = nxt
    return min(best.values(), key=lambda t: t[0])


def test_wide_beam_is_exact_and_pieces_agree():
    rng = np.random.default_rng(3)
    curve, signal = rng.normal(size=12), rng.normal(size=(9, 2))
    args = (curve, K.beam_start(5, 2), [50, 50], [0.3, 1.1], [0.7, 0.4])
    kept, state = K.beam_forward(signal, *args)
    a, mid = K.beam_forward(signal[:4], *args)
    b, _ = K.beam_forward(signal[4:], curve, mid, *args[2:])
    for beam, fee, scale in ((0, 0.3, 0.7), (1, 1.1, 0.4)):
        path, _ = K.beam_backward(kept, beam, 0)
        cost, want = _brute_beam(signal[:, beam], curve, 5, fee, scale, 2)
        assert path.tolist() == want and state[2][state[0] == beam][0] == pytest.approx(cost)
        tail, pointer = K.beam_backward(b, beam, 0)
        head, _ = K.beam_backward(a, beam, pointer)
        assert [*head, *tail] == want


def test_particles_follow_a_ramp():
    curve = 40 + 8 * np.sin(np.arange(80, 130, 0.2) / 3)
    md = np.arange(1.0, 200.0)
    truth = 100 + 0.1 * md
    f = K.ParticleFilter(curve, 80.0, 129.8, 0.2, 10.0, 100.0, 0.1, 0.0, 0, K.ParticleParams(particles=200))
    got = [f.advance(m, 0.0, 40 + 8 * np.sin(t / 3)) for m, t in zip(md, truth)]
    assert np.isfinite(got).all() and abs(got[-1] - truth[-1]) < 5
    assert f.log_likelihood < 0


def test_beams_side_by_side_equal_each_alone():
    rng = np.random.default_rng(5)
    curves = [rng.normal(size=n) for n in (30, 12, 2, 45)]
    signals = [np.round(rng.normal(size=(n, 2)), 1) for n in (9, 40, 17, 40)]
    places, args = [5, 0, 1, 44], ([3, 6], [0.3, 1.1], [0.7, 0.4])
    got = K.beam_lanes(signals, curves, places, *args)
    for s, c, at, paths in zip(signals, curves, places, got):
        kept, _ = K.beam_forward(s, c, K.beam_start(at, 2), *args)
        assert paths.T.tolist() == [K.beam_backward(kept, b, 0)[0].tolist() for b in range(2)]


def test_particles_side_by_side_equal_each_alone():
    curve, rng, p = 40 + 8 * np.sin(np.arange(80, 130, 0.2) / 3), np.random.default_rng(2), K.ParticleParams(particles=60)

    def filters():
        return [K.ParticleFilter(curve[: 250 - 50 * i], 80.0, 129.8 - 10 * i, 0.2, 10.0 + i, 100.0, 0.1, 0.0, i % 2, p) for i in range(3)]

    moves = [(np.arange(1.0, n + 1), -0.1 * np.arange(n), np.where(np.arange(n) % 7 == 3, np.nan, 40 + 8 * rng.normal(size=n))) for n in (20, 60, 35)]
    alone, beside = filters(), filters()
    for cut in (slice(0, 15), slice(15, None)):  # the state goes on to the next batch
        parts = [[m[cut] for m in mv] for mv in moves]
        for f, mv, (preds, lls) in zip(alone, parts, K.particle_lanes(beside, parts)):
            want = [(f.advance(*row), f.log_likelihood) for row in zip(*mv)]
            assert preds.tolist() == [w[0] for w in want] and lls.tolist() == [w[1] for w in want]


@pytest.mark.parametrize("blocks,rate", [(1, 0.0), (2, 0.05), (12, 0.02)])
def test_lattice_of_shares_equals_lattice_of_logs(blocks, rate):
    """Both passes on shares give the moments and likelihoods of the passes on logs, and stop at a crowded edge."""
    rng = np.random.default_rng(blocks)
    x = np.arange(60.0, 180.0, 4.0)
    v = 40 + 10 * np.sin(x / 9)
    offsets, rates = K.lattice_grids(rate, 64.0)
    md = np.arange(21 * blocks) + 0.25 * rng.integers(0, 3, 21 * blocks)
    gr, z = 45 + 12 * rng.normal(size=21 * blocks), -0.25 * np.arange(21 * blocks)
    parts = [slice(21 * b, 21 * b + 21) for b in range(blocks)]
    ems = [K.block_emission(md[p], z[p], gr[p], md[p][10], 100.0 + z[p][10], offsets, rates, x, v, 1.1, 2.0, 20.0).astype(np.float32) for p in parts]
    gaps, shifts = np.maximum(np.diff(md[10::21], prepend=-1.0), 1.0), np.diff(100.0 + z[10::21], prepend=100.25)
    for c in K.LATTICE_CONFIGS:
        alpha, ll, alphas, totals, want = K.lattice_start(offsets, rates, rate, c), 0.0, [], [], []
        for gap, shift, e in zip(gaps, shifts, ems):
            alpha, norm = K.lattice_forward(alpha, e.astype(float), offsets, rates, gap, shift, c)
            ll += norm
            alphas.append(alpha)
            totals.append(ll)
        beta = np.zeros(alpha.shape)
        for i in reversed(range(blocks)):
            if i < blocks - 1:
                beta = K.lattice_backward(beta, ems[i + 1].astype(float), offsets, rates, gaps[i + 1], shifts[i + 1], c)
            want.append(K.lattice_summary(alphas[i], beta, offsets, rates))
        got, lls = K.lattice_smooth(ems, gaps, shifts, offsets, rates, rate, c)
        np.testing.assert_allclose(got, want[::-1], atol=1e-8)
        np.testing.assert_allclose(lls, totals, rtol=1e-10)
        assert K.lattice_smooth(ems, gaps, shifts, offsets, rates, rate, c, enough=-1.0) == []
    # all mass leaves the grid but for tails that shares cannot hold
    assert K.lattice_smooth(ems, gaps, shifts + 4000.0, offsets, rates, rate, c) is None


def test_emission_inside_and_outside_the_curve():
    """Cells outside the curve lose a constant, the others the log of one and a square."""
    offsets, rates = K.lattice_grids(0.0, 64.0)
    x, v = np.array([95.0, 100.0, 112.0]), np.array([30.0, 50.0, 45.0])
    md, z, gr = np.array([0.0, 1.0, 2.0]), np.array([0.0, -0.5, -1.0]), np.array([44.0, np.nan, 200.0])
    got = K.block_emission(md, z, gr, 1.0, 101.0, offsets, rates, x, v, 0.9, 1.0, 12.0)
    want = np.zeros((len(offsets), len(rates)))
    for i in (0, 2):
        at = 101.0 + offsets[:, None] + rates[None, :] * (md[i] - 1.0) - z[i]
        off = (np.interp(at, x, 0.9 * v + 1.0) - gr[i]) / 12.0
        want -= np.where((at < 95) | (at > 112), K.OUT_OF_SUPPORT, 2.5 * np.log1p(off * off / 4.0)) / K.TEMPER
    np.testing.assert_allclose(got, want, atol=1e-12)
