"""Weights, folds and selection: known answers, brute force and isolation."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.regression import LinearRegression

from foldline.operators import ensemble as E
from foldline.operators import folds as FO
from foldline.operators import models as M
from foldline.plans import q_models


def _stats(streams, y):
    d = streams[:, 1:] - streams[:, :1]
    r = y - streams[:, 0]
    return E.DeltaStats(len(y), d.T @ d, d.T @ r, float(r @ r))


@pytest.mark.parametrize("weights", [[1, 0, 0, 0], [0.2, 0.3, 0.1, 0.4], [0, 0.6, 0.4, 0], [0.5, 0, 0, 0.5]])
def test_simplex_recovers_known_weights(weights):
    rng = np.random.default_rng(0)
    s = rng.normal(size=(200, 4)) + 100
    fit = E.simplex_ls(_stats(s, s @ np.array(weights)), list("abcd"))
    np.testing.assert_allclose(fit.weights, weights, atol=1e-8)
    assert len({a["support"] for a in fit.audit}) == 15


def test_simplex_beats_dense_grid():
    rng = np.random.default_rng(4)
    for _ in range(10):
        s, y = rng.normal(size=(60, 3)), rng.normal(size=60)
        st_ = _stats(s, y)
        fit = E.simplex_ls(st_, list("abc"))
        assert fit.sse <= min(st_.sse(w) for w in E.compositions(40, 3) / 40) + 1e-9
        assert fit.sse == pytest.approx(float(((y - s @ fit.weights) ** 2).sum()), rel=1e-9)


def test_identical_streams_prefer_the_first():
    s = np.repeat(np.random.default_rng(1).normal(size=(50, 1)), 3, axis=1)
    assert E.simplex_ls(_stats(s, s[:, 0] + 1), list("abc")).weights.tolist() == [1.0, 0.0, 0.0]


def test_correlation_optimum_beats_grid():
    rng = np.random.default_rng(2)
    for _ in range(10):
        x, y = rng.normal(size=(80, 3)), rng.normal(size=80)
        x = x + y[:, None] * rng.uniform(-0.5, 1, 3)
        c = np.cov(np.column_stack([y, x]).T) * 79
        s = E.BlendStats(("a", "b", "c"), 80, c[1:, 1:], c[0, 1:], c[0, 0], np.eye(3))
        w, best = E.max_pearson_weights(s)
        assert w.min() >= 0 and w.sum() == pytest.approx(1)
        assert best >= E.simplex_grid(s, 20)[1].max() - 1e-9
        assert best == pytest.approx(np.corrcoef(y, x @ w)[0, 1])


def test_nelder_mead_minimum():
    x, f = E.nelder_mead(lambda v: float((v[0] - 1) ** 2 + 10 * (v[1] + 2) ** 2), np.zeros(2))
    np.testing.assert_allclose(x, [1, -2], atol=1e-4)
    assert f < 1e-8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=3, max_size=60), st.integers(2, 6))
def test_fold_stages_equal_greedy(weights, k):
    weights = sorted(weights, reverse=True)
    loads, want = [0] * k, []
    for w in weights:
        f = loads.index(min(loads))
        loads[f] += w
        want.append(f)
    mine, got = [0] * k, []
    for w in sorted(set(weights), reverse=True):
        n = weights.count(w)
        stages = FO._stages(mine, w, n)
        for p in range(n):
            at, cycle = [s for s in stages if s[0] <= p][-1]
            got.append(cycle[(p - at) % len(cycle)])
    assert got == want and mine == loads


def _oof(spark, n=300, poison=False):
    rng = np.random.default_rng(7)
    y = rng.normal(size=n)
    pdf = pd.DataFrame({"id": range(n), "fold": np.arange(n) % 3, "y": y, "a": y + rng.normal(size=n), "b": 0.5 * y + rng.normal(size=n), "c": rng.normal(size=n)})
    if poison:
        pdf.loc[pdf.fold == 1, "y"] = 1000.0
    return spark.createDataFrame(pdf)


def test_held_out_fold_does_not_move_its_weights(spark):
    a = E.nested_stack(_oof(spark), "y", ["a", "b", "c"], "fold")[1]
    b = E.nested_stack(_oof(spark, poison=True), "y", ["a", "b", "c"], "fold")[1]
    np.testing.assert_allclose(a[1].weights, b[1].weights, atol=1e-12)
    assert not np.allclose(a[0].weights, b[0].weights)


def test_fit_verification_fails_closed(spark):
    o = _oof(spark)
    fit = E.simplex_ls(E.delta_stats(o, "y", ["a", "b"])[()], ["a", "b"])
    fit.sse *= 1.01
    with pytest.raises(ValueError):
        E.verify_fits(o, "y", ["a", "b"], {None: fit})


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(9)
    n = 240
    x = rng.normal(3, 2, size=(n, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=n)
    x[rng.random((n, 3)) < 0.1] = np.nan
    fold = np.arange(n) % 4
    pdf = pd.DataFrame(x, columns=list("abc")).assign(y=y, fold=fold, id=range(n))
    df = spark.createDataFrame(pdf).na.replace(float("nan"), None)
    from foldline.roles import nan_to_null

    df = nan_to_null(df)
    fit = M.ridge_cv(df, "y", list("abc"), "fold", [7.0])
    got = fit.oof(df, "fold").toPandas().sort_values("id")["pred"].to_numpy()
    want = np.zeros(n)
    for f in range(4):
        t = fold != f
        med = np.nanmedian(x[t], axis=0)
        tr, va = np.where(np.isnan(x[t]), med, x[t]), np.where(np.isnan(x[~t]), med, x[~t])
        mu, sd = tr.mean(0), tr.std(0)
        z = (tr - mu) / sd
        b = np.linalg.solve(z.T @ z + 7 * np.eye(3), z.T @ (y[t] - y[t].mean()))
        want[~t] = (va - mu) / sd @ b + y[t].mean()
    np.testing.assert_allclose(got, want, rtol=1e-8, atol=1e-8)
    assert fit.scores[7.0] == pytest.approx(np.corrcoef(y, want)[0, 1], abs=1e-9)


def test_batched_moments_equal_jvm_sums(spark, monkeypatch):
    from foldline.operators import moments as MO

    o = _oof(spark)
    direct = MO.collect_moments(o, ["y", "a", "b"], ["fold"])
    monkeypatch.setattr(MO, "JVM_COLUMNS", 0)
    batched = MO.collect_moments(o, ["y", "a", "b"], ["fold"])
    assert direct.keys() == batched.keys()
    for k in direct:
        assert direct[k][0] == batched[k][0]
        np.testing.assert_allclose(direct[k][1], batched[k][1], rtol=1e-10)


def test_random_search_space():
    space = {"depth": ("int", 2, 4), "rate": ("log", 0.01, 1.0), "kind": ("choice", ["a", "b"]), "share": ("float", 0.5, 1.0)}
    for p in M.sample_params(space, 30):
        assert 2 <= p["depth"] <= 4 and 0.01 <= p["rate"] <= 1 and p["kind"] in "ab" and 0.5 <= p["share"] <= 1
    trials, summary = M.random_search(lambda p: p["rate"], space, 10, "maximize")
    assert trials[0]["score"] == summary["best"] >= trials[-1]["score"] == summary["worst"]


def _counted(spark, n=600):
    """Rows whose making is counted, so that a test sees how often a job makes them again."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(n).selectExpr("id", "id * 1.0 AS y", "(id % 7) * 1.0 AS a", "(id % 5) * 1.0 AS b", "CAST(id % 3 AS int) AS fold")
    return rows.mapInArrow(count, rows.schema), made, n


def test_cross_validation_makes_its_rows_once(spark):
    df, made, n = _counted(spark)
    res = M.cross_validate(df, "y", ["a", "b"], "fold", lambda: M.gbt({"maxIter": 1, "maxDepth": 2}))
    assert res.oof.count() == n and set(res.fold_scores) == {0, 1, 2}
    assert made.value == n


def test_time_slices_make_their_rows_a_few_times(spark):
    """Counting and two sorts read the rows; fits, scores and the result do not."""
    df, made, n = _counted(spark)
    make = lambda w: LinearRegression(featuresCol="__features", labelCol="__label", weightCol=w, regParam=0.1)
    res = M.time_slice_ensemble(df.drop("fold"), "y", ["a", "b"], ["id"], make, k=2)
    placed = made.value
    assert res.oof.count() == n and made.value == placed <= 8 * n


def test_default_trees_go_on_while_the_held_out_fold_gains(spark):
    """All default rounds and the default depth; a fit does not end with its first tree."""
    est = q_models._default_gbt()
    assert all(est.getOrDefault(k) == v for k, v in M.GBT_DEFAULTS.items())
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    rows = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": 3 * x[:, 0] + np.sin(2 * x[:, 1]), "f": np.arange(400) % 4})
    df = M.assemble(spark.createDataFrame(rows), ["a", "b"]).selectExpr("__features", "y AS __label", "f = 0 AS __valid").coalesce(1).cache()
    trees = {name: make().fit(df).getNumTrees for name, make in (("spark's tolerance", M.gbt), ("query", q_models._default_gbt))}
    assert trees["query"] > max(10, trees["spark's tolerance"])
    df.unpersist()
