import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from foldline.operators.boosting import Boosting, fit_folds
from foldline.operators.estimators import FoldBoosting, FoldRidge, FoldRidgeModel, FoldStack, FoldStackModel
from foldline.operators.models import ridge_cv
from foldline.operators.search import successive_halving

COLS = ["a", "b"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        a, b = float(rng.normal()), float(rng.integers(0, 6))
        y = None if i % 50 == 49 else 3 * a - b + float(rng.normal())
        rows.append((i, y, None if i % 7 == 0 else a, b, None if i % 8 == 0 else i % 3, "kept"))
    return spark.createDataFrame(rows, "id long, y double, a double, b double, fold int, other string").cache()


def preds(df, out="pred"):
    return {r["id"]: r[out] for r in df.collect()}


def test_ridge_equals_the_functions_and_survives_storage(spark, panel, tmp_path):
    est = FoldRidge(featureCols=COLS, labelCol="y", predictionCol="pred", alphas=[1.0, 50.0])
    model = est.fit(panel)
    want = ridge_cv(panel, "y", COLS, "fold", [1.0, 50.0])
    oof, new = preds(want.oof(panel, "fold")), preds(want.predict(panel))
    got = preds(model.transform(panel))
    assert all(np.isclose(got[i], new[i] if i % 8 == 0 else oof[i], atol=1e-12) for i in range(240))
    assert preds(model.transform(panel.drop("fold"))).keys() == new.keys()
    assert all(np.isclose(v, new[i], atol=1e-12) for i, v in preds(model.transform(panel.drop("fold"))).items())
    assert all(np.isclose(v, new[i], atol=1e-12) for i, v in preds(model.transform(panel.withColumn("fold", F.lit(99)))).items())
    model.write().save(str(tmp_path / "m"))
    back = FoldRidgeModel.load(str(tmp_path / "m"))
    assert preds(back.transform(panel)) == got and back.uid == model.uid
    assert back.result.alpha == want.alpha and back.result.scores == model.result.scores and back.getOrDefault("featureCols") == COLS
    want_shares = np.mean([np.abs(m.coef) for m in want.models.values()], axis=0)
    got_shares = back.feature_importance(spark).collect()
    assert np.allclose([dict(map(tuple, got_shares))[c] for c in COLS], want_shares) and got_shares[0]["importance"] >= got_shares[1]["importance"]
    model.write().overwrite().save(str(tmp_path / "m"))
    with pytest.raises(AssertionError):
        FoldStackModel.load(str(tmp_path / "m"))


def test_trees_equal_the_functions_and_survive_storage(spark, panel, tmp_path):
    est = FoldBoosting(featureCols=COLS, labelCol="y", predictionCol="pred", rounds=4, depth=2, rate=0.4, min_rows=5)
    model = est.fit(panel)
    trees = fit_folds(panel, "y", COLS, "fold", Boosting(rounds=4, depth=2, rate=0.4, min_rows=5))
    oof, new = preds(trees.oof()), preds(trees.predict(panel))
    done = model.transform(panel)
    got = preds(done)
    assert done.columns == [*panel.columns, "pred"]
    labelled = {i for i in range(240) if i % 50 != 49}
    assert all(np.isclose(got[i], new[i] if i % 8 == 0 else oof[i], atol=1e-9) for i in labelled)
    model.save(str(tmp_path / "m"))
    back = type(model).load(str(tmp_path / "m"))
    assert preds(back.transform(panel)) == got
    assert back.trees.importances() == model.trees.importances() and abs(sum(back.trees.importances().values()) - 1) < 1e-9
    assert preds(back.transform(done)) == got  # the column is replaced, not doubled


def test_parameters_are_copied_and_saved(panel, tmp_path):
    est = FoldBoosting(featureCols=COLS, labelCol="y", rounds=3)
    est.save(str(tmp_path / "e"))
    back = FoldBoosting.load(str(tmp_path / "e"))
    assert back.getOrDefault("rounds") == 3 and back.getOrDefault("depth") == Boosting().depth and back.getOrDefault("featureCols") == COLS
    ridge = FoldRidge(featureCols=COLS, labelCol="y", alphas=[1.0])
    fits = ridge.fit(panel, [{ridge.alphas: [2.0]}, {ridge.alphas: [3.0]}])
    assert [m.result.alpha for m in fits] == [2.0, 3.0] and ridge.getOrDefault("alphas") == [1.0]


def test_pipeline_of_streams_and_stack(panel, tmp_path):
    given = {"labelCol": "y", "foldCol": "fold"}
    fit = Pipeline(stages=[
        FoldRidge(featureCols=COLS, predictionCol="p1", **given), FoldBoosting(featureCols=COLS, predictionCol="p2", rounds=3, depth=2, min_rows=5, **given),
        FoldStack(featureCols=["p1", "p2"], predictionCol="pred", **given),
    ]).fit(panel)
    done = fit.transform(panel)
    fit.save(str(tmp_path / "p"))
    assert preds(PipelineModel.load(str(tmp_path / "p")).transform(panel)) == preds(done)
    stack = fit.stages[-1]
    for r in done.collect():
        w = stack.fits[r["fold"]].weights if r["fold"] is not None else stack.final.weights
        assert np.isclose(r["pred"], w @ [r["p1"], r["p2"]])
    assert abs(stack.final.weights.sum() - 1) < 1e-12


def test_halving_keeps_the_better_half_whatever_the_parallelism(spark):
    table = spark.range(100).cache()

    def score(p, budget):
        return None if p["k"] == 5 else float(table.agg(F.sum(F.abs(F.col("id") - 10 * p["k"]))).first()[0]) / budget

    space = {"k": ("int", 0, 9), "c": ("choice", ["x", "y"]), "f": ("float", 0.0, 1.0), "g": ("log", 0.1, 10.0)}
    runs = [successive_halving(spark, score, space, 8, [1, 2, 4], parallelism=n, seed=3) for n in (1, 5)]
    assert runs[0] == runs[1]
    trials, best = runs[0]
    assert [sum(t["rung"] == r for t in trials) for r in range(3)] == [8, 4, 2]
    for r in range(3):
        rung = [t for t in trials if t["rung"] == r]
        order = sorted(rung, key=lambda t: (np.inf if t["score"] is None else t["score"], t["trial"]))
        stay = order[: 1 if r == 2 else len(rung) // 2]
        assert {t["trial"] for t in rung if t["kept"]} == {t["trial"] for t in stay}
        if r < 2:
            assert {t["trial"] for t in trials if t["rung"] == r + 1} == {t["trial"] for t in stay}
    assert best["trial"] == next(t["trial"] for t in trials if t["rung"] == 2 and t["kept"])
    with pytest.raises(ValueError):
        successive_halving(spark, score, space, 0, [1])
