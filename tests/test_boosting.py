import numpy as np
import pytest
from pyspark.sql import functions as F

from foldline.operators import boosting
from foldline.operators.boosting import Boosting, fit_folds


def slow_boost(x, y, train, held, p, edges):
    """One fold, row by row: trees grown by trying every cut of every column."""
    bins = np.stack([np.where(np.isnan(x[:, c]), 0, np.searchsorted(e, x[:, c]) + 1) for c, e in enumerate(edges)], axis=1)
    mean = y[train].mean()
    score = np.full(len(y), np.log(mean / (1 - mean)) if p.classify else mean)
    link = (lambda s: 1 / (1 + np.exp(-s))) if p.classify else (lambda s: s)

    def grow(rows, depth, g, h):
        value = p.rate * g[rows].sum() / (h[rows].sum() + p.ridge)
        best = (1e-9, None)
        if depth < p.depth:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + p.ridge)
            for c in range(x.shape[1]):
                for cut in range(len(edges[c]) + 1):
                    a, b = rows[bins[rows, c] <= cut], rows[bins[rows, c] > cut]
                    if min(len(a), len(b)) >= p.min_rows:
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + p.ridge) for s in (a, b)) - whole
                        if gain > best[0] + 1e-9:
                            best = (gain, (c, cut, a, b))
        if best[1] is None:
            return value
        c, cut, a, b = best[1]
        return c, cut, grow(a, depth + 1, g, h), grow(b, depth + 1, g, h)

    def leaf(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if bins[row, tree[0]] <= tree[1] else tree[3]
        return tree

    loss = lambda: np.mean([-(np.log(q) if t else np.log(1 - q)) if p.classify else (t - q) ** 2 for q, t in zip(link(score[held]), y[held])])
    losses, scores = [loss()], [score.copy()]
    for _ in range(p.rounds):
        m = link(score)
        tree = grow(np.flatnonzero(train), 0, y - m, m * (1 - m) if p.classify else np.ones(len(y)))
        score = score + np.array([leaf(tree, i) for i in range(len(y))])
        losses.append(loss())
        scores.append(score.copy())
        if len(losses) - 1 - int(np.argmin(losses)) >= p.patience:
            break
    return link(scores[int(np.argmin(losses))])


def table(spark, n=240, seed=3, classify=False):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.random(n)], axis=1)
    x[rng.random((n, 3)) < 0.1] = np.nan
    y = np.nan_to_num(x[:, 0]) * 3 + np.nan_to_num(x[:, 1]) ** 2 + rng.normal(size=n)
    y = (y > np.median(y)).astype(float) if classify else y
    fold = rng.integers(0, 3, n)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t), None if i % 17 == 0 else int(f)) for i, (r, t, f) in enumerate(zip(x, y, fold))]
    df = spark.createDataFrame(rows, "id long, a double, `b.c` double, d double, y double, fold int").repartition(5)
    return x, y, np.array([-1 if r[-1] is None else r[-1] for r in rows]), df


@pytest.mark.parametrize("classify,chained", [(False, False), (True, False), (False, True)])
def test_equals_brute_force(spark, monkeypatch, classify, chained):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    x, y, fold, df = table(spark, classify=classify)
    p = Boosting(rounds=5, depth=3, rate=0.4, bins=8, min_rows=6, patience=2, classify=classify)
    model = fit_folds(df, "y", ["a", "b.c", "d"], "fold", p, chained)
    got = {r["id"]: r["pred"] for r in model.oof().collect()}
    assert model.oof().columns == [*df.columns, "pred"] and set(got) == set(np.flatnonzero(fold >= 0))
    for k in range(3):
        train, held = (fold < k) if chained else (fold != k), np.flatnonzero(fold == k)
        want = slow_boost(x, y, train, held, p, model.edges)
        assert np.allclose([got[i] for i in held], want[held], atol=1e-8)
    assert abs(sum(model.importances().values()) - 1) < 1e-9


def test_new_rows_take_the_mean_of_the_folds(spark):
    x, y, fold, df = table(spark)
    model = fit_folds(df, "y", ["a", "b.c"], "fold", Boosting(rounds=3, depth=2, min_rows=5, rate=0.3))
    new = {r["id"]: r["pred"] for r in model.predict(df.drop("y", "fold")).collect()}
    bins = np.stack([np.where(np.isnan(x[:, c]), 0, np.searchsorted(model.edges[c], x[:, c]) + 1) for c in range(2)], axis=1)
    want = np.mean([model.start[k] + sum(t(bins) for t in model.trees[k][: model.best[k]]) for k in range(3)], axis=0)
    assert np.allclose([new[i] for i in range(len(y))], want)


def test_early_stop_and_constant_columns(spark):
    df = spark.range(200).select("id", F.lit(1.0).alias("a"), F.lit(None).cast("double").alias("b"), (F.hash("id") % 7).cast("double").alias("y"), (F.col("id") % 2).cast("int").alias("fold"))
    model = fit_folds(df, "y", ["a", "b"], "fold", Boosting(rounds=30, patience=3))
    assert all(len(x) <= 31 for x in model.losses) and model.oof().count() == 200
    means = {r["fold"]: r["pred"] for r in model.oof().select("fold", F.round("pred", 9).alias("pred")).distinct().collect()}
    assert len(means) == 2


def test_without_patience_all_rounds_count(spark):
    """Folds with opposite signals: every tree makes the held-out loss worse."""
    rows = [(i % 2, float(i % 10), float((i % 10) * (1 if i % 2 else -1))) for i in range(200)]
    df = spark.createDataFrame(rows, "fold int, a double, y double")
    stopped = fit_folds(df, "y", ["a"], "fold", Boosting(rounds=3, depth=1, rate=0.5))
    whole = fit_folds(df, "y", ["a"], "fold", Boosting(rounds=3, depth=1, rate=0.5, patience=0))
    assert stopped.best == [0, 0] and whole.best == [3, 3]
    assert [len(t) for t in whole.trees] == [3, 3]


def test_input_is_evaluated_once(spark, tmp_path):
    """The scans for the edges, the folds and the binning read the written rows, not the query behind them."""
    met = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            met.add(b.num_rows)
            yield b

    rows = spark.range(400).select((F.col("id") % 3).cast("int").alias("fold"), (F.col("id") * 7 % 53).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("y"))
    fit_folds(rows.mapInArrow(count, rows.schema), "y", ["x"], "fold", Boosting(rounds=1, depth=1))
    assert met.value == 400
