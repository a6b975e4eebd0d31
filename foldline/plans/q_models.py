"""Model queries: ridge on statistics, boosted trees, searches and ablations over orders and lines."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from foldline.operators import boosting as B
from foldline.operators import estimators as ES
from foldline.operators import models as M
from foldline.operators import sequence as SQ
from foldline.operators import windows as W
from foldline.operators.folds import time_series_split
from foldline.operators.metrics import get_metric
from foldline.operators.quantiles import training_quantiles
from foldline.operators.search import successive_halving
from foldline.plans.catalog import query, rounded, table
from foldline.plans.stand_ins import OOF_SQL, entities, oof
from foldline.session import cut_lineage, delete_path, scratch_root

COLS = ["f1", "f2", "f3", "f4"]


def _panel(spark, sf_dir):
    """Orders with line summaries as features, a fold by customer and gaps in two columns."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"), F.avg("l_discount").alias("d")
    )
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate", F.col("o_totalprice").alias("t"))
    both = o.join(li, "id")
    return both.select(
        "id", F.col("o_orderdate").alias("day"), (F.col("o_custkey") % 5).cast("int").alias("fold"),
        (F.col("t") / 1000 + F.col("q") * 2 - F.col("p") / 2000).alias("y"), F.when(F.col("id") % 9 != 2, F.col("q")).alias("f1"),
        (F.col("p") / 1000).alias("f2"), F.when(F.col("id") % 7 != 3, F.col("d") * 100).alias("f3"), (F.col("id") % 23).cast("double").alias("f4"),
    )


# One feature and one penalty have a closed form that SQL can follow: imputed, standardised, shrunk.
@query(
    "I8",
    """WITH li AS (SELECT l_orderkey AS id, sum(l_quantity) q, sum(l_extendedprice) p FROM lineitem GROUP BY 1),
         x AS (SELECT o_orderkey AS id, (o_custkey % 5)::INTEGER AS fold, o_totalprice / 1000 + q * 2 - p / 2000 AS y, CASE WHEN o_orderkey % 9 <> 2 THEN q END AS f1 FROM orders JOIN li ON li.id = o_orderkey),
         m AS (SELECT f AS fold, median(f1) AS med FROM x, range(5) t(f) WHERE fold <> f GROUP BY f),
         s AS (SELECT m.fold, med, avg(coalesce(f1, med)) AS mu, stddev_pop(coalesce(f1, med)) AS sd, avg(y) AS ym, count(*) AS n, covar_pop(coalesce(f1, med), y) AS c FROM x JOIN m ON x.fold <> m.fold GROUP BY m.fold, med)
       SELECT id, round(ym + (coalesce(f1, med) - mu) / sd * (n * c / sd) / (n + 100), 6) AS pred FROM x JOIN s USING (fold)""",
)
def ridge_one_feature(spark, sf_dir):
    p = _panel(spark, sf_dir)
    fit = M.ridge_cv(p, "y", ["f1"], "fold", [100.0])
    return rounded(fit.oof(p, "fold").select("id", "pred"))


# Two complete features: the 2 x 2 normal equations written out.
@query(
    "I8 P4",
    """WITH li AS (SELECT l_orderkey AS id, sum(l_quantity) q, sum(l_extendedprice) p FROM lineitem GROUP BY 1),
         x AS (SELECT o_orderkey AS id, (o_custkey % 5)::INTEGER AS fold, o_totalprice / 1000 + q * 2 - p / 2000 AS y, p / 1000 AS a, (o_orderkey % 23)::DOUBLE AS b FROM orders JOIN li ON li.id = o_orderkey),
         s AS (SELECT f AS fold, avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb, avg(y) my, count(*) n, corr(a, b) r, covar_pop(a, y) cay, covar_pop(b, y) cby FROM x, range(5) t(f) WHERE fold <> f GROUP BY f),
         c AS (SELECT *, n + 50 AS d, n * r AS o, n * cay / sa AS u, n * cby / sb AS v FROM s)
       SELECT id, round(my + (a - ma) / sa * (u * d - v * o) / (d * d - o * o) + (b - mb) / sb * (v * d - u * o) / (d * d - o * o), 6) AS pred FROM x JOIN c USING (fold)""",
)
def ridge_two_features(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return rounded(M.ridge_cv(p, "y", ["f2", "f4"], "fold", [50.0]).oof(p, "fold").select("id", "pred"))


@query("I8 I4")
def ridge_penalty_search(spark, sf_dir):
    """Chained time folds, four features, several penalties: pooled correlation of each."""
    p = time_series_split(_panel(spark, sf_dir).drop("fold"), ["day", "id"], 5)
    fit = M.ridge_cv(p, "y", COLS, "fold", [1.0, 100.0, 3000.0], chained=True)
    rows = [(float(a), float(s), a == fit.alpha) for a, s in fit.scores.items()]
    return rounded(spark.createDataFrame(rows, "alpha double, corr double, chosen boolean"))


@query("I8")
def ridge_new_rows(spark, sf_dir):
    p = _panel(spark, sf_dir)
    fit = M.ridge_cv(p.filter("id % 4 <> 0"), "y", COLS, "fold", [10.0])
    return rounded(fit.predict(p.filter("id % 4 = 0")).select("id", "pred"))


@query(
    "I8 D34",
    """WITH x AS (SELECT (l_orderkey % 5)::INTEGER AS fold, l_quantity, CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS l_extendedprice, -l_discount AS less, CASE WHEN l_orderkey % 7 > 2 THEN l_tax / 3 END AS tiny FROM lineitem),
         u AS (SELECT fold, unnest(['l_quantity', 'l_extendedprice', 'less', 'tiny']) AS "column", unnest([l_quantity::DOUBLE, l_extendedprice::DOUBLE, less::DOUBLE, tiny::DOUBLE]) AS v FROM x)
       SELECT f::INTEGER AS fold, "column", round(quantile_cont(v, 0.1), 6) AS low, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS high
       FROM u, range(5) t(f) WHERE fold <> f GROUP BY f, "column" """,
)
def training_quantiles_by_fold(spark, sf_dir):
    """Quantiles of every column over each fold's training rows, all from the same eight scans."""
    x = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 5).cast("int").alias("fold"), "l_quantity", F.when(F.col("l_linenumber") != 2, F.col("l_extendedprice")).alias("l_extendedprice"),
        (-F.col("l_discount")).alias("less"), F.when(F.col("l_orderkey") % 7 > 2, F.col("l_tax").cast("double") / 3).alias("tiny"),
    )
    q = training_quantiles(x, ["l_quantity", "l_extendedprice", "less", "tiny"], "fold", [0.1, 0.5, 0.9])
    return rounded(q.select("fold", "column", *[F.col("q")[i].alias(n) for i, n in enumerate(("low", "median", "high"))]))


@query("I9 E24")
def weighted_ridge_probe(spark, sf_dir):
    rows = M.weighted_ridge_probe(_panel(spark, sf_dir).drop("fold"), "y", COLS, ["day", "id"], (1.0, 0.5), (10.0, 1000.0))
    return rounded(spark.createDataFrame([(r["decay"], r["alpha"], r["corr"]) for r in rows], "decay double, alpha double, corr double"))


@query("I15")
def feature_group_ablation(spark, sf_dir):
    stats = M.ridge_stats(_panel(spark, sf_dir), "y", COLS, "fold")
    rows = M.ablation(stats, {"lines": ["f1", "f2"], "noise": ["f4"]}, [10.0])
    return rounded(spark.createDataFrame([(r["variant"], r["columns"], r["score"], r["delta"]) for r in rows], "variant string, columns int, score double, delta double"))


@query("I14")
def penalty_random_search(spark, sf_dir):
    stats = M.ridge_stats(_panel(spark, sf_dir), "y", COLS, "fold")
    trials, _ = M.random_search(lambda p: stats.solve([p["alpha"]], COLS[: p["columns"]]).scores[p["alpha"]], {"alpha": ("log", 0.1, 1e4), "columns": ("int", 1, 4)}, 12, "maximize")
    return rounded(spark.createDataFrame([(t["trial"], t["params"], t["score"]) for t in trials], "trial int, params string, score double"))


def _small_gbt():
    return M.gbt({"maxIter": 5, "maxDepth": 3})


def _default_gbt():
    """Default rounds and depth. With Spark's default tolerance of one hundredth the second tree, shrunk to a twentieth, already ends
    the fit; here a fit goes on as long as the held-out fold gains."""
    return M.gbt({"validationTol": 0.0})


@query("I6 I7")
def boosted_tree_cv(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return rounded(M.cross_validate(p, "y", COLS, "fold", _default_gbt).oof.select("id", "fold", "pred"))


@query("I7 D26")
def boosted_tree_importance(spark, sf_dir):
    res = M.cross_validate(_panel(spark, sf_dir), "y", COLS, "fold", _small_gbt)
    return rounded(spark.createDataFrame(list(res.importances.items()), "feature string, gain double"))


@query("I7 D20")
def boosted_classifier_cv(spark, sf_dir):
    p = _panel(spark, sf_dir).withColumns({"label": (F.col("y") > 300).cast("int"), "fold": F.col("fold") % 2})
    res = M.cross_validate(p, "label", COLS, "fold", lambda: M.gbt({"maxIter": 3, "maxDepth": 3}, "classification"), "classification", "auc")
    return rounded(res.oof.select("id", "label", "pred"))


# One level and one round: the first split of every fold's tree, which SQL finds by trying every value of every column.
@query(
    "I6 I7",
    """WITH x AS (SELECT o_orderkey AS id, (o_custkey % 5)::INTEGER AS fold, (o_totalprice / 1000 + (o_orderkey % 23) * 4)::DOUBLE AS y, (o_orderkey % 23)::DOUBLE AS a, CASE WHEN o_orderkey % 9 <> 2 THEN o_custkey % 7 END::DOUBLE AS b FROM orders),
         m AS (SELECT k, avg(y) AS mu FROM x, range(5) t(k) WHERE fold <> k GROUP BY k),
         u AS (SELECT k, y - mu AS r, unnest(['a', 'b']) AS c, unnest([a, b]) AS v FROM x JOIN m ON fold <> k),
         g AS (SELECT k, c, v, sum(r) AS s, count(*) AS n FROM u GROUP BY ALL),
         w AS (SELECT k, c, v, sum(s) OVER l AS gl, sum(n) OVER l AS nl, sum(s) OVER e AS gt, sum(n) OVER e AS nt FROM g WINDOW l AS (PARTITION BY k, c ORDER BY v NULLS FIRST), e AS (PARTITION BY k, c)),
         b AS (SELECT k, arg_max({'c': c, 'v': v, 'l': gl / nl, 'r': (gt - gl) / (nt - nl)}, gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl)) AS s FROM w WHERE nt > nl GROUP BY k)
       SELECT id, fold, round(mu + CASE WHEN coalesce((CASE WHEN s.c = 'a' THEN a ELSE b END) <= s.v, true) THEN s.l ELSE s.r END, 6) AS pred FROM x JOIN m ON fold = m.k JOIN b ON fold = b.k""",
)
def one_level_trees(spark, sf_dir):
    """One split for every fold, all from one scan."""
    key = F.col("o_orderkey")
    x = table(spark, sf_dir, "orders").select(
        key.alias("id"), (F.col("o_custkey") % 5).cast("int").alias("fold"), (F.col("o_totalprice").cast("double") / 1000 + key % 23 * 4).alias("y"),
        (key % 23).cast("double").alias("a"), F.when(key % 9 != 2, F.col("o_custkey") % 7).cast("double").alias("b"),
    )
    model = B.fit_folds(x, "y", ["a", "b"], "fold", B.Boosting(rounds=1, depth=1, rate=1.0, ridge=0.0, min_rows=1, patience=0))
    return rounded(model.oof().select("id", "fold", "pred"))


@query("I6 I7 D26")
def fold_shared_trees(spark, sf_dir):
    """All five folds boosted together with early stopping; held-out rows by the trees that did not see them, rows without a
    fold by the mean of all folds' trees, as test rows are."""
    p = _panel(spark, sf_dir).withColumn("fold", F.when(F.col("id") % 11 > 0, F.col("fold")))
    model = B.fit_folds(p.filter("fold IS NOT NULL"), "y", COLS, "fold", B.Boosting(rounds=8, depth=3, rate=0.3))
    test = model.predict(p.filter("fold IS NULL"))
    return rounded(model.oof().unionByName(test).select("id", "fold", "pred"))


@query("I6 I7 I10 D20")
def chained_tree_classifier(spark, sf_dir):
    """Log loss trees on expanding time folds: a fold learns from earlier rows alone."""
    p = time_series_split(_panel(spark, sf_dir).drop("fold").withColumn("label", (F.col("y") > 300).cast("int")), ["day", "id"], 4)
    model = B.fit_folds(p, "label", COLS, "fold", B.Boosting(rounds=6, depth=3, rate=0.3, classify=True), chained=True)
    return rounded(model.oof().select("id", "fold", "label", "pred"))


@query("I10 B3 B4 B5")
def cleaned_boosting(spark, sf_dir):
    p = _panel(spark, sf_dir).drop("fold").withColumns({"f5": F.col("f2") * 2 + 1, "one": F.lit(1.0)})
    res, keep = M.clean_train(p, "y", ["day", "id"], [*COLS, "f5", "one"], 4, 0.95, lambda: M.gbt({"maxIter": 3, "maxDepth": 3}), k=3)
    return rounded(res.oof.select("id", "fold", "pred").withColumn("features", F.lit(",".join(sorted(keep)))))


@query("I11 E24")
def time_slice_ensemble(spark, sf_dir):
    p = _panel(spark, sf_dir).drop("fold")

    def make(w):
        return LinearRegression(featuresCol="__features", labelCol="__label", weightCol=w, regParam=0.1)

    return rounded(M.time_slice_ensemble(p, "y", ["f2", "f4"], ["day", "id"], make, k=3).oof.select("id", "fold", "pred"))


@query("I12 E13 E14 E15 E16 L1")
def residual_boosting(spark, sf_dir):
    """Residual trees over entity features on top of the last known value."""
    e = entities(spark, sf_dir)
    f = W.rate_of_change(e, ["z", "gr"], "md", ["row_index"], ["entity"])
    f = W.centered_rolling(f, "gr", (5, 21), ["row_index"], ["entity"])
    f = W.gap_features(f, "seen", "md", ["row_index"], ["entity"])
    f = W.anchor_features(f, "seen", ["md", "z", "gr"], "entity", ["row_index"])
    rows = SQ.last_known(f, "seen", "entity", ["row_index"]).withColumn("fold", (F.col("entity") % 3).cast("int"))
    cols = ["md", "z", "gr", "z_rate", "gr_rate", "gr_cmean_5", "gr_cstd_5", "gr_cmean_21", "since_prev", "md_since_anchor", "prefix_mean", "prefix_std", "suffix_rows"]
    res = M.residual_cv(rows, "truth", "last_known", cols, "fold", lambda: GBTRegressor(featuresCol="__features", labelCol="__label", maxIter=3, maxDepth=3, seed=7))
    return rounded(res.oof.select("entity", "row_index", "fold", "pred"))


# ---------------------------------------------------------------- estimators, saved and loaded again


def _reloaded(spark, model):
    path = f"{scratch_root(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    back = type(model).load(path)
    delete_path(spark, path)
    return back


@query(
    "P-3 I8",
    """WITH li AS (SELECT l_orderkey AS id, sum(l_quantity) q, sum(l_extendedprice) p FROM lineitem GROUP BY 1),
         x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN (o_custkey % 5)::INTEGER END AS fold, o_totalprice / 1000 + q * 2 - p / 2000 AS y, CASE WHEN o_orderkey % 9 <> 2 THEN q END AS f1 FROM orders JOIN li ON li.id = o_orderkey),
         m AS (SELECT f AS fold, median(f1) AS med FROM x, range(5) t(f) WHERE fold <> f GROUP BY f),
         s AS (SELECT m.fold, med, avg(coalesce(f1, med)) AS mu, stddev_pop(coalesce(f1, med)) AS sd, avg(y) AS ym, count(*) AS n, covar_pop(coalesce(f1, med), y) AS c FROM x JOIN m ON x.fold <> m.fold GROUP BY m.fold, med)
       SELECT id, round(avg(ym + (coalesce(f1, med) - mu) / sd * (n * c / sd) / (n + 100)), 6) AS pred FROM x JOIN s ON x.fold IS NULL OR x.fold = s.fold GROUP BY id""",
)
def saved_ridge(spark, sf_dir):
    """Fitted on three quarters, saved, loaded: fitted rows by their fold's model, the others by the mean of all."""
    p = _panel(spark, sf_dir).withColumn("fold", F.when(F.col("id") % 4 != 0, F.col("fold")))
    fit = ES.FoldRidge(featureCols=["f1"], labelCol="y", predictionCol="pred", alphas=[100.0]).fit(p.filter("fold IS NOT NULL"))
    return rounded(_reloaded(spark, fit).transform(p).select("id", "pred"))


@query(
    "P-3 I6 I7",
    """WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 > 0 THEN (o_custkey % 5)::INTEGER END AS fold, (o_totalprice / 1000 + (o_orderkey % 23) * 4)::DOUBLE AS y, (o_orderkey % 23)::DOUBLE AS a, CASE WHEN o_orderkey % 9 <> 2 THEN o_custkey % 7 END::DOUBLE AS b FROM orders),
         m AS (SELECT k, avg(y) AS mu FROM x, range(5) t(k) WHERE fold <> k GROUP BY k),
         u AS (SELECT k, y - mu AS r, unnest(['a', 'b']) AS c, unnest([a, b]) AS v FROM x JOIN m ON fold <> k),
         g AS (SELECT k, c, v, sum(r) AS s, count(*) AS n FROM u GROUP BY ALL),
         w AS (SELECT k, c, v, sum(s) OVER l AS gl, sum(n) OVER l AS nl, sum(s) OVER e AS gt, sum(n) OVER e AS nt FROM g WINDOW l AS (PARTITION BY k, c ORDER BY v NULLS FIRST), e AS (PARTITION BY k, c)),
         b AS (SELECT k, arg_max({'c': c, 'v': v, 'l': gl / nl, 'r': (gt - gl) / (nt - nl)}, gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl)) AS s FROM w WHERE nt > nl GROUP BY k)
       SELECT id, round(avg(mu + CASE WHEN coalesce((CASE WHEN s.c = 'a' THEN a ELSE b END) <= s.v, true) THEN s.l ELSE s.r END), 6) AS pred FROM x JOIN m ON fold IS NULL OR fold = m.k JOIN b ON b.k = m.k GROUP BY id""",
)
def saved_trees(spark, sf_dir):
    """One split a fold, saved and loaded; rows that were not fitted take the mean over the folds."""
    key = F.col("o_orderkey")
    x = table(spark, sf_dir, "orders").select(
        key.alias("id"), F.when(key % 6 > 0, (F.col("o_custkey") % 5).cast("int")).alias("fold"), (F.col("o_totalprice").cast("double") / 1000 + key % 23 * 4).alias("y"),
        (key % 23).cast("double").alias("a"), F.when(key % 9 != 2, F.col("o_custkey") % 7).cast("double").alias("b"),
    )
    est = ES.FoldBoosting(featureCols=["a", "b"], labelCol="y", predictionCol="pred", rounds=1, depth=1, rate=1.0, ridge=0.0, min_rows=1, patience=0)
    return rounded(_reloaded(spark, est.fit(x.filter("fold IS NOT NULL"))).transform(x).select("id", "pred"))


@query(
    "P-3 J11",
    f"""WITH o AS (SELECT id, pa, pd, y, CASE WHEN id % 3 > 0 THEN fold END AS fold FROM {OOF_SQL}),
        w AS (SELECT f AS fold, least(greatest(sum((pd - pa) * (y - pa)) / sum((pd - pa) ** 2), 0), 1) AS w FROM o, range(5) t(f) WHERE fold <> f GROUP BY f
          UNION ALL SELECT NULL, least(greatest(sum((pd - pa) * (y - pa)) / sum((pd - pa) ** 2), 0), 1) FROM o WHERE fold IS NOT NULL)
        SELECT id, round((1 - w) * pa + w * pd, 6) AS stack FROM o JOIN w ON o.fold IS NOT DISTINCT FROM w.fold""",
)
def saved_stack(spark, sf_dir):
    """Weights of a fold from the others, of rows without one from all fitted rows."""
    o = oof(spark, sf_dir).withColumn("fold", F.when(F.col("id") % 3 > 0, F.col("fold")))
    fit = ES.FoldStack(featureCols=["pa", "pd"], labelCol="y", predictionCol="stack").fit(o)
    return rounded(_reloaded(spark, fit).transform(o).select("id", "stack"))


@query("P-3 I6 I8 J11")
def stacked_pipeline(spark, sf_dir):
    """Ridge and trees as streams of a stack: one pipeline, fitted on folds by customer, saved, loaded and applied to all rows."""
    p = cut_lineage(_panel(spark, sf_dir).withColumn("fold", F.when(F.col("id") % 4 != 0, F.col("fold"))))
    given = {"labelCol": "y", "foldCol": "fold"}
    stages = [
        ES.FoldRidge(featureCols=COLS, predictionCol="ridge", **given),
        ES.FoldBoosting(featureCols=COLS, predictionCol="trees", rounds=8, depth=3, rate=0.3, **given),
        ES.FoldStack(featureCols=["ridge", "trees"], predictionCol="pred", **given),
    ]
    fit = Pipeline(stages=stages).fit(p.filter("fold IS NOT NULL"))
    return rounded(_reloaded(spark, fit).transform(p).select("id", "fold", "ridge", "trees", "pred"))


@query("I14 P-3")
def halving_search(spark, sf_dir):
    """Trees and ridge with int, float, log and categorical parameters; the rungs raise the rounds of the trees."""
    p = cut_lineage(_panel(spark, sf_dir).select("fold", "y", *COLS))
    space = {"kind": ("choice", ["ridge", "trees", "trees"]), "alpha": ("log", 0.1, 1e4), "depth": ("int", 1, 4), "rate": ("float", 0.1, 0.5)}

    def score(s, rounds):
        if s["kind"] == "ridge":
            est = ES.FoldRidge(featureCols=COLS, labelCol="y", predictionCol="pred", alphas=[s["alpha"]])
        else:
            est = ES.FoldBoosting(featureCols=COLS, labelCol="y", predictionCol="pred", rounds=rounds, depth=s["depth"], rate=s["rate"])
        return get_metric("rmse")[0](est.fit(p).transform(p), "y", "pred").first()["value"]

    trials, _ = successive_halving(spark, score, space, 6, [2, 6])
    rows = [(t["trial"], t["params"], t["rung"], t["budget"], t["score"], t["kept"]) for t in trials]
    return rounded(spark.createDataFrame(rows, "trial int, params string, rung int, budget int, score double, kept boolean"))
