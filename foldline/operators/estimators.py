"""Estimators and models of ``pyspark.ml`` for what this library fits over folds: ridge, boosted trees and simplex stacks.

One fitted model holds a part per fold. ``transform`` gives a row of a fitted fold the prediction of the part that did not see
it, and every other row (no fold, a fold that was not fitted, or no fold column at all) that of all parts, so a training table
gets its out-of-fold column and a test table its predictions from the same call. Columns may be predictions of earlier stages of
a :class:`pyspark.ml.Pipeline`. What is saved depends on the parameters and columns, never on the number of rows: parameters and small
values as JSON, coefficients and tree nodes as Parquet.
"""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.operators.boosting import Boosting, FoldTrees, Tree, fit_folds
from foldline.operators.ensemble import SimplexFit, nested_stack, weighted_sum
from foldline.operators.models import RidgeModel, RidgeResult, ridge_cv
from foldline.session import discard


class _FoldParams(HasLabelCol, HasPredictionCol):
    featureCols = Param(Params._dummy(), "featureCols", "numeric input columns", TypeConverters.toListString)
    foldCol = Param(Params._dummy(), "foldCol", "integer fold of a row, null for none", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction", foldCol="fold")

    def _inputs(self) -> tuple[str, list[str], str]:
        return self.getLabelCol(), list(self.getOrDefault("featureCols")), self.getOrDefault("foldCol")


class _FoldEstimator(Estimator, _FoldParams, DefaultParamsWritable, DefaultParamsReadable):
    def _hand_over(self, model: _FoldModel) -> _FoldModel:
        return self._copyValues(model.setParent(self) if hasattr(model, "setParent") else model)


class _FoldModel(Model, _FoldParams, MLWritable, MLReadable):
    """``TABLES`` names the written tables: ``_tables`` gives rows and schema of each, ``_restore`` takes the rows back."""

    TABLES: tuple[str, ...] = ()

    def _importances(self) -> dict[str, float]:
        raise NotImplementedError

    def feature_importance(self, spark: SparkSession) -> DataFrame:
        """``(feature, importance)``, highest first."""
        rows = sorted(self._importances().items(), key=lambda kv: (-kv[1], kv[0]))
        return spark.createDataFrame(rows, "feature string, importance double")

    def _by_fold(self, df: DataFrame, parts: dict, rest) -> DataFrame:
        """``parts[f]`` for rows of fold ``f``, ``rest`` for all others."""
        out, fold = rest, self.getOrDefault("foldCol")
        if fold in df.columns:
            for f, part in parts.items():
                out = F.when(F.col(f"`{fold}`") == F.lit(f), part).otherwise(out)
        return df.withColumn(self.getPredictionCol(), out)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: _FoldModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"state": self.instance._state()})
        for name, (rows, schema) in self.instance._tables().items():
            self.sparkSession.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, cls: type[_FoldModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> _FoldModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession, f"{self.cls.__module__}.{self.cls.__name__}")
        model = self.cls()
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        model._restore(meta["state"], {n: self.sparkSession.read.parquet(f"{path}/{n}").collect() for n in self.cls.TABLES})
        return model


# ---------------------------------------------------------------- ridge


class FoldRidge(_FoldEstimator):
    """Ridge of the penalty with the best pooled out-of-fold correlation; nulls take the median of the training folds."""

    alphas = Param(Params._dummy(), "alphas", "penalties to choose from", TypeConverters.toListFloat)
    chained = Param(Params._dummy(), "chained", "train a fold on earlier folds alone", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, featureCols=None, labelCol=None, foldCol=None, predictionCol=None, alphas=None, chained=None):
        super().__init__()
        self._setDefault(alphas=[0.1, 1.0, 10.0, 100.0, 1000.0], chained=False)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> FoldRidgeModel:
        y, cols, fold = self._inputs()
        return self._hand_over(FoldRidgeModel(ridge_cv(dataset, y, cols, fold, self.getOrDefault("alphas"), self.getOrDefault("chained"))))


class FoldRidgeModel(_FoldModel):
    """One ridge a fold; rows outside the folds take the mean of all."""

    TABLES = ("coefficients",)

    def __init__(self, result: RidgeResult | None = None):
        super().__init__()
        self.result = result

    def _transform(self, dataset: DataFrame) -> DataFrame:
        parts = {f: m.expression() for f, m in self.result.models.items()}
        return self._by_fold(dataset, parts, sum(parts.values(), start=F.lit(0.0)) / len(parts))

    def _importances(self) -> dict[str, float]:
        models = list(self.result.models.values())
        return dict(zip(models[0].cols, map(float, np.mean([np.abs(m.coef) for m in models], axis=0))))

    def _state(self) -> dict:
        r = self.result
        return {"alpha": r.alpha, "scores": list(r.scores.items()), "fold_scores": list(r.fold_scores.items()), "intercepts": [(f, m.intercept) for f, m in r.models.items()]}

    def _tables(self) -> dict:
        rows = [(int(f), i, c, *map(float, v)) for f, m in self.result.models.items() for i, (c, *v) in enumerate(zip(m.cols, m.median, m.mean, m.std, m.coef))]
        return {"coefficients": (rows, "fold int, position int, column string, median double, mean double, std double, coef double")}

    def _restore(self, state: dict, tables: dict) -> None:
        models = {}
        for f, intercept in state["intercepts"]:
            rows = sorted((r for r in tables["coefficients"] if r["fold"] == f), key=lambda r: r["position"])
            models[f] = RidgeModel(tuple(r["column"] for r in rows), *(np.array([r[k] for r in rows]) for k in ("median", "mean", "std", "coef")), intercept)
        self.result = RidgeResult(state["alpha"], dict(map(tuple, state["scores"])), dict(map(tuple, state["fold_scores"])), models)


# ---------------------------------------------------------------- boosted trees


class FoldBoosting(_FoldEstimator):
    """Boosted histogram trees of all folds at once, each fold's own rows deciding when it stops."""

    rounds = Param(Params._dummy(), "rounds", "most trees of a fold", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of a tree", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "share of a tree's step", TypeConverters.toFloat)
    bins = Param(Params._dummy(), "bins", "bins of a column", TypeConverters.toInt)
    min_rows = Param(Params._dummy(), "min_rows", "fewest rows of a node", TypeConverters.toInt)
    ridge = Param(Params._dummy(), "ridge", "penalty of a leaf", TypeConverters.toFloat)
    patience = Param(Params._dummy(), "patience", "rounds without gain before a fold stops; 0: all rounds run and count", TypeConverters.toInt)
    classify = Param(Params._dummy(), "classify", "log loss on labels 0 and 1, predictions are probabilities", TypeConverters.toBoolean)
    chained = Param(Params._dummy(), "chained", "train a fold on earlier folds alone", TypeConverters.toBoolean)

    @keyword_only
    def __init__(
        self, *, featureCols=None, labelCol=None, foldCol=None, predictionCol=None, rounds=None, depth=None, rate=None, bins=None, min_rows=None, ridge=None,
        patience=None, classify=None, chained=None,
    ):
        super().__init__()
        self._setDefault(**asdict(Boosting()), chained=False)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> FoldBoostingModel:
        y, cols, fold = self._inputs()
        lean = dataset.select(*[F.col(f"`{c}`") for c in dict.fromkeys([y, fold, *cols])])
        trees = fit_folds(lean, y, cols, fold, Boosting(**{k: self.getOrDefault(k) for k in asdict(Boosting())}), self.getOrDefault("chained"))
        discard(trees.binned)
        trees.binned = None
        return self._hand_over(FoldBoostingModel(trees))


class FoldBoostingModel(_FoldModel):
    """Trees of every fold; rows outside the folds take the mean of all."""

    TABLES = ("nodes", "edges")

    def __init__(self, trees: FoldTrees | None = None):
        super().__init__()
        self.trees = trees

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fold = self.getOrDefault("foldCol")
        return self.trees.score(dataset.drop(self.getPredictionCol()), fold if fold in dataset.columns else None, self.getPredictionCol())

    def _importances(self) -> dict[str, float]:
        return self.trees.importances()

    def _state(self) -> dict:
        t = self.trees
        return {
            "cols": list(t.cols), "folds": list(t.folds), "start": t.start.tolist(), "params": asdict(t.params), "grown": [len(x) for x in t.trees], "losses": t.losses,
            "best": t.best, "gains": t.gains.tolist(),
        }

    def _tables(self) -> dict:
        rows = [
            (k, i, int(at), int(t.column[at]), int(t.last[at]), float(t.value[at]))
            for k, grown in enumerate(self.trees.trees) for i, t in enumerate(grown) for at in np.flatnonzero((t.column >= 0) | (t.value != 0))
        ]
        edges = [(i, e.tolist()) for i, e in enumerate(self.trees.edges)]
        return {"nodes": (rows, "part int, tree int, node int, column int, last int, value double"), "edges": (edges, "column int, edges array<double>")}

    def _restore(self, state: dict, tables: dict) -> None:
        p = Boosting(**state["params"])
        size = 2 ** (p.depth + 1) - 1
        trees = [[Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for _ in range(n)] for n in state["grown"]]
        for r in tables["nodes"]:
            t = trees[r["part"]][r["tree"]]
            t.column[r["node"]], t.last[r["node"]], t.value[r["node"]] = r["column"], r["last"], r["value"]
        edges = [np.array(r["edges"], dtype=float) for r in sorted(tables["edges"], key=lambda r: r["column"])]
        self.trees = FoldTrees(tuple(state["cols"]), edges, state["folds"], np.array(state["start"]), p, trees, state["losses"], state["best"], np.array(state["gains"]))


# ---------------------------------------------------------------- stack


class FoldStack(_FoldEstimator):
    """Exact simplex stack of prediction columns: a fold's weights come from the other folds, those of new rows from all."""

    @keyword_only
    def __init__(self, *, featureCols=None, labelCol=None, foldCol=None, predictionCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> FoldStackModel:
        y, cols, fold = self._inputs()
        known = dataset.filter(F.col(f"`{fold}`").isNotNull() & F.col(f"`{y}`").isNotNull())
        _, fits, final = nested_stack(known, y, cols, fold)
        return self._hand_over(FoldStackModel(fits, final))


class FoldStackModel(_FoldModel):
    """Weights of every fold and of new rows."""

    TABLES = ("weights",)

    def __init__(self, fits: dict[int, SimplexFit] | None = None, final: SimplexFit | None = None):
        super().__init__()
        self.fits, self.final = fits, final

    def _transform(self, dataset: DataFrame) -> DataFrame:
        def mix(fit):
            return weighted_sum(dict(zip(fit.streams, fit.weights)))

        return self._by_fold(dataset, {f: mix(fit) for f, fit in self.fits.items()}, mix(self.final))

    def _importances(self) -> dict[str, float]:
        return dict(zip(self.final.streams, map(float, self.final.weights)))

    def _all(self) -> list[tuple[int | None, SimplexFit]]:
        return [*self.fits.items(), (None, self.final)]

    def _state(self) -> dict:
        return {"fits": [(f, fit.sse, fit.rows, fit.support) for f, fit in self._all()]}

    def _tables(self) -> dict:
        rows = [(f, i, s, float(w)) for f, fit in self._all() for i, (s, w) in enumerate(zip(fit.streams, fit.weights))]
        return {"weights": (rows, "fold int, position int, stream string, weight double")}

    def _restore(self, state: dict, tables: dict) -> None:
        fits = {}
        for f, sse, n, support in state["fits"]:
            rows = sorted((r for r in tables["weights"] if r["fold"] == f), key=lambda r: r["position"])
            fits[f] = SimplexFit(tuple(r["stream"] for r in rows), np.array([r["weight"] for r in rows]), sse, n, support)
        self.final = fits.pop(None)
        self.fits = fits
