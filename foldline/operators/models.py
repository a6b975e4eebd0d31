"""Models: closed-form ridge on sufficient statistics and cross-validated pyspark.ml estimators."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.operators.folds import kfold, time_series_split
from foldline.operators.metrics import get_metric, pearson
from foldline.operators.moments import collect_moments
from foldline.operators.quantiles import radix_quantiles, set_of
from foldline.operators.ranks import time_decay_weights
from foldline.operators.select import constant_columns, drop_correlated, top_corr_features
from foldline.operators.series import ordered_positions
from foldline.session import cut_lineage

# ---------------------------------------------------------------- ridge


@dataclass(frozen=True)
class RidgeModel:
    """Median, mean, std and coefficient per column, and the intercept."""

    cols: tuple[str, ...]
    median: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    coef: np.ndarray
    intercept: float

    def expression(self) -> Column:
        """Prediction as a column expression; nulls take the training median."""
        out = F.lit(float(self.intercept))
        for c, md, mu, sd, b in zip(self.cols, self.median, self.mean, self.std, self.coef):
            out = out + (F.coalesce(F.col(c).cast("double"), F.lit(float(md))) - float(mu)) * float(b / sd)
        return out


@dataclass
class RidgeResult:
    """Chosen penalty, pooled correlation per penalty, fold correlations and one model per fold."""

    alpha: float
    scores: dict[float, float]
    fold_scores: dict[int, float]
    models: dict[int, RidgeModel] = field(default_factory=dict)

    def oof(self, df: DataFrame, fold: str, out: str = "pred") -> DataFrame:
        """Out-of-fold predictions; rows without a fold stay null."""
        expr = F.lit(None).cast("double")
        for f, m in self.models.items():
            expr = F.when(F.col(fold) == F.lit(f), m.expression()).otherwise(expr)
        return df.withColumn(out, expr)

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """Mean of the fold models on new rows."""
        total = F.lit(0.0)
        for m in self.models.values():
            total = total + m.expression()
        return df.withColumn(out, total / len(self.models))


@dataclass
class RidgeStats:
    """Moments of ``[1, y, x with nulls as 0, null flags]`` per fold, and medians per training set.

    Any column subset and any penalty is solved from these without touching rows again.
    """

    y: str
    cols: tuple[str, ...]
    holes: tuple[str, ...]
    shift: dict[str, float]
    per_fold: dict
    train: dict
    medians: dict

    def _map(self, f: int, cols: Sequence[str]) -> np.ndarray:
        """Linear map from stored columns to ``[1, y, imputed x]`` under the medians of fold ``f``."""
        t = np.zeros((2 + len(cols), 2 + len(self.cols) + len(self.holes)))
        t[0, 0] = t[1, 1] = 1.0
        for i, c in enumerate(cols):
            t[2 + i, 2 + self.cols.index(c)] = 1.0
            if c in self.holes:
                t[2 + i, 2 + len(self.cols) + self.holes.index(c)] = self.medians[f][c] - self.shift[c]
        return t

    def solve(self, alphas: Sequence[float], cols: Sequence[str] | None = None) -> RidgeResult:
        cols = tuple(cols or self.cols)
        pooled = {a: np.zeros(6) for a in alphas}
        fold_r: dict[float, dict] = {a: {} for a in alphas}
        models: dict[float, dict] = {a: {} for a in alphas}
        for f, parts in self.train.items():
            m = sum(self.per_fold[b] for b in parts)
            t = self._map(f, cols)
            mt = t @ m @ t.T
            n = mt[0, 0]
            mean = mt[0, 1:] / n
            cov = mt[1:, 1:] / n - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov)[1:], 0.0))
            sd = np.where(sd > 1e-12 * np.maximum(np.abs(mean[1:]), 1e-12), sd, 1.0)
            xtx = n * cov[1:, 1:] / np.outer(sd, sd)
            xty = n * cov[0, 1:] / sd
            own = t @ self.per_fold[f] @ t.T
            for a in alphas:
                beta = np.linalg.solve(xtx + a * np.eye(len(cols)), xty)
                shift = np.array([self.shift[c] for c in cols])
                med = np.array([self.medians[f].get(c, 0.0) for c in cols])
                models[a][f] = RidgeModel(cols, med, mean[1:] + shift, sd, beta, float(mean[0] + self.shift[self.y]))
                w = np.concatenate([[mean[0] - float(beta / sd @ mean[1:])], beta / sd])
                v = np.delete(own, 1, axis=0)
                p, pp = float(w @ v[:, 0]), float(w @ np.delete(v, 1, axis=1) @ w)
                s = np.array([own[0, 0], own[0, 1], own[1, 1], p, pp, float(w @ v[:, 1])])
                fold_r[a][f] = _corr(s)
                pooled[a] += s
        scores = {a: _corr(s) for a, s in pooled.items()}
        best = max(scores, key=lambda a: scores[a])
        return RidgeResult(best, scores, fold_r[best], models[best])


def _corr(s: np.ndarray) -> float:
    n, y, yy, p, pp, py = s
    vy, vp = yy - y * y / n, pp - p * p / n
    return float((py - y * p / n) / np.sqrt(vy * vp)) if vy > 0 and vp > 0 else 0.0


def ridge_stats(df: DataFrame, y: str, cols: Sequence[str], fold: str, chained: bool = False, weight: str | None = None) -> RidgeStats:
    """One pass of moments per fold, plus exact medians of the columns that have nulls: eight scans for all columns and folds.

    Folds train on all other folds, or, ``chained``, on the rows of earlier folds and of no fold.
    """
    cols = tuple(cols)
    rows = df.filter(F.col(y).isNotNull()).select(F.coalesce(F.col(fold).cast("int"), F.lit(-1)).alias("__f"), y, *cols, *([weight] if weight else []))
    first = rows.agg(
        F.avg(F.col(y).cast("double")).alias(y), *[F.avg(F.col(c).cast("double")).alias(c) for c in cols],
        *[F.max(F.col(c).isNull()).alias(f"__null_{c}") for c in cols],
    ).first()
    shift = {c: float(first[c] or 0.0) for c in (y, *cols)}
    holes = tuple(c for c in cols if first[f"__null_{c}"])
    lean = rows.select(
        "__f", *([weight] if weight else []), (F.col(y).cast("double") - shift[y]).alias("z0"),
        *[F.coalesce(F.col(c).cast("double") - shift[c], F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(cols)],
        *[F.col(c).isNull().cast("double").alias(f"m{i}") for i, c in enumerate(holes)],
    )
    names = ["z0", *[f"x{i}" for i in range(len(cols))], *[f"m{i}" for i in range(len(holes))]]
    per_fold = {k[0]: m for k, (_, m) in collect_moments(lean, names, ["__f"], weight).items()}
    folds = sorted(f for f in per_fold if f >= 0)
    train = {f: [b for b in per_fold if (b < f if chained else b != f)] for f in folds}
    medians: dict[int, dict[str, float]] = {f: {} for f in folds}
    if holes:
        known = sorted(per_fold)
        q = radix_quantiles(rows.withColumn("__u", set_of(F.col("__f"), known)), holes, [0.5], "__u", [[known.index(b) for b in train[f]] for f in folds])
        medians = {f: {c: float(q[i, j, 0]) for j, c in enumerate(holes)} for i, f in enumerate(folds)}
    return RidgeStats(y, cols, holes, shift, per_fold, train, medians)


def ridge_cv(df: DataFrame, y: str, cols: Sequence[str], fold: str, alphas: Sequence[float], chained: bool = False, weight: str | None = None) -> RidgeResult:
    """Cross-validated ridge with the penalty of the best pooled out-of-fold correlation."""
    return ridge_stats(df, y, cols, fold, chained, weight).solve(alphas)


def weighted_ridge_probe(df: DataFrame, y: str, cols: Sequence[str], order: Sequence[str], decays: Sequence[float], alphas: Sequence[float], k: int = 5) -> list[dict]:
    """Recency-weighted ridge over a decay x penalty grid."""
    placed = kfold(df, k, order)
    out = []
    for d in decays:
        stats = ridge_stats(time_decay_weights(placed, d, order, "__w"), y, cols, "fold", weight="__w")
        out += [{"decay": float(d), "alpha": float(a), "corr": s} for a, s in stats.solve(alphas).scores.items()]
    return sorted(out, key=lambda r: -r["corr"])


def ablation(stats: RidgeStats, groups: Mapping[str, Sequence[str]], alphas: Sequence[float]) -> list[dict]:
    """Score change when a feature group is left out or used alone, from the same statistics."""
    full = stats.solve(alphas)
    base = full.scores[full.alpha]
    rows = [{"variant": "all", "columns": len(stats.cols), "score": base, "delta": 0.0}]
    for name, members in groups.items():
        for label, cols in ((f"without {name}", [c for c in stats.cols if c not in members]), (f"only {name}", [c for c in stats.cols if c in members])):
            if cols:
                r = stats.solve(alphas, cols)
                rows.append({"variant": label, "columns": len(cols), "score": r.scores[r.alpha], "delta": r.scores[r.alpha] - base})
    return rows


# ---------------------------------------------------------------- pyspark.ml estimators

# Defaults of the boosted trees.
GBT_DEFAULTS = {"maxIter": 50, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 20}


def gbt(params: Mapping | None = None, task: str = "regression", seed: int = 42, validation: str | None = "__valid", weight: str | None = None):
    """Gradient-boosted trees with early stopping on the rows flagged by ``validation``."""
    cls = GBTClassifier if task == "classification" else GBTRegressor
    est = cls(featuresCol="__features", labelCol="__label", seed=seed, **{**GBT_DEFAULTS, **(params or {})})
    if validation:
        est = est.setValidationIndicatorCol(validation)
    return est.setWeightCol(weight) if weight else est


def assemble(df: DataFrame, cols: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Feature vector of numeric columns, nulls filled."""
    filled = df.withColumns({f"__v_{i}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(fill)), F.lit(fill)) for i, c in enumerate(cols)})
    names = [f"__v_{i}" for i in range(len(cols))]
    return VectorAssembler(inputCols=names, outputCol="__features").transform(filled).drop(*names)


def _probability(df: DataFrame, task: str) -> Column:
    return vector_to_array("probability")[1] if task == "classification" else F.col("prediction")


@dataclass
class CvResult:
    """Out-of-fold rows, one score per fold, models and mean importances."""

    oof: DataFrame
    fold_scores: dict[int, float]
    models: dict[int, Model]
    importances: dict[str, float]
    mean: float
    std: float

    def predict(self, df: DataFrame, cols: Sequence[str], id: str, task: str = "regression", out: str = "pred") -> DataFrame:
        """Predictions on new rows averaged over the fold models, all applied to one scan of the rows."""
        ready = assemble(df, cols)
        keep = [*df.columns, "__features"]
        total = None
        for i, m in enumerate(self.models.values()):
            ready = m.transform(ready).withColumn(f"__p{i}", _probability(ready, task)).select(*keep, f"__p{i}")
            keep.append(f"__p{i}")
        for i in range(len(self.models)):
            total = F.col(f"__p{i}") if total is None else total + F.col(f"__p{i}")
        return ready.select(*df.columns, (total / len(self.models)).alias(out))


def cross_validate(
    df: DataFrame, y: str, cols: Sequence[str], fold: str, make: Callable[[], object], task: str = "regression", metric: str = "rmse",
    chained: bool = False, out: str = "pred",
) -> CvResult:
    """Fit per fold on its training rows with its own rows as validation set; union the held-out predictions.

    ``chained`` trains fold ``f`` on rows of earlier folds and of no fold.
    """
    # every fold's fit, its score and the result read the rows again: made and written once
    df = cut_lineage(df)
    ready = assemble(df, cols).withColumn("__label", F.col(y).cast("double"))
    folds = sorted(r[fold] for r in df.select(fold).distinct().collect() if r[fold] is not None)
    parts, scores, models, gains = None, {}, {}, np.zeros(len(cols))
    for f in folds:
        held = F.col(fold) == F.lit(f)
        learn = (F.col(fold).isNull() | (F.col(fold) < F.lit(f))) if chained else (F.col(fold).isNull() | ~held)
        both = ready.filter(learn | held).withColumn("__valid", held & F.col(fold).isNotNull())
        est = make()
        uses_flag = est.hasParam("validationIndicatorCol") and est.isSet("validationIndicatorCol")
        model = est.fit(both if uses_flag else both.filter(~F.col("__valid")))
        done = model.transform(ready.filter(held))
        done = done.withColumn(out, _probability(done, task)).select(*df.columns, out)
        scores[f] = float(get_metric(metric)[0](done, y, out).first()["value"])
        models[f] = model
        if hasattr(model, "featureImportances"):
            gains += model.featureImportances.toArray() / len(folds)
        parts = done if parts is None else parts.unionByName(done)
    values = np.array(list(scores.values()))
    return CvResult(parts, scores, models, dict(zip(cols, map(float, gains))), float(values.mean()), float(values.std()))


def clean_train(df: DataFrame, y: str, order: Sequence[str], cols: Sequence[str], top_k: int, threshold: float, make, k: int = 5) -> tuple[CvResult, list[str]]:
    """Drop constant columns, keep the best correlated, drop near duplicates, then boost on chained folds."""
    gone = {r["column"] for r in constant_columns(df, cols).filter("constant").collect()}
    ranked = [r["column"] for r in top_corr_features(df, y, top_k, [c for c in cols if c not in gone]).collect()]
    keep = drop_correlated(df, ranked, threshold)
    split = time_series_split(df.select(*dict.fromkeys([*order, y, *keep])), order, k)
    return cross_validate(split, y, keep, "fold", make, metric="pearson", chained=True), keep


@dataclass
class SliceEnsemble:
    """Blended out-of-fold rows, the score of every slice and which blend was kept."""

    oof: DataFrame
    slice_scores: dict[str, float]
    weights: dict[str, float]
    mode: str
    score: float


SLICES = {"full_data": 0.0, "last_75pct": 0.25, "last_50pct": 0.5}


def time_slice_ensemble(
    df: DataFrame, y: str, cols: Sequence[str], order: Sequence[str], make: Callable[[str], object], decay: float = 0.95, k: int = 5, slices: Mapping[str, float] = SLICES
) -> SliceEnsemble:
    """Models on the full history and its latest parts with decaying weights, blended by their correlation.

    Rows before a slice take the prediction of the full slice. ``make(weight)`` returns an estimator.
    """
    # every fit and every score reads the placed rows again: sorted and written once
    ready = assemble(cut_lineage(ordered_positions(kfold(df, k, order), order)), cols).withColumn("__label", F.col(y).cast("double"))
    n = ready.count()
    cut = {s: int(share * n) for s, share in slices.items()}
    held_parts = None
    for f in range(k):
        held = ready.filter(F.col("fold") == f)
        for s, c in cut.items():
            share = F.pow(F.lit(float(decay)), 1 - (F.col("pos") - c) / float(max(n - c - 1, 1)))
            learn = ready.filter((F.col("fold") != f) & (F.col("pos") >= c)).withColumn("__w", share)
            if learn.isEmpty():
                held = held.withColumn(f"__{s}", F.lit(None).cast("double"))
                continue
            est = make("__w")
            model = est.fit(learn)
            got = model.transform(held).withColumn(f"__{s}", F.when(F.col("pos") >= c, F.col("prediction")))
            held = got.drop("prediction", "rawPrediction")
        held_parts = held if held_parts is None else held_parts.unionByName(held)
    base = next(s for s, share in slices.items() if share == 0)
    filled = held_parts.withColumns({f"__{s}": F.coalesce(f"__{s}", f"__{base}") for s in slices})
    filled = cut_lineage(filled.select(*dict.fromkeys([*df.columns, "fold", *[f"__{s}" for s in slices]])))
    scores = {s: float(pearson(filled, y, f"__{s}").first()["value"]) for s in slices}
    total = sum(max(v, 0.0) for v in scores.values())
    weights = {s: (max(v, 0.0) / total if total > 0 else 1 / len(scores)) for s, v in scores.items()}
    mix = lambda ws: sum((F.lit(float(w)) * F.col(f"__{s}") for s, w in ws.items()), start=F.lit(0.0))
    both = filled.withColumns({"__simple": mix({s: 1 / len(scores) for s in scores}), "__weighted": mix(weights)})
    simple, weighted = (float(pearson(both, y, c).first()["value"]) for c in ("__simple", "__weighted"))
    mode = "weighted_slices" if weighted >= simple else "simple_slices"
    pick = "__weighted" if weighted >= simple else "__simple"
    return SliceEnsemble(both.select(*df.columns, "fold", F.col(pick).alias("pred")), scores, weights, mode, max(simple, weighted))


def residual_cv(df: DataFrame, y: str, baseline: str, cols: Sequence[str], fold: str, make: Callable[[], object], out: str = "pred") -> CvResult:
    """Boost what a baseline leaves over; the prediction is baseline plus residual, or the baseline alone."""
    rows = df.withColumn("__residual", F.col(y) - F.col(baseline))
    res = cross_validate(rows, "__residual", cols, fold, make, out="__r")
    done = res.oof.withColumn(out, F.col(baseline) + F.coalesce("__r", F.lit(0.0))).drop("__r", "__residual")
    return CvResult(done, res.fold_scores, res.models, res.importances, res.mean, res.std)


# ---------------------------------------------------------------- parameter search


def sample_params(space: Mapping[str, tuple], n: int, seed: int = 42) -> list[dict]:
    """Random settings: ``("int", lo, hi)``, ``("float", lo, hi)``, ``("log", lo, hi)`` or ``("choice", values)``."""
    rng = np.random.default_rng(seed)

    def draw(kind: str, *args):
        if kind == "int":
            return int(rng.integers(args[0], args[1] + 1))
        if kind == "float":
            return float(rng.uniform(*args))
        if kind == "log":
            return float(np.exp(rng.uniform(np.log(args[0]), np.log(args[1]))))
        if kind == "choice":
            return args[0][int(rng.integers(len(args[0])))]
        raise ValueError(f"unknown parameter kind {kind}")

    return [{k: draw(*v) for k, v in space.items()} for _ in range(n)]


def random_search(score: Callable[[dict], float], space: Mapping[str, tuple], n: int, direction: str, seed: int = 42) -> tuple[list[dict], dict]:
    """Score sampled settings; returns the trials best first and a summary over their scores."""
    trials = [{"trial": i, "params": json.dumps(p, sort_keys=True), "score": float(score(p))} for i, p in enumerate(sample_params(space, n, seed))]
    trials.sort(key=lambda t: t["score"], reverse=direction == "maximize")
    s = np.array([t["score"] for t in trials])
    return trials, {"best": trials[0]["score"], "worst": trials[-1]["score"], "mean": float(s.mean()), "std": float(s.std()), "trials": n}
