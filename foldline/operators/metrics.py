"""Prediction metrics, grouped by any columns, with their direction; segments and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.operators.moments import shift_to_means
from foldline.operators.ranks import average_rank, exact_quantiles
from foldline.operators.series import null_safe_join, ordered_positions

EPS = 2.220446049250313e-16


def _pair(df: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    return df.select(*by, F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p")).dropna(subset=["y", "p"])


def _agg(df: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    agg = value.alias("value")
    return df.groupBy(*by).agg(agg) if by else df.agg(agg)


def _simple(expr: Callable[[Column, Column], Column]):
    def run(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
        return _agg(_pair(df, y, p, by), by, expr(F.col("y"), F.col("p")))

    return run


rmse = _simple(lambda y, p: F.sqrt(F.avg((y - p) * (y - p))))
mse = _simple(lambda y, p: F.avg((y - p) * (y - p)))
mae = _simple(lambda y, p: F.avg(F.abs(y - p)))
r2 = _simple(lambda y, p: 1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)))


def _pearson_expr(y: Column, p: Column) -> Column:
    spread = (F.stddev_pop(y) > 0) & (F.stddev_pop(p) > 0)
    return F.coalesce(F.when(spread, F.nanvl(F.corr(y, p), F.lit(0.0))), F.lit(0.0))


pearson = _simple(_pearson_expr)


def _clipped_loss(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return -F.avg(y * F.log(q) + (1 - y) * F.log1p(-q))


log_loss = _simple(_clipped_loss)

# Scores that never exceed 1 are probabilities and become labels above one half.
accuracy = _simple(
    lambda y, p: F.when(F.max(p) <= 1, F.avg((y == (p > 0.5).cast("double")).cast("double"))).otherwise(
        F.avg((y == p).cast("double"))
    )
)


def macro_f1(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of per-class F1 over the classes seen on either side, from confusion counts."""
    by = list(by)
    pairs = _pair(df, y, p, by)
    top = pairs.groupBy(*by).agg(F.max("p").alias("__top"))
    pairs = null_safe_join(pairs, top, by) if by else pairs.withColumn("__top", pairs.agg(F.max("p")).scalar())
    label = F.when(F.col("__top") <= 1, (F.col("p") > 0.5).cast("double")).otherwise(F.col("p"))
    cells = pairs.groupBy(*by, "y", label.alias("l")).agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("said")),
        F.struct(F.col("l").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("said")),
    )
    hit = F.when((F.col("y") == F.col("l")) & (F.col("actual") > 0), F.col("actual")).otherwise(0)
    per_class = (
        cells.select(*by, "y", "l", F.inline(sides))
        .groupBy(*by, "c")
        .agg(F.sum(hit).alias("tp"), F.sum("actual").alias("actual"), F.sum("said").alias("said"))
    )
    f1 = F.coalesce(F.try_divide(F.col("tp") * 2.0, (F.col("actual") + F.col("said")).cast("double")), F.lit(0.0))
    return _agg(per_class.withColumn("f1", f1), by, F.avg("f1"))


def auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from average ranks; null with one class only."""
    ranked = average_rank(_pair(df, y, p, by), "p", by, "r")
    pos = F.sum(F.col("y"))
    neg = F.sum(1 - F.col("y"))
    area = F.try_divide(F.sum(F.when(F.col("y") == 1, F.col("r"))) - pos * (pos + 1) / 2, pos * neg)
    return _agg(ranked, by, area)


def spearman(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    ranked = average_rank(average_rank(_pair(df, y, p, by), "y", by, "ry"), "p", by, "rp")
    return _agg(ranked, by, _pearson_expr(F.col("ry"), F.col("rp")))


METRICS: dict[str, tuple[Callable[..., DataFrame], str]] = {
    "rmse": (rmse, "minimize"),
    "mae": (mae, "minimize"),
    "mse": (mse, "minimize"),
    "accuracy": (accuracy, "maximize"),
    "auc": (auc, "maximize"),
    "log_loss": (log_loss, "minimize"),
    "logloss": (log_loss, "minimize"),
    "f1": (macro_f1, "maximize"),
    "pearson": (pearson, "maximize"),
    "weighted_pearson": (pearson, "maximize"),
    "spearman": (spearman, "maximize"),
    "r2": (r2, "maximize"),
}


def get_metric(name: str) -> tuple[Callable[..., DataFrame], str]:
    """Metric function and ``minimize`` / ``maximize``."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name}; known: {', '.join(METRICS)}")
    return METRICS[name]


def better(a: float | None, b: float | None, direction: str) -> bool:
    """Whether score ``a`` beats ``b``; a missing score is worse than any."""
    if a is None:
        return False
    if b is None:
        return True
    return a > b if direction == "maximize" else a < b


def metric_table(df: DataFrame, names: Sequence[str], y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Long ``(by..., metric, value)``."""
    parts = [get_metric(n)[0](df, y, p, by).select(*by, F.lit(n).alias("metric"), "value") for n in names]
    return reduce(DataFrame.unionByName, parts)


def fold_summary(scores: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population std of fold scores."""
    aggs = [F.avg(value).alias("mean_score"), F.stddev_pop(value).alias("std_score"), F.count("*").alias("folds")]
    return scores.groupBy(*by).agg(*aggs) if by else scores.agg(*aggs)


def pooled_rmse(details: DataFrame, keys: Sequence[str], sse: str, rows: str, error: str | None = None) -> DataFrame:
    """Pooled RMSE per configuration from squared error and row sums, with failure counts.

    Rows of a failure without a squared error do not count as predicted: they would lower the RMSE.
    """
    scored = F.when(F.col(sse).isNotNull(), F.col(rows)).otherwise(0)
    aggs = [F.sum(sse).alias("squared_error"), F.sum(scored).alias("rows")]
    if error:
        aggs.append(F.count(error).alias("failures"))
    out = details.groupBy(*keys).agg(*aggs)
    return out.withColumn("rmse", F.sqrt(F.try_divide(F.col("squared_error"), F.col("rows").cast("double"))))


def compare_by_entity(oof: DataFrame, entity: str, y: str, a: str, b: str) -> DataFrame:
    """Rows, squared errors and RMSE of two candidates per entity, and the difference b - a."""
    err = lambda p: (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))
    out = oof.groupBy(entity).agg(F.count("*").alias("rows"), F.sum(err(a)).alias("sse_a"), F.sum(err(b)).alias("sse_b"))
    out = out.withColumns({"rmse_a": F.sqrt(F.col("sse_a") / F.col("rows")), "rmse_b": F.sqrt(F.col("sse_b") / F.col("rows"))})
    return out.withColumn("delta", F.col("rmse_b") - F.col("rmse_a"))


def comparison_summary(per_entity: DataFrame, probs: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Pooled RMSE of both candidates, improved / worsened entities and delta quantiles."""
    q = exact_quantiles(per_entity, "delta", probs).scalar()
    out = per_entity.agg(
        F.count("*").alias("entities"),
        F.sqrt(F.sum("sse_a") / F.sum("rows")).alias("rmse_a"),
        F.sqrt(F.sum("sse_b") / F.sum("rows")).alias("rmse_b"),
        F.sum((F.col("delta") < 0).cast("long")).alias("better"),
        F.sum((F.col("delta") > 0).cast("long")).alias("worse"),
    )
    return out.withColumns({f"delta_p{round(p * 100)}": q[i] for i, p in enumerate(probs)})


def decile_report(oof: DataFrame, progress: str, y: str, a: str, b: str, bins: int = 10) -> DataFrame:
    """Per progress bin: RMSE of both candidates, gain, and the through-origin shrink from a to b."""
    decile = F.least(F.floor(F.col(progress) * bins), F.lit(bins - 1)).cast("long")
    d = F.col(b) - F.col(a)
    r = F.col(y) - F.col(a)
    out = oof.groupBy(decile.alias("decile")).agg(
        F.count("*").alias("rows"),
        F.sqrt(F.avg(r * r)).alias("rmse_a"),
        F.sqrt(F.avg((F.col(y) - F.col(b)) * (F.col(y) - F.col(b)))).alias("rmse_b"),
        F.try_divide(F.sum(d * r), F.sum(d * d)).alias("slope"),
    )
    return out.withColumn("gain", F.col("rmse_a") - F.col("rmse_b"))


def coverage(oof: DataFrame, y: str, p: str, sd: str, widths: Sequence[float] = (1.0, 2.0), by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose absolute error is within k standard deviations."""
    e = F.abs(F.col(y) - F.col(p))
    aggs = [F.avg((e <= k * F.col(sd)).cast("double")).alias(f"within_{k:g}_sd") for k in widths]
    aggs.append(F.avg(sd).alias("mean_sd"))
    return oof.groupBy(*by).agg(*aggs) if by else oof.agg(*aggs)


def rescore(oof: DataFrame, manifest: DataFrame, entity: str, fold: str, y: str, p: str) -> DataFrame:
    """RMSE of locked predictions on another fold assignment: one row per fold and one overall (fold null)."""
    e = (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))
    per_fold = oof.drop(fold).join(manifest.select(entity, fold), entity).groupBy(fold).agg(F.sum(e).alias("sse"), F.count("*").alias("rows"))
    total = per_fold.agg(F.sum("sse").alias("sse"), F.sum("rows").alias("rows"))
    both = per_fold.unionByName(total.withColumn(fold, F.lit(None).cast(per_fold.schema[fold].dataType)))
    return both.select(fold, "rows", F.sqrt(F.col("sse") / F.col("rows")).alias("rmse"))


# ---------------------------------------------------------------- time segments


def segment_bounds(n: int, names: Sequence[str]) -> dict[str, tuple[int, int]]:
    """Position ranges of named segments: ``full``, ``tailNN`` (last NN %), ``ts_foldK`` of six blocks."""
    out = {}
    for name in names:
        if name == "full":
            out[name] = (0, n)
        elif name.startswith("tail"):
            out[name] = (int(n * (1 - int(name[4:]) / 100)), n)
        elif name.startswith("ts_fold"):
            k, size = int(name[7:]), n // 6
            out[name] = (size * k, size * (k + 1) if k < 5 else n)
        else:
            raise ValueError(f"unknown segment {name}")
    return out


def banded(df: DataFrame, order: Sequence[str], bounds: dict[str, tuple[int, int]]) -> tuple[DataFrame, dict[str, list[int]]]:
    """Number rows by disjoint bands between all segment edges; overlapping segments are sets of bands.

    Statistics add over bands, so no row is copied into several segments.
    """
    edges = sorted({e for lo_hi in bounds.values() for e in lo_hi})
    placed = ordered_positions(df, order, out="__pos")
    band = reduce(lambda a, b: a + b, [(F.col("__pos") >= e).cast("int") for e in edges])
    members = {
        name: [i + 1 for i, e in enumerate(edges) if lo <= e < hi] for name, (lo, hi) in bounds.items()
    }
    return placed.withColumn("band", band).drop("__pos"), members


def segment_scores(df: DataFrame, order: Sequence[str], y: str, preds: Sequence[str], segments: Sequence[str]) -> DataFrame:
    """Long ``(segment, version, rows, coverage, corr)`` of wide prediction columns in time order."""
    preds = list(preds)
    lean = shift_to_means(df.select(*order, y, *preds), [y, *preds])
    bounds = segment_bounds(lean.count(), segments)
    rows, members = banded(lean, order, bounds)
    t = F.col(y)

    def sums(c: str) -> Column:
        ok = F.col(c).isNotNull() & t.isNotNull()
        s = lambda e: F.sum(F.when(ok, e))
        v = F.col(c)
        return F.struct(
            F.lit(c).alias("version"), F.count("*").alias("all"), F.sum(ok.cast("long")).alias("n"), s(t).alias("sy"),
            s(v).alias("sp"), s(t * t).alias("syy"), s(v * v).alias("spp"), s(t * v).alias("syp"),
        )

    per_band = rows.groupBy("band").agg(F.array(*[sums(c) for c in preds]).alias("r")).select("band", F.inline("r"))
    of_band: dict[int, list[str]] = {}
    for name, bands in members.items():
        for b in bands:
            of_band.setdefault(b, []).append(name)
    names = F.create_map(*[x for b, ns in of_band.items() for x in (F.lit(b), F.array(*[F.lit(n) for n in ns]))])
    spread = per_band.withColumn("segment", F.explode(F.element_at(names, F.col("band"))))
    parts = ["all", "n", "sy", "sp", "syy", "spp", "syp"]
    total = spread.groupBy("segment", "version").agg(*[F.sum(c).alias(c) for c in parts])
    n = F.col("n")
    cov = F.col("syp") - F.col("sy") * F.col("sp") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    vp = F.col("spp") - F.col("sp") * F.col("sp") / n
    return total.select(
        "segment", "version", n.alias("rows"), (n / F.col("all")).alias("coverage"),
        F.when((vy > 0) & (vp > 0), cov / F.sqrt(vy * vp)).alias("corr"),
    )


# Weights of the two composite scores.
TAIL_COMPOSITE = {"ts_fold5": 0.35, "tail10": 0.25, "tail20": 0.20, "full": 0.20}
BALANCED_COMPOSITE = {"full": 0.45, "tail20": 0.20, "tail10": 0.15, "tail5": 0.10, "ts_fold5": 0.10}


def composite(scores: DataFrame, weights: dict[str, float], by: Sequence[str] = ("version",)) -> DataFrame:
    """Weighted sum of segment scores."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return scores.groupBy(*by).agg(F.sum(F.try_element_at(w, F.col("segment")) * F.col("corr")).alias("composite"))


def late_summary(scores: DataFrame) -> DataFrame:
    """Mean and minimum over the tail segments, and the gap of the mean to the full score."""
    late = F.when(F.col("segment").startswith("tail"), F.col("corr"))
    out = scores.groupBy("version").agg(
        F.avg(late).alias("late_mean"), F.min(late).alias("late_min"), F.max(F.when(F.col("segment") == "full", F.col("corr"))).alias("full")
    )
    return out.withColumn("gap", F.col("full") - F.col("late_mean"))


def importance_summary(imp: DataFrame, feature: str, gain: str) -> DataFrame:
    """Mean importance per feature, and its stability ``std / max(mean, 1e-10)`` across folds."""
    out = imp.groupBy(feature).agg(F.avg(gain).alias("mean"), F.stddev_pop(gain).alias("std"))
    return out.withColumn("instability", F.col("std") / F.greatest(F.col("mean"), F.lit(1e-10)))


def importance_concentration(summary: DataFrame, k: int = 5) -> DataFrame:
    """Share of the top ``k`` features in the total, and the number of unused ones."""
    top = summary.orderBy(F.desc("mean")).limit(k).agg(F.sum("mean")).scalar()
    return summary.agg(
        F.sum("mean").alias("total"), F.sum((F.col("mean") == 0).cast("long")).alias("unused"), F.count("*").alias("features")
    ).withColumn("top_share", F.try_divide(top, F.col("total")))


def compare_models(scores: DataFrame, name: str, score: str, seq: str, direction: str = "minimize", tol: float = 1e-6) -> DataFrame:
    """Models from best to worst, with ``plateau`` when the last three runs moved less than ``tol``.

    The plateau looks at three rows only; ranking is a distributed sort with positions.
    """
    last = scores.orderBy(F.desc(seq)).limit(3).agg((F.max(score) - F.min(score)).alias("d"), F.count("*").alias("n"))
    flat = last.select((F.col("n") == 3) & (F.col("d") < tol)).scalar()
    key = F.col(score) if direction == "minimize" else -F.col(score)
    ranked = ordered_positions(scores.withColumn("__key", key), ["__key", name], out="place")
    advice = (
        F.when(flat, "plateau: change the approach")
        .when(F.col("place") == 0, "keep as reference")
        .otherwise("compare with the best")
    )
    return ranked.drop("__key").withColumns({"plateau": flat, "advice": advice})


def candidate_summary(df: DataFrame, candidate: str, pred: str) -> DataFrame:
    """Rows, missing values and moments of each candidate's predictions."""
    p = F.col(pred)
    return df.groupBy(candidate).agg(
        F.count("*").alias("rows"), F.sum(p.isNull().cast("long")).alias("missing"), F.avg(p).alias("mean"),
        F.stddev_pop(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max"),
    )


def suffix_counts(df: DataFrame, value: str, entity: str) -> DataFrame:
    """Observed and missing rows per entity."""
    return df.groupBy(entity).agg(F.count(value).alias("observed"), F.sum(F.col(value).isNull().cast("long")).alias("scored_rows"))


def evidence_average(
    paths: DataFrame, keys: Sequence[str], row: str, ll: str, pred: str, last: str, scales: Sequence[float], holds: Sequence[float]
) -> DataFrame:
    """Softmax-weighted mean of alternative paths per scale, then a pull toward the last value per hold.

    The maximum log likelihood per key is a combined aggregate, and the grid is exploded on the
    averaged rows only.
    """
    keys = list(keys)
    top = paths.groupBy(*keys).agg(F.max(ll).alias("__top"))
    rows = null_safe_join(paths, top, keys)
    wanted = []
    for i, s in enumerate(scales):
        w = F.exp((F.col(ll) - F.col("__top")) / float(s))
        wanted.append((F.sum(w * F.col(pred)) / F.sum(w)).alias(f"__m{i}"))
    mean = rows.groupBy(*keys, row).agg(*wanted, F.max(last).alias("__last"))
    grid = F.array(
        *[
            F.struct(
                F.lit(float(s)).alias("scale"), F.lit(float(h)).alias("hold"),
                ((1 - h) * F.col(f"__m{i}") + h * F.col("__last")).alias("pred"),
            )
            for i, s in enumerate(scales)
            for h in holds
        ]
    )
    return mean.select(*keys, row, F.inline(grid))


