"""Candidate predictions in rank space: blends around an anchor and distances to failed references."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.functions.scalar import soft_clip01
from foldline.operators.ensemble import segment_stats
from foldline.operators.metrics import BALANCED_COMPOSITE
from foldline.operators.moments import scalar_stats
from foldline.operators.ranks import rank_normalize
from foldline.session import cut_lineage, discard


def rank_columns(df: DataFrame, id: str, cols: Sequence[str]) -> DataFrame:
    """Rank-normalise many columns in one ranking job: long form, ranked per column, and back to wide."""
    cols = list(cols)
    typed = df.select(id, *[F.col(c).cast("double").alias(c) for c in cols])
    long = typed.unpivot([id], cols, "__version", "__value")
    ranked = rank_normalize(long, "__value", ["__version"], "__rank")
    picks = [F.max(F.when(F.col("__version") == c, F.col("__rank"))).alias(c) for c in cols]
    return ranked.groupBy(id).agg(*picks)


def _named(values: dict[str, Column], name: str = "candidate", value: str = "value") -> Column:
    return F.array(*[F.struct(F.lit(k).alias(name), v.alias(value)) for k, v in values.items()])


def candidate_pairs(ranks: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Spearman and mean absolute rank delta of every column pair, in one aggregate over the rows."""
    cols = list(cols)
    cells = [
        F.struct(
            F.lit(a).alias("left"), F.lit(b).alias("right"), F.corr(a, b).alias("spearman"),
            (F.avg(F.abs(F.col(a) - F.col(b))) / 2).alias("mean_rank_delta"),
        )
        for i, a in enumerate(cols)
        for b in cols[i + 1 :]
    ]
    return ranks.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def compare_candidates(preds: DataFrame, id: str, cols: Sequence[str]) -> DataFrame:
    return candidate_pairs(rank_columns(preds, id, cols), cols)


def geometry_score(preds: DataFrame, id: str, candidates: Sequence[str], anchor: str, failed: Sequence[str], local: DataFrame | None = None) -> DataFrame:
    """Closeness to the anchor, distance from failed references and local score as one number.

    ``local`` may hold ``(candidate, local_score)``.
    """
    ranks = rank_columns(preds, id, [*dict.fromkeys([*candidates, anchor, *failed])])
    cells = [
        F.struct(
            F.lit(c).alias("candidate"), F.corr(anchor, c).alias("spearman_to_anchor"),
            (F.avg(F.abs(F.col(anchor) - F.col(c))) / 2).alias("rank_delta_to_anchor"),
            F.array(*[F.corr(f, c) for f in failed]).alias("to_failed"),
        )
        for c in candidates
    ]
    out = ranks.agg(F.array(*cells).alias("r")).select(F.inline("r"))
    n = len(failed)
    out = out.withColumns(
        {
            "max_spearman_to_failed": F.array_max("to_failed") if n else F.lit(0.0),
            "mean_spearman_to_failed": F.aggregate("to_failed", F.lit(0.0), lambda a, x: a + x) / n if n else F.lit(0.0),
        }
    ).drop("to_failed")
    if local is not None:
        out = out.join(local.select("candidate", "local_score"), "candidate", "left")
    else:
        out = out.withColumn("local_score", F.lit(None).cast("double"))
    bonus = F.coalesce(soft_clip01(F.col("local_score"), 0.123, 0.030), F.lit(0.0))
    out = out.withColumn("local_bonus", F.when(F.col("local_score").isNull(), 0.0).otherwise(bonus))
    score = (
        0.50 * F.col("spearman_to_anchor") + 0.25 * (1 - F.col("max_spearman_to_failed"))
        + 0.15 * (1 - F.col("rank_delta_to_anchor")) + 0.10 * F.col("local_bonus")
    )
    return out.withColumn("geometry_score", score)


def anti_failed(preds: DataFrame, id: str, anchor: str, failed: Sequence[str], weights: Sequence[Sequence[float]]) -> DataFrame:
    """Long ``(id, candidate, pred)``: anchor ranks pushed away from failed ones and ranked again.

    A weight list has one entry per failed reference; a single entry applies to the first.
    """
    made = _anti_failed(rank_columns(preds, id, [anchor, *failed]), id, anchor, failed, weights)
    return made.select(id, "candidate", "pred")


def _anti_failed(ranks: DataFrame, id: str, anchor: str, failed: Sequence[str], weights: Sequence[Sequence[float]]) -> DataFrame:
    """The candidates beside the ranks that they were made from."""
    specs = {}
    for ws in weights:
        name = f"beta{round(ws[0] * 1000):03d}" if len(ws) == 1 else "w" + "_".join(f"{round(w * 1000):03d}" for w in ws)
        push = [float(w) * (F.col(anchor) - F.col(f)) for w, f in zip(ws, failed)]
        specs[name] = reduce(lambda a, b: a + b, push, F.col(anchor))
    return rank_normalize(ranks.select(id, anchor, *failed, F.inline(_named(specs))), "value", ["candidate"], "pred")


def anti_failed_report(preds: DataFrame, id: str, anchor: str, failed: Sequence[str], weights: Sequence[Sequence[float]]) -> DataFrame:
    """Per extrapolated candidate its rank correlation with the anchor and every failed reference."""
    made = _anti_failed(rank_columns(preds, id, [anchor, *failed]), id, anchor, failed, weights)
    return made.groupBy("candidate").agg(
        F.corr("pred", anchor).alias("spearman_to_anchor"),
        (F.avg(F.abs(F.col("pred") - F.col(anchor))) / 2).alias("mean_rank_delta"),
        *[F.corr("pred", f).alias(f"spearman_to_failed_{i + 1}") for i, f in enumerate(failed)],
    )


def anchor_blend_scan(
    oof: DataFrame,
    preds: DataFrame,
    id: str,
    order: Sequence[str],
    y: str,
    anchor_weights: dict[str, float],
    groups: dict[str, Sequence[str]],
    alphas: Sequence[float],
    anchor: str,
    failed: str | None = None,
    min_spearman: float = 0.99,
    max_rank_delta: float = 0.035,
    failed_threshold: float = 0.935,
    risk_penalty: float = 0.60,
) -> DataFrame:
    """Blend each group into the anchor over a grid and weigh the gain against the move in rank space.

    Correlations of all blends come from one set of segment statistics; only the re-ranking of the
    blended predictions touches rows again, all candidates in one job.
    """
    versions = list(dict.fromkeys([*anchor_weights, *[v for vs in groups.values() for v in vs]]))
    segments = ["full", "tail20", "tail10", "tail5"]
    used = [*dict.fromkeys([*versions, anchor, *([failed] if failed else [])])]
    # out-of-fold rows that are the predictions, too, are ranked once; ranks are read several times
    ranks = cut_lineage(rank_columns(preds, id, used))
    own = ranks.select(id, *versions) if preds is oof else rank_columns(oof, id, versions)
    ranked_oof = cut_lineage(own.join(oof.select(id, *[c for c in order if c != id], y), id))
    stats = segment_stats(ranked_oof, order, y, versions, segments)
    discard(ranked_oof)
    unit = {v: np.eye(len(versions))[i] for i, v in enumerate(versions)}
    total = sum(anchor_weights.values())
    base = sum(unit[v] * (w / total) for v, w in anchor_weights.items())
    made, rows = {}, []
    for g, members in groups.items():
        mean = sum(unit[v] for v in members) / len(members)
        blend = reduce(lambda a, b: a + b, [F.col(v) for v in members]) / len(members)
        for alpha in alphas:
            key = f"{g}@{alpha:g}"
            made[key] = (1 - alpha) * F.col(anchor) + alpha * blend
            w = (1 - alpha) * base + alpha * mean
            s = {name: float(st.pearson(w)[0]) for name, st in stats.items()}
            s["ts_fold5"] = s["tail20"]
            comp = sum(share * s[name] for name, share in BALANCED_COMPOSITE.items())
            rows.append((key, g, "+".join(members), float(alpha), *[s[c] for c in [*segments, "ts_fold5"]], comp))
    cols = ["key", "group", "models", "alpha", *segments, "ts_fold5", "composite"]
    ddl = "key string, group string, models string, alpha double, " + ", ".join(f"{c} double" for c in cols[4:])
    scores = oof.sparkSession.createDataFrame(rows, ddl)
    extra = [F.col(anchor).alias("__anchor"), (F.col(failed) if failed else F.lit(None).cast("double")).alias("__failed")]
    long = ranks.select(id, *extra, F.inline(_named(made, "key")))
    moved = rank_normalize(long, "value", ["key"], "rank")
    shape = moved.groupBy("key").agg(
        F.corr("rank", "__anchor").alias("spearman_to_anchor"),
        (F.corr("rank", "__failed") if failed else F.lit(None).cast("double")).alias("spearman_to_failed"),
        (F.avg(F.abs(F.col("rank") - F.col("__anchor"))) / 2).alias("mean_rank_delta_to_anchor"),
    )
    out = scores.join(shape, "key").withColumns(
        {
            "failed_excess": F.greatest(F.coalesce(F.col("spearman_to_failed") - failed_threshold, F.lit(0.0)), F.lit(0.0)),
            "anchor_shortfall": F.greatest(F.lit(min_spearman) - F.col("spearman_to_anchor"), F.lit(0.0)),
            "rank_delta_excess": F.greatest(F.col("mean_rank_delta_to_anchor") - max_rank_delta, F.lit(0.0)),
        }
    )
    utility = (
        F.col("composite") - risk_penalty * F.col("failed_excess") - 0.35 * F.col("anchor_shortfall") - 0.90 * F.col("rank_delta_excess")
    )
    return out.withColumn("utility", utility).drop("key")


def diagnostics_to_reference(preds: DataFrame, id: str, cols: Sequence[str], reference: str) -> DataFrame:
    """Spearman and mean rank shift (as a share of n - 1) of candidates against a reference submission."""
    cols = list(cols)
    ranks = rank_columns(preds, id, [*dict.fromkeys([*cols, reference])])
    n = scalar_stats(ranks, n=F.count("*").cast("double"))["n"]
    cells = [
        F.struct(
            F.lit(c).alias("candidate"), F.corr(c, reference).alias("spearman"),
            F.avg(F.abs(F.col(c) - F.col(reference))).alias("gap"),
        )
        for c in cols
    ]
    out = ranks.agg(F.array(*cells).alias("r")).select(F.inline("r"))
    return out.select("candidate", "spearman", (F.col("gap") / 2 * n / (n - 1)).alias("mean_rank_delta"))
