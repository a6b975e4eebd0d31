"""Choosing columns and rows: constants, correlation, clipping, masks, gates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.operators.moments import pair_correlation, pair_moments
from foldline.operators.profile import _long, corr_to_target
from foldline.operators.ranks import exact_quantiles
from foldline.roles import Roles


def without_target(df: DataFrame, roles: Roles, features: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a feature function that cannot see the target, then attach the target by id again."""
    built = features(df.drop(roles.target))
    return built.join(df.select(roles.id, roles.target), roles.id, "left")


def constant_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, constant)``: at most one value when null counts as a value; no distinct needed."""
    flags = {}
    for c in cols:
        x = F.col(c)
        one_value = F.coalesce(F.min(x) == F.max(x), F.lit(True)) & (F.count(x).isin(0) | (F.count(x) == F.count("*")))
        flags[c] = {"constant": one_value}
    return _long(df, flags)


def drop_constant(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    gone = [r["column"] for r in constant_columns(df, cols).filter("constant").collect()]
    return df.drop(*gone)


def top_corr_features(df: DataFrame, y: str, k: int, cols: Sequence[str] | None = None, always: Sequence[str] = ()) -> DataFrame:
    """The ``k`` columns with the largest absolute correlation, and the forced ones after them."""
    ranked = corr_to_target(df, y, cols).filter(F.col("corr").isNotNull())
    top = ranked.orderBy(F.abs("corr").desc(), "column").limit(k).withColumn("forced", F.lit(False))
    if not always:
        return top
    extra = ranked.filter(F.col("column").isin(*always)).withColumn("forced", F.lit(True)).join(top, "column", "left_anti")
    return top.unionByName(extra)


def correlated_columns(df: DataFrame, cols: Sequence[str], threshold: float) -> list[str]:
    """Columns with an earlier column (dropped or not) above the absolute correlation threshold.

    Each pair is judged on the rows in which both columns are present, over all rows in one scan; only the names of
    dropped columns come to the driver.
    """
    cols = list(cols)
    pairs = pair_moments(df.select(*cols), cols)
    gone = {r["j"] for r in pairs.filter(F.abs(pair_correlation()) > threshold).select("j").distinct().collect()}
    return [c for j, c in enumerate(cols) if j in gone]


def drop_correlated(df: DataFrame, cols: Sequence[str], threshold: float) -> list[str]:
    gone = set(correlated_columns(df, cols, threshold))
    return [c for c in cols if c not in gone]


def align_columns(df: DataFrame, cols: Sequence[str], fill: float = 0) -> DataFrame:
    """Exactly ``cols`` in order; absent ones are ``fill``, surplus ones go."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in cols])


def clip_quantile(df: DataFrame, col: str, lo: float, hi: float, ref: DataFrame | None = None, ref_col: str | None = None) -> DataFrame:
    """Clip to exact interpolated quantiles of the reference values."""
    base = ref if ref is not None else df
    q = exact_quantiles(base, ref_col or col, [lo, hi]).scalar()
    v = F.col(col).cast("double")
    return df.withColumn(col, F.when(v.isNotNull(), F.least(F.greatest(v, q[0]), q[1])))


def to_label(p: Column, threshold: float = 0.5, inclusive: bool = True) -> Column:
    """0/1 label of a probability."""
    return (p >= threshold if inclusive else p > threshold).cast("int")


def common_rows(oof: DataFrame, id: str, version: str, pred: str, versions: int, mask_zero: bool = False) -> DataFrame:
    """Ids that every version predicted; with ``mask_zero`` an exact 0 counts as missing."""
    valid = F.col(pred).isNotNull() & (F.abs(pred) > 1e-12 if mask_zero else F.lit(True))
    return oof.filter(valid).groupBy(id).agg(F.count_distinct(version).alias("__k")).filter(F.col("__k") == versions).select(id)


def gate(df: DataFrame, rules: Sequence[tuple[str, Column]], otherwise: str) -> DataFrame:
    """Status of each row: the first rule that holds."""
    status = F.lit(otherwise)
    for name, cond in reversed(list(rules)):
        status = F.when(cond, F.lit(name)).otherwise(status)
    return df.withColumn("status", status)


def select_safe(scan: DataFrame, metric: str, min_spearman: float, max_rank_delta: float) -> DataFrame:
    """Best candidate that stays close to the anchor; raises when none does."""
    best = (
        scan.filter((F.col("spearman_to_anchor") >= min_spearman) & (F.col("mean_rank_delta_to_anchor") <= max_rank_delta))
        .orderBy(F.desc(metric), F.desc("spearman_to_anchor"))
        .limit(1)
    )
    if best.isEmpty():
        raise ValueError("no candidate passes the anchor safety limits")
    return best


def non_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count of null, NaN and infinite values per column."""
    bad = {}
    for c in cols:
        x = F.col(c).cast("double")
        bad[c] = {"non_finite": F.sum((x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).cast("long"))}
    return _long(df, bad)


def assert_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    broken = non_finite(df, cols).filter("non_finite > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r['column']}: {r['non_finite']} non-finite" for r in broken))
    return df


def prune_features(importance: DataFrame, feature: str, gain: str) -> DataFrame:
    """Features with a non-zero mean importance."""
    return importance.groupBy(feature).agg(F.avg(gain).alias(gain)).filter(F.col(gain) > 0)


def feature_union(*lists: DataFrame) -> DataFrame:
    """Distinct union of feature lists."""
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out.distinct()
