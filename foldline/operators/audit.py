"""Validation findings and leakage audits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.operators.digests import row_differences
from foldline.operators.joins import same_ids, same_order
from foldline.operators.series import CHUNK_ROWS, bounded_frames
from foldline.roles import kind


def validate_submission(sub: DataFrame, template: DataFrame, order_sub: Sequence[str], order_template: Sequence[str]) -> DataFrame:
    """Findings ``(severity, rule, detail)`` of a prediction table against its template; none if valid.

    The order columns only carry the file position and take no part in the column comparison.
    """
    hide = set(order_sub) | set(order_template)
    cols_s = [c for c in sub.columns if c not in hide]
    cols_t = [c for c in template.columns if c not in hide]
    id = cols_t[0]
    spark = sub.sparkSession
    findings = []

    def found(severity: str, rule: str, detail: str) -> None:
        findings.append((severity, rule, detail))

    if cols_s != cols_t:
        found("error", "columns", f"expected {cols_t}, got {cols_s}")
    preds = [c for c in cols_t[1:] if c in cols_s and kind(sub.schema[c].dataType) == "numeric"]
    aggs: list[Column] = [F.count("*").alias("rows")]
    aggs += [F.sum(F.col(c).isNull().cast("long")).alias(f"null:{c}") for c in cols_s]
    for c in preds:
        x = F.col(c).cast("double")
        aggs += [
            F.sum((F.abs(x) == float("inf")).cast("long")).alias(f"inf:{c}"),
            F.max((F.abs(x) > 1e10).cast("int")).alias(f"big:{c}"),
        ]
    stats = sub.agg(*aggs).first().asDict()
    rows_t = template.count()
    if stats["rows"] != rows_t:
        found("error", "rows", f"expected {rows_t}, got {stats['rows']}")
    nulls = [c for c in cols_s if stats[f"null:{c}"]]
    if nulls:
        found("error", "nulls", ",".join(nulls))
    if id in cols_s:
        gone = same_ids(sub, template, id).first()
        if gone["only_a"] or gone["only_b"]:
            found("error", "ids", f"{gone['only_a'] or 0} unknown, {gone['only_b'] or 0} missing")
        elif same_order(sub, template, id, order_sub, order_template).first()["mismatches"]:
            found("warning", "id_order", id)
        if sub.groupBy(id).count().filter("count > 1").limit(1).count():
            found("error", "duplicate_ids", id)
    for c in preds:
        if stats[f"big:{c}"]:
            found("warning", "extreme", c)
        if stats[f"inf:{c}"]:
            found("error", "infinity", c)
    return spark.createDataFrame(findings, "severity string, rule string, detail string")


def is_valid(findings: DataFrame) -> bool:
    return findings.filter("severity = 'error'").isEmpty()


def target_independence(features: Callable[[DataFrame], DataFrame], df: DataFrame, perturbed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Feature rows that change when only the target changes (should be none)."""
    a, b = features(df).select(*keep), features(perturbed).select(*keep)
    return row_differences(a, b)


def prefix_suffix_report(
    df: DataFrame, value: str, coord: str, entity: str, order: Sequence[str], min_prefix: int = 1, finite: Sequence[str] = (),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Per entity, whether one observed prefix is followed by one missing suffix along a rising coordinate."""

    def steps(w):
        return {
            "__step": F.col(coord) - F.lag(coord, 1).over(w),
            "__flip": F.col(value).isNull() != F.lag(F.col(value).isNull(), 1).over(w),
        }

    key = F.struct(*[F.col(c) for c in order])
    rows = bounded_frames(df, [steps], order, [entity], before=1, chunk_rows=chunk_rows)
    bad = [F.max(F.isnan(F.col(c).cast("double")) | F.col(c).isNull() | (F.abs(F.col(c).cast("double")) == float("inf"))) for c in finite]
    out = rows.groupBy(entity).agg(
        F.count(value).alias("prefix_rows"),
        F.sum(F.col(value).isNull().cast("long")).alias("suffix_rows"),
        F.coalesce(F.sum(F.col("__flip").cast("long")), F.lit(0)).alias("switches"),
        F.min_by(F.col(value).isNull(), key).alias("starts_missing"),
        F.coalesce(F.min("__step"), F.lit(1.0)).alias("min_step"),
        (reduce(lambda a, b: a | b, bad) if bad else F.lit(False)).alias("non_finite"),
    )
    ok = (
        (F.col("prefix_rows") >= min_prefix) & (F.col("suffix_rows") > 0) & (F.col("switches") == 1)
        & ~F.col("starts_missing") & (F.col("min_step") > 0) & ~F.col("non_finite")
    )
    return out.withColumn("ok", ok)


def assert_prefix_suffix(df: DataFrame, value: str, coord: str, entity: str, order: Sequence[str], min_prefix: int = 1) -> DataFrame:
    broken = prefix_suffix_report(df, value, coord, entity, order, min_prefix).filter(~F.col("ok")).count()
    if broken:
        raise ValueError(f"{broken} entities break the prefix / suffix contract")
    return df


def audit_fold_isolation(used: DataFrame, donor: str, donor_fold: str, query: str, query_fold: str, outer_fold: str) -> DataFrame:
    """One row: neighbours that are the query itself or come from its fold or the outer fold."""
    return used.agg(
        F.count("*").alias("pairs"),
        F.sum((F.col(donor) == F.col(query)).cast("long")).alias("self_pairs"),
        F.sum((F.col(donor_fold) == F.col(query_fold)).cast("long")).alias("same_fold_pairs"),
        F.sum((F.col(donor_fold) == F.col(outer_fold)).cast("long")).alias("outer_fold_pairs"),
    )


def incomplete_grids(summary: DataFrame, entity: str, fold: str, candidate: str) -> DataFrame:
    """Entities that lack a candidate, carry one twice, or appear in several folds."""
    total = summary.agg(F.count_distinct(candidate)).scalar()
    per = summary.groupBy(entity).agg(
        F.count_distinct(candidate).alias("candidates"), F.count("*").alias("rows"), F.count_distinct(fold).alias("folds")
    )
    return per.filter((F.col("candidates") != total) | (F.col("rows") != F.col("candidates")) | (F.col("folds") != 1))


def assert_complete_grid(summary: DataFrame, entity: str, fold: str, candidate: str) -> DataFrame:
    if not incomplete_grids(summary, entity, fold, candidate).isEmpty():
        raise ValueError("candidate grid is incomplete")
    return summary


def audit_fits(supports: DataFrame, fit: str, support: str, verified: str, feasible: str, expected: int) -> DataFrame:
    """Per fit: supports attempted, distinct ones, feasible ones that failed verification, and the verdict."""
    out = supports.groupBy(fit).agg(
        F.count("*").alias("attempted"), F.count_distinct(support).alias("distinct_supports"),
        F.sum((F.col(feasible) & ~F.col(verified)).cast("long")).alias("unverified"),
    )
    return out.withColumn("ok", (F.col("attempted") == expected) & (F.col("distinct_supports") == expected) & (F.col("unverified") == 0))


def boundary_entities(diagnostics: DataFrame, selection: DataFrame, fold: str, candidate: str, entity: str, flag: str) -> DataFrame:
    """Entities whose selected candidate ended at the edge of its lattice."""
    chosen = diagnostics.join(selection.select(fold, candidate), [fold, candidate], "left_semi")
    return chosen.filter(F.col(flag)).select(fold, entity).distinct()


def unequal_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only."""
    return row_differences(a, b)
