"""Prediction files in template order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def submission_by_position(template: DataFrame, preds: DataFrame, pos: str, value: str) -> DataFrame:
    """Template ids with the predictions of the same position."""
    return template.join(preds.select(pos, value), pos, "left")


def submission_by_id(template: DataFrame, preds: DataFrame, id: str, pos: str, value: str) -> DataFrame:
    """Template ids in template positions with predictions looked up by id."""
    return template.select(id, pos).join(preds.select(id, value), id, "left")


def submission_audit(template: DataFrame, preds: DataFrame, id: str, value: str) -> DataFrame:
    """One row: template rows, duplicate ids on both sides, missing, surplus and non-finite values."""
    t = template.groupBy(id).agg(F.count("*").alias("nt"))
    p = preds.groupBy(id).agg(
        F.count("*").alias("np"),
        F.sum(F.when(F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 1).otherwise(0)).alias("bad"),
    )
    both = t.join(p, id, "full_outer")

    def count(cond):
        return F.coalesce(F.sum(cond.cast("long")), F.lit(0))

    return both.agg(
        F.coalesce(F.sum("nt"), F.lit(0)).alias("template_rows"),
        count(F.coalesce(F.col("nt") > 1, F.lit(False))).alias("duplicate_template_ids"),
        count(F.coalesce(F.col("np") > 1, F.lit(False))).alias("duplicate_prediction_ids"),
        count(F.col("np").isNull()).alias("missing_ids"),
        count(F.col("nt").isNull()).alias("surplus_ids"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("non_finite"),
    )


def write_submission(template: DataFrame, preds: DataFrame, id: str, pos: str, value: str, path: str) -> None:
    """Fail-closed CSV in template order: unique ids, full coverage, finite values.

    Files are range-sorted by position, so concatenating them gives template order.
    """
    audit = submission_audit(template, preds, id, value).first()
    broken = {k: v for k, v in audit.asDict().items() if k != "template_rows" and v}
    if broken:
        raise ValueError(f"prediction file refused: {broken}")
    ready = submission_by_id(template, preds, id, pos, value)
    ready.repartitionByRange(pos).sortWithinPartitions(pos).select(id, value).write.mode("errorifexists").csv(
        path, header=True
    )
