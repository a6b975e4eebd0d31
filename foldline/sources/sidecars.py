"""JSON sidecars: type inference and score lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where a candidate's local score is looked up, most preferred first.
SCORE_KEYS = (
    "scores.utility",
    "scores.composite",
    "scores.eval_corr",
    "scores.full_common_corr",
    "oof_pearson",
    "mean_score",
    "local_cv_score",
)


def infer_json(df: DataFrame, col: str) -> DataFrame:
    """One row with the merged structure of a JSON text column (partial and final merge)."""
    return df.agg(F.schema_of_variant_agg(F.try_parse_json(col)).alias("structure"))


def pick_score(meta: Column) -> tuple[Column, Column]:
    """Value and name of the first score present in a JSON text."""
    found = [(key, F.get_json_object(meta, f"$.{key}").try_cast("double")) for key in SCORE_KEYS]
    value = F.coalesce(*[v for _, v in found])
    source = reduce(
        lambda acc, kv: F.when(kv[1].isNotNull(), F.lit(kv[0])).otherwise(acc),
        reversed(found),
        F.lit(None).cast("string"),
    )
    return value, source
