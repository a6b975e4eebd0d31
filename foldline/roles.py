"""Column roles and column kinds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Roles:
    """Names of the target, id, group and (total) order columns of a table."""

    target: str | None = None
    id: str | None = None
    group: str | None = None
    order: tuple[str, ...] = ()


def kind(dtype: T.DataType) -> str:
    """``numeric`` (booleans included), ``datetime`` or ``categorical``."""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return "numeric"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "categorical"


def columns_of_kind(df: DataFrame, wanted: str, k: int | None = None, exclude: Sequence[str] = ()) -> list[str]:
    """Columns of one kind in schema order, optionally only the first ``k``."""
    names = [f.name for f in df.schema.fields if kind(f.dataType) == wanted and f.name not in exclude]
    return names if k is None else names[:k]


def numeric_cols(df: DataFrame, k: int | None = None, exclude: Sequence[str] = ()) -> list[str]:
    """Strictly numeric columns (no booleans), the set feature generators work on."""
    names = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]
    return names if k is None else names[:k]


def categorical_cols(df: DataFrame, k: int | None = None, exclude: Sequence[str] = ()) -> list[str]:
    names = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in exclude
    ]
    return names if k is None else names[:k]


def find_col(names: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First column whose lower-cased name contains a candidate, candidates tried in order."""
    for needle in candidates:
        for name in names:
            if needle in name.lower():
                return name
    return None


def clean_float(col: Column) -> Column:
    """NaN and infinities become null."""
    c = col.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Map NaN to null in every floating column (null is the only missing value here)."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
