"""Registry of checked queries: name -> Spark callable, optional SQL, survey rows covered."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODULES = (
    "q_sources",
    "q_profile",
    "q_features",
    "q_series",
    "q_metrics",
    "q_folds",
    "q_ensemble",
    "q_joins",
    "q_audit",
    "q_ledger",
    "q_spatial",
    "q_sequence",
    "q_models",
)


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register a function under its own name; ``covers`` names the survey rows it exercises."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        if fn.__name__ in _QUERIES:
            raise ValueError(f"duplicate query {fn.__name__}")
        _QUERIES[fn.__name__] = Query(fn.__name__, covers, fn, sql)
        return fn

    return keep


def load() -> dict[str, Query]:
    for module in MODULES:
        if importlib.util.find_spec(f"foldline.plans.{module}"):
            importlib.import_module(f"foldline.plans.{module}")
    return dict(_QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that summation order does not show."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in doubles}) if doubles else df


def sql_rounded(inner: str, keep: str, doubles: list[str], digits: int = 6) -> str:
    """The SQL twin of :func:`rounded`."""
    cols = ", ".join(f"round({c}, {digits}) AS {c}" for c in doubles)
    keep = f"{keep}, " if keep else ""
    return f"SELECT {keep}{cols} FROM ({inner}) AS q_"
