"""Tables: reading by suffix, pruned reads, versioned and audited writes, reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldline.operators.series import ordered_positions
from foldline.roles import nan_to_null


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Parquet by suffix (or for a folder), CSV otherwise; NaN becomes null.

    CSV needs a schema: inference would read the data twice. ``columns`` prunes the scan.
    """
    if path.rstrip("/").endswith((".csv", ".csv.gz", ".txt")):
        if schema is None:
            raise ValueError(f"{path}: a CSV read needs an explicit schema")
        df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    else:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        df = reader.parquet(path)
    if columns is not None:
        df = df.select(*columns)
    return nan_to_null(df)


def common_columns(left: DataFrame, right: DataFrame, wanted: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """Columns present on both sides (in the order wanted) and the missing ones; metadata only."""
    wanted = list(wanted or left.columns)
    both = set(left.columns) & set(right.columns)
    return [c for c in wanted if c in both], [c for c in wanted if c not in both]


def head_sample(df: DataFrame, order: Sequence[str], n: int = 100_000) -> DataFrame:
    """First ``n`` rows in order together with the exact row count of the whole table."""
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).limit(n).withColumn("total_rows", total)


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast to double, unparsable text and absent columns become null."""
    have = set(df.columns)
    out = {c: F.col(c).try_cast("double") if c in have else F.lit(None).cast("double") for c in cols}
    return nan_to_null(df.withColumns(out))


def assert_schema(df: DataFrame, expected: T.StructType, exact: bool = False) -> DataFrame:
    """Raise unless every expected column is there once, with its type, and (``exact``) nothing else."""
    names = df.columns
    problems = [f"duplicate column {c}" for c in sorted({c for c in names if names.count(c) > 1})]
    types = {f.name: f.dataType for f in df.schema.fields}
    for field in expected.fields:
        if field.name not in types:
            problems.append(f"missing column {field.name}")
        elif types[field.name] != field.dataType:
            problems.append(
                f"column {field.name} is {types[field.name].simpleString()}, not {field.dataType.simpleString()}"
            )
    if exact:
        known = {f.name for f in expected.fields}
        problems += [f"unexpected column {c}" for c in names if c not in known]
    if problems:
        raise ValueError("; ".join(problems))
    return df


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, jvm


def next_version(spark: SparkSession, root: str) -> str:
    """``vNNN`` one above the highest version folder under ``root``."""
    fs, target, _ = _hadoop(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
    used = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
    return f"v{max(used, default=0) + 1:03d}"


def write_versioned(df: DataFrame, root: str) -> str:
    """Write parquet to the next version folder; an existing one is never touched."""
    path = f"{root.rstrip('/')}/{next_version(df.sparkSession, root)}"
    df.write.mode("errorifexists").parquet(path)
    return path


def publish(df: DataFrame, path: str, audit: Callable[[DataFrame], None] | None = None) -> str:
    """Write beside the target, audit what was written, then rename; never overwrites."""
    spark = df.sparkSession
    fs, target, jvm = _hadoop(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(staging)
    if audit is not None:
        audit(spark.read.parquet(staging))
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        raise FileExistsError(path)
    return path


def write_by_entity(df: DataFrame, path: str, entity: str, order: Sequence[str]) -> None:
    """Entities clustered and sorted inside zstd files; range partitioning splits a hot entity."""
    keys = [entity, *order]
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("errorifexists").option(
        "compression", "zstd"
    ).parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV, or strict JSON in which NaN is null and null fields are kept."""
    df = nan_to_null(df)
    if fmt == "csv":
        df.write.mode("errorifexists").csv(path, header=True)
    elif fmt == "json":
        df.write.mode("errorifexists").json(path, ignoreNullFields=False)
    else:
        raise ValueError(f"unknown report format {fmt}")


def tail_fraction(df: DataFrame, order: Sequence[str], fraction: float) -> DataFrame:
    """Latest ``fraction`` of the rows: positions from ``int(n * (1 - fraction))`` on."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    if fraction == 1:
        return df
    n = df.agg(F.count("*")).scalar()
    placed = ordered_positions(df, order, out="__pos")
    return placed.filter(F.col("__pos") >= F.floor(n * F.lit(1 - fraction))).drop("__pos")
