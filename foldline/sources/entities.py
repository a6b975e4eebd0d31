"""Folders with one CSV per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def entity_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """``(entity, path)`` of the files named ``<entity><suffix>``."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return listing.select(F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("entity"), "path")


def paired_entities(spark: SparkSession, folder: str, series_suffix: str, curve_suffix: str) -> DataFrame:
    """Full outer pairing of two file kinds; ``complete`` is false where one is missing."""
    a = entity_files(spark, folder, series_suffix).withColumnRenamed("path", "series_path")
    b = entity_files(spark, folder, curve_suffix).withColumnRenamed("path", "curve_path")
    return a.join(b, "entity", "full_outer").withColumn(
        "complete", F.col("series_path").isNotNull() & F.col("curve_path").isNotNull()
    )


def read_entities(spark: SparkSession, folder: str, suffix: str, schema: T.StructType) -> DataFrame:
    """All entity CSVs as one table, with ``entity`` from the file name and the 0-based ``row_index``.

    The CSV reader does not expose line positions, so a file is read whole (it is one bounded entity),
    split into lines and parsed; entities spread over tasks.
    """
    files = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    name = F.col("_metadata.file_name")
    text = F.split(F.regexp_replace("value", "\r", ""), "\n")
    lines = files.select(
        F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("entity"), _cells(F.element_at(text, 1)).alias("header"),
        F.posexplode(text).alias("line_no", "line"),
    ).filter((F.length("line") > 0) & (F.col("line_no") > 0))
    cells = lines.withColumn("cells", _cells(F.col("line")))

    def cell(field: T.StructField):
        at = F.array_position("header", field.name)
        raw = F.when(at > 0, F.try_element_at("cells", at.cast("int")))
        return F.when(F.length(F.trim(raw)) > 0, F.trim(raw)).try_cast(field.dataType).alias(field.name)

    return cells.select("entity", (F.col("line_no") - 1).cast("long").alias("row_index"), *[cell(f) for f in schema.fields])


def _cells(line: Column) -> Column:
    """Cells of one CSV line: commas inside quotes do not part them, doubled quotes stand for one."""
    raw = F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.transform(raw, lambda c: F.replace(F.regexp_replace(c, '^\\s*"(.*)"\\s*$', "$1"), F.lit('""'), F.lit('"')))
