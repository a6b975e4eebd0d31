"""Fold assignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldline.operators import folds as FO
from foldline.plans.catalog import query, table
from foldline.plans.stand_ins import ENTITY_SQL, entities

_BLOCK = "CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1) ELSE n % 5 + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) END::INTEGER"


@query("I1", f"SELECT o_orderkey, {_BLOCK} AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)")
def kfold_contiguous(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return FO.kfold(o, 5, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "fold")


@query("I1", f"SELECT o_orderkey, {_BLOCK} AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || ':42'), o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)")
def kfold_shuffled(spark, sf_dir):
    return FO.kfold(table(spark, sf_dir, "orders").select("o_orderkey"), 5, id="o_orderkey", shuffle=True)


@query("I2", "SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || ':42'), o_orderkey) - 1) % 5)::INTEGER AS fold FROM orders")
def kfold_stratified(spark, sf_dir):
    return FO.stratified_kfold(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", 5, "o_orderkey")


_GREEDY = """WITH RECURSIVE g AS (SELECT {group} AS grp, {weight} AS w FROM {src} GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY w DESC, grp DESC) AS i FROM g),
    walk AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS grp, 0 AS fold, [0, 0, 0, 0]::BIGINT[] AS loads UNION ALL
      SELECT o.i, o.grp, list_position(loads, list_min(loads)), list_transform(loads, lambda l, j: l + CASE WHEN j = list_position(loads, list_min(loads)) THEN o.w ELSE 0 END)
      FROM walk JOIN o ON o.i = walk.i + 1)
    SELECT grp AS {group}, w AS {name}, fold::INTEGER AS fold FROM walk JOIN g USING (grp)"""


@query("I3 D16", _GREEDY.format(group="o_custkey", weight="count(*)", src="orders", name="n"))
def kfold_grouped(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return FO.group_kfold(counts, "o_custkey", "n", 4)


@query("I3", _GREEDY.format(group="entity", weight="count(*) - count(seen)", src=ENTITY_SQL, name="scored_rows"))
def kfold_grouped_by_scored_rows(spark, sf_dir):
    return FO.group_kfold(FO.suffix_counts_per_entity(entities(spark, sf_dir), "seen", "entity"), "entity", "scored_rows", 4)


@query(
    "I4",
    """SELECT o_orderkey, pos, CASE WHEN pos >= n - 5 * (n // 6) THEN ((pos - (n - 5 * (n // 6))) // (n // 6) + 1)::INTEGER END AS fold FROM
       (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)""",
)
def time_series_folds(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return FO.time_series_split(o, ["o_orderdate", "o_orderkey"], 5).drop("o_orderdate")


@query("I5", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey % 100 = 3 GROUP BY o_custkey")
def manifest_changes(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return FO.manifest_differences(m, m.filter("o_custkey % 100 <> 3"))
