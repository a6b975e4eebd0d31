"""Connected components of a large graph in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.session import cut_lineage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b; longs); component is the smallest node that can be reached.

    Alternating large-star and small-star rounds: neighbours are never gathered, only their minimum is, and each
    round ends in a written table. The number of rounds grows with the logarithm of the longest path; running out of
    ``max_rounds`` raises. Loops and repeated edges do no harm; an empty graph gives no rows.
    """
    e = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = cut_lineage(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        )
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            star = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return star.union(star.select(F.col("component").alias("node"), "component").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
