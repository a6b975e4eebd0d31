"""Tables derived from the given ones that play predictions, entities and ledgers in the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldline.plans.catalog import table

# Out-of-fold predictions: orders in date order, price as target, four streams of varying quality.
OOF_SQL = """(SELECT o_orderkey AS id, o_custkey AS entity, o_orderdate AS day, (o_custkey % 5)::INTEGER AS fold, o_totalprice / 1000 AS y,
    o_totalprice / 1000 * 0.9 + (o_orderkey % 97) / 2.0 AS pa, o_totalprice / 1000 * 0.5 + (o_custkey % 53) * 3.0 AS pb,
    200 + (o_orderkey % 1009) / 10.0 AS pc, o_totalprice / 1000 * 0.7 - (o_orderkey % 31) * 4.0 AS pd FROM orders)"""


def oof(spark, sf_dir):
    price, key, cust = F.col("o_totalprice") / 1000, F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), cust.alias("entity"), F.col("o_orderdate").alias("day"), (cust % 5).cast("int").alias("fold"), price.alias("y"),
        (price * 0.9 + (key % 97) / 2.0).alias("pa"), (price * 0.5 + (cust % 53) * 3.0).alias("pb"),
        (200 + (key % 1009) / 10.0).alias("pc"), (price * 0.7 - (key % 31) * 4.0).alias("pd"),
    )


STREAMS = ("pa", "pb", "pc", "pd")

LONG_SQL = " UNION ALL ".join(f"SELECT id, entity, day, fold, y, '{c}' AS version, {c} AS pred FROM {OOF_SQL}" for c in STREAMS)


def oof_long(spark, sf_dir):
    return oof(spark, sf_dir).unpivot(["id", "entity", "day", "fold", "y"], list(STREAMS), "version", "pred")


# Entities: users' events in time order, the last 40 % of each user's values hidden.
ENTITY_SQL = """(SELECT user_id AS entity, pos AS row_index, (pos * 1.0 + (event_id % 3) * 0.25)::DOUBLE AS md, value AS truth, (-0.25 * pos)::DOUBLE AS z,
    CASE WHEN event_id % 11 <> 0 THEN 40 + value / 10 END AS gr, CASE WHEN pos < floor(n * 0.6) THEN value END AS seen
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events))"""


def entities(spark, sf_dir):
    from foldline.operators.series import positions

    ev = positions(table(spark, sf_dir, "events"), ["ts", "event_id"], ["user_id"])
    ev = ev.join(ev.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")
    return ev.select(
        F.col("user_id").alias("entity"), F.col("pos").alias("row_index"), (F.col("pos") * 1.0 + (F.col("event_id") % 3) * 0.25).alias("md"),
        F.col("value").alias("truth"), (F.col("pos") * -0.25).alias("z"),
        F.when(F.col("event_id") % 11 != 0, 40 + F.col("value") / 10).alias("gr"),
        F.when(F.col("pos") < F.floor(F.col("n") * 0.6), F.col("value")).alias("seen"),
    )
