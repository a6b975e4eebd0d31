"""Join, lookup and id queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldline.operators import joins as J
from foldline.operators import ledger as L
from foldline.plans.catalog import query, rounded, table
from foldline.plans.stand_ins import ENTITY_SQL, OOF_SQL, entities, oof


def _pos(df, order):
    from foldline.operators.series import ordered_positions

    return ordered_positions(df, order)


@query(
    "C1 A11 A12",
    f"""SELECT id, row_number() OVER (ORDER BY md5(id::VARCHAR), id) - 1 AS pos, round(CASE WHEN id % 19 <> 4 THEN pa END, 6) AS pa FROM {OOF_SQL}""",
)
def template_alignment(spark, sf_dir):
    from foldline.sources.predictions import submission_by_id

    o = oof(spark, sf_dir)
    template = _pos(o.select("id", F.md5(F.col("id").cast("string")).alias("k")), ["k", "id"])
    return rounded(submission_by_id(template, o.filter("id % 19 <> 4").select("id", "pa"), "id", "pos", "pa"))


@query("C1 C13", f"SELECT id FROM {OOF_SQL} WHERE id % 19 = 4")
def missing_template_ids(spark, sf_dir):
    o = oof(spark, sf_dir)
    return J.missing_ids(o, o.filter("id % 19 <> 4"), "id")


_B = f"(SELECT id, y + CASE WHEN id % 101 = 0 THEN 1 ELSE 0 END AS y, pd AS other FROM {OOF_SQL} WHERE id % 7 <> 3 UNION ALL SELECT id, y, pd FROM {OOF_SQL} WHERE id % 50 = 1 AND id % 7 <> 3)"


def _sides(spark, sf_dir):
    o = oof(spark, sf_dir)
    b = o.filter("id % 7 <> 3")
    shifted = b.select("id", (F.col("y") + F.when(F.col("id") % 101 == 0, 1).otherwise(0)).alias("y"), F.col("pd").alias("other"))
    twice = b.filter("id % 50 = 1").select("id", "y", F.col("pd").alias("other"))
    return o.select("id", "y", "pa", "fold"), shifted.unionByName(twice)


@query(
    "C2",
    f"""SELECT (SELECT count(*) FROM {OOF_SQL}) AS rows_a, (SELECT count(*) FROM {_B}) AS rows_b, 0::BIGINT AS duplicates_a, (SELECT count(*) FROM {OOF_SQL} WHERE id % 50 = 1 AND id % 7 <> 3) AS duplicates_b,
        (SELECT count(*) FROM {OOF_SQL} WHERE id % 7 = 3) AS only_a, 0::BIGINT AS only_b, (SELECT count(*) FROM {OOF_SQL} WHERE id % 7 <> 3 AND id % 101 = 0 AND id % 50 <> 1) AS target_mismatches""",
)
def prediction_join_audit(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return J.join_oof_audit(a, b, "id", "y")


@query("C2", f"SELECT id, round(a.y, 6) AS y, round(b.y, 6) AS y_other, round(pa, 6) AS pa, round(other, 6) AS other FROM {OOF_SQL} a JOIN {_B} b USING (id)")
def prediction_join(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return rounded(J.join_oof(a.drop("fold"), b, "id", "y"))


@query(
    "C3",
    f"""SELECT count(*) FILTER (WHERE id % 7 = 3)::BIGINT AS only_a, 0::BIGINT AS only_b, 0::BIGINT AS duplicate_keys, count(*) FILTER (WHERE id % 7 <> 3 AND id % 101 = 0)::BIGINT AS unequal_y,
        count(*) FILTER (WHERE id % 7 <> 3 AND id % 33 = 0)::BIGINT AS unequal_fold FROM {OOF_SQL}""",
)
def strict_join_audit(spark, sf_dir):
    a, b = _strict(spark, sf_dir)
    return J.join_strict_audit(a, b, "id", ["y", "fold"])


def _strict(spark, sf_dir):
    o = oof(spark, sf_dir)
    a = o.select("id", "y", "fold", "pa")
    b = o.filter("id % 7 <> 3").select(
        "id", F.when(F.col("id") % 101 == 0, F.lit(None)).otherwise(F.col("y")).alias("y"),
        F.when(F.col("id") % 33 == 0, -1).otherwise(F.col("fold")).alias("fold"), "pd",
    )
    return a, b


@query("C3", f"SELECT id, round(y, 6) AS y, fold, round(pa, 6) AS pa, round(pd, 6) AS pd FROM {OOF_SQL}")
def strict_join(spark, sf_dir):
    o = oof(spark, sf_dir)
    return rounded(J.join_strict(o.select("id", "y", "fold", "pa"), o.select("id", "y", "fold", "pd"), "id", ["y", "fold"]))


@query(
    "C4",
    f"""SELECT count(*) AS rows, count(*) FILTER (WHERE id % 7 = 3)::BIGINT AS missing, count(*) FILTER (WHERE id % 7 <> 3 AND id % 101 = 0)::BIGINT AS unequal_y,
        count(*) FILTER (WHERE id % 7 <> 3 AND id % 33 = 0)::BIGINT AS unequal_fold FROM {OOF_SQL}""",
)
def locked_stream_alignment(spark, sf_dir):
    a, b = _strict(spark, sf_dir)
    return J.audit_alignment(a, b, "id", ["y", "fold"])


@query("C5", "SELECT event_id, (user_id % 5 + 1)::INTEGER AS fold FROM events")
def fold_lookup(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id")
    manifest = ev.select("user_id").distinct().withColumn("fold", (F.col("user_id") % 5 + 1).cast("int"))
    return J.attach_fold(ev, manifest, "user_id").select("event_id", "fold")


_FEED = """(SELECT 'f' || (o_orderkey % 500) AS file, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE (o_totalprice / 1000)::VARCHAR END AS score, o_orderstatus AS status FROM orders)"""


@query(
    "C7 N3",
    f"""WITH l AS (SELECT c_custkey AS id, 'f' || (c_custkey % 700) AS file, c_acctbal / 1000 AS cv, CASE WHEN c_custkey % 2 = 0 THEN 0.5::DOUBLE END AS lb, 'kept' AS own FROM customer),
        f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq DESC) AS k FROM {_FEED}) WHERE k = 1)
        SELECT id, round(coalesce(try_cast(score AS DOUBLE), lb), 6) AS lb_score, CASE WHEN try_cast(score AS DOUBLE) IS NOT NULL THEN status ELSE own END AS status, coalesce(try_cast(score AS DOUBLE) IS NOT NULL, false) AS synced,
          round(abs(cv - coalesce(try_cast(score AS DOUBLE), lb)), 6) AS gap FROM l LEFT JOIN f USING (file) WHERE coalesce(try_cast(score AS DOUBLE), lb) IS NOT NULL""",
)
def score_feed_sync(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    ledger = c.select(
        k.alias("id"), F.concat(F.lit("f"), (k % 700).cast("string")).alias("file"), (F.col("c_acctbal") / 1000).alias("cv"),
        F.when(k % 2 == 0, 0.5).alias("lb_score"), F.lit("kept").alias("status"),
    )
    o = F.col("o_orderkey")
    feed = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("f"), (o % 500).cast("string")).alias("fileName"), o.alias("seq"),
        F.when(o % 3 == 0, "pending").otherwise((F.col("o_totalprice") / 1000).cast("string")).alias("publicScore"), F.col("o_orderstatus").alias("status"),
    )
    out = J.sync_scores(ledger, feed, "file", "fileName", "seq", extra=["status"])
    return rounded(L.score_gap(out, "cv", "lb_score").select("id", "lb_score", "status", "synced", "gap"))


# Curves: every third visible row of an entity; queries: all rows of the entity.
_CURVE = f"(SELECT entity, md AS x, avg(truth) AS v FROM {ENTITY_SQL} WHERE row_index % 3 = 1 GROUP BY entity, md)"
_NEAR = f"""(SELECT q.entity, q.row_index, q.x, (SELECT max(c.x) FROM {_CURVE} c WHERE c.entity = q.entity AND c.x <= q.x) AS bx, (SELECT min(c.x) FROM {_CURVE} c WHERE c.entity = q.entity AND c.x > q.x) AS ax
    FROM (SELECT entity, row_index, md + 0.1 AS x FROM {ENTITY_SQL}) q)"""
_NEARV = f"(SELECT n.*, b.v AS bv, a.v AS av FROM {_NEAR} n LEFT JOIN {_CURVE} b ON b.entity = n.entity AND b.x = n.bx LEFT JOIN {_CURVE} a ON a.entity = n.entity AND a.x = n.ax)"


def _curve(spark, sf_dir):
    e = entities(spark, sf_dir)
    q = e.select("entity", "row_index", (F.col("md") + 0.1).alias("x"))
    return q, e.filter("row_index % 3 = 1").select("entity", F.col("md").alias("x"), F.col("truth").alias("v"))


@query(
    "C8 E17 D14",
    f"""SELECT entity, row_index, round(CASE WHEN bx = x THEN bv WHEN bx IS NOT NULL AND ax IS NOT NULL THEN bv + (av - bv) * (x - bx) / (ax - bx) ELSE coalesce(bv, av) END, 6) AS y FROM {_NEARV}""",
)
def interpolating_join(spark, sf_dir):
    q, c = _curve(spark, sf_dir)
    return rounded(J.interp_join(q, c, "entity", "x", "v", "y").select("entity", "row_index", "y"))


@query(
    "C8",
    f"""SELECT entity, row_index, round(CASE WHEN bx = x THEN bv WHEN bx IS NOT NULL AND ax IS NOT NULL THEN bv + (av - bv) * (x - bx) / (ax - bx) END, 6) AS y FROM {_NEARV}""",
)
def interpolating_join_unclamped(spark, sf_dir):
    """Null outside the support of the curve, on the chunked path."""
    q, c = _curve(spark, sf_dir)
    return rounded(J.interp_join(q, c, "entity", "x", "v", "y", clamp=False, chunk_rows=19).select("entity", "row_index", "y"))


@query(
    "C9",
    f"""SELECT entity, row_index, CASE WHEN ax IS NULL OR x - bx <= ax - x THEN coalesce(bx, ax) ELSE ax END AS near_x FROM {_NEAR}""",
)
def nearest_curve_point(spark, sf_dir):
    q, c = _curve(spark, sf_dir)
    out = J.nearest(q, c, "entity", "x", "v")
    return out.select("entity", "row_index", F.col("nearest.x").alias("near_x"))


@query(
    "E17",
    f"""WITH e AS {ENTITY_SQL}, k AS (SELECT entity, row_index, gr, max(CASE WHEN gr IS NOT NULL THEN row_index END) OVER (PARTITION BY entity ORDER BY row_index) AS b,
          min(CASE WHEN gr IS NOT NULL THEN row_index END) OVER (PARTITION BY entity ORDER BY row_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM e)
        SELECT k.entity, k.row_index, round(CASE WHEN k.gr IS NOT NULL THEN k.gr WHEN b IS NOT NULL AND a IS NOT NULL THEN x.gr + (z.gr - x.gr) * (k.row_index - b) / (a - b) ELSE coalesce(x.gr, z.gr) END, 6) AS filled
        FROM k LEFT JOIN e x ON x.entity = k.entity AND x.row_index = b LEFT JOIN e z ON z.entity = k.entity AND z.row_index = a""",
)
def gap_interpolation(spark, sf_dir):
    e = entities(spark, sf_dir).select("entity", "row_index", "gr")
    return rounded(J.interpolate(e, "gr", "row_index", "entity", "filled").select("entity", "row_index", "filled"))


@query(
    "C10 D15",
    f"""WITH e AS {ENTITY_SQL}, l AS (SELECT entity, arg_max(seen, row_index) AS last FROM e WHERE entity % 3 = 0 AND seen IS NOT NULL GROUP BY entity), m AS (SELECT entity, median(gr) AS med FROM e WHERE entity % 3 <> 2 AND gr IS NOT NULL GROUP BY entity)
        SELECT entity, row_index, round(coalesce(last, med, (SELECT median(med) FROM m)), 6) AS fallback FROM e LEFT JOIN l USING (entity) LEFT JOIN m USING (entity)""",
)
def fallback_chain(spark, sf_dir):
    e = entities(spark, sf_dir)
    out = J.fallback_value(e.select("entity", "row_index"), e.filter("entity % 3 = 0"), e.filter("entity % 3 <> 2"), "entity", "seen", ["row_index"], "gr")
    return rounded(out)


@query("C16", "SELECT count(*) AS rows, count(*) FILTER (WHERE a <> b)::BIGINT AS mismatches FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS a, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS b FROM orders)")
def id_order_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return J.same_order(o, o, "o_orderkey", ["o_orderkey"], ["o_orderdate", "o_orderkey"])


@query(
    "C17",
    "SELECT o_orderkey, name FROM (SELECT o_orderkey, ' Cust' || (o_custkey % 400) || CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '' END AS name, row_number() OVER (PARTITION BY o_custkey % 400 ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1",
)
def latest_wins_upsert(spark, sf_dir):
    name = F.concat(F.lit(" Cust"), (F.col("o_custkey") % 400).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise(""))
    return J.upsert_latest(table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name")), "name", "o_orderkey")


@query("G3", "SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_a, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS only_b")
def id_set_equality(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_custkey % 9 <> 5 OR c_custkey % 9 = 5").select(F.col("c_custkey").alias("k"))
    return J.same_ids(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k").na.fill(0)


@query(
    "G4",
    """SELECT name, stamp FROM (SELECT name, max(stamp) AS stamp FROM (SELECT p_name AS name, p_partkey AS stamp FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_name, p_partkey FROM part WHERE p_partkey % 3 = 0) GROUP BY name)""",
)
def candidate_listing(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("stamp"))
    return J.collect_candidates([p.filter("stamp % 2 = 0"), p.filter("stamp % 3 = 0")], "name", "stamp")


@query("G1 G2 G5 A3", "SELECT o_orderkey AS key, o_totalprice AS amount, o_totalprice * 2 AS twice FROM orders UNION ALL SELECT l_orderkey, l_extendedprice, l_extendedprice * 2 FROM lineitem")
def stacked_entities(spark, sf_dir):
    from foldline.sources.tables import common_columns

    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"), "o_orderstatus")
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("amount"), "l_tax")
    keep, _ = common_columns(a, b)
    return a.select(*keep).unionByName(b.select(*keep)).withColumns({"twice": F.col("amount") * 2})
