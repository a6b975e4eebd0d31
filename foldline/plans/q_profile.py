"""Profiling and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldline.operators import profile as P
from foldline.operators import select as S
from foldline.plans.catalog import query, rounded, table

NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CAT = ["l_returnflag", "l_linestatus"]


def _profile_sql(table_name: str, num: list[str], cat: list[str], dates: list[str]) -> str:
    parts = []
    for c in num:
        parts.append(
            f"SELECT '{c}' AS \"column\", 'numeric' AS kind, count(*) AS n_rows, count(*) - count({c}) AS nulls, "
            f"count(DISTINCT {c}) AS n_unique, round(avg({c}), 7) AS mean, round(stddev_samp({c}), 5) AS std, "
            f"round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max, round(skewness({c}), 5) AS skew, "
            f"round((count(*) - count({c}))::DOUBLE / count(*), 6) AS null_pct, "
            f"round(count(DISTINCT {c})::DOUBLE / count(*), 6) AS cardinality_pct FROM {table_name}"
        )
    for c in cat + dates:
        kind = "categorical" if c in cat else "datetime"
        parts.append(
            f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count(*) AS n_rows, count(*) - count({c}) AS nulls, "
            f"count(DISTINCT {c}) AS n_unique, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, "
            f"NULL::DOUBLE AS max, NULL::DOUBLE AS skew, round((count(*) - count({c}))::DOUBLE / count(*), 6) AS null_pct, "
            f"round(count(DISTINCT {c})::DOUBLE / count(*), 6) AS cardinality_pct FROM {table_name}"
        )
    return " UNION ALL ".join(parts)


def _profile_digits(df):
    digits = {"mean": 7, "std": 5, "skew": 5}
    return df.withColumns({c: F.round(c, digits.get(c, 6)) for c in ("mean", "std", "skew", "min", "max", "null_pct", "cardinality_pct")})


@query("D1", _profile_sql("lineitem", NUM, CAT, ["l_shipdate"]))
def column_profile(spark, sf_dir):
    return _profile_digits(P.profile_columns(table(spark, sf_dir, "lineitem")))


@query(
    "D1 B1",
    _profile_sql("(SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events) e",
                 ["event_id", "user_id", "value"], ["event_type"], []),
)
def column_profile_with_nulls(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value")
    )
    return _profile_digits(P.profile_columns(ev))


@query(
    "D2 D3",
    """WITH e AS (SELECT o_custkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS half_null,
                         o_orderdate, 1 AS one, o_orderkey FROM orders
                  UNION ALL SELECT o_custkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END,
                         o_orderdate, 1, o_orderkey FROM orders WHERE o_orderkey % 10 = 3)
       SELECT count(*) AS n_rows, 6::BIGINT AS n_cols, 4::BIGINT AS n_numeric, 1::BIGINT AS n_datetime, 1::BIGINT AS n_categorical,
              'half_null' AS high_null,
              CASE WHEN count(DISTINCT o_orderkey)::DOUBLE / count(*) > 0.9 THEN 'o_orderkey' ELSE '' END AS high_cardinality,
              'one' AS constant, count(*) - count(DISTINCT o_orderkey) AS duplicate_rows FROM e""",
)
def table_profile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("half_null"),
        "o_orderdate", F.lit(1).alias("one"), "o_orderkey",
    )
    return P.profile_table(o.unionByName(o.filter("o_orderkey % 10 = 3")), cardinality_threshold=0.9)


@query(
    "D1 F7",
    """SELECT "column", value, count, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM (
           SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS count FROM part GROUP BY p_brand
           UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type
           UNION ALL SELECT 'p_name', p_name, count(*) FROM part GROUP BY p_name)) WHERE rank <= 5""",
)
def top_values_per_column(spark, sf_dir):
    out = P.top_values(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_name"], 5)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(
    "D4",
    """SELECT 'class:' || o_orderstatus AS stat, count(*)::DOUBLE AS value FROM orders GROUP BY o_orderstatus
       UNION ALL SELECT 'n_classes', count(DISTINCT o_orderstatus)::DOUBLE FROM orders
       UNION ALL SELECT 'imbalance_ratio', round(max(c)::DOUBLE / min(c), 6) FROM (SELECT count(*) c FROM orders GROUP BY o_orderstatus)""",
)
def target_balance(spark, sf_dir):
    return rounded(P.target_stats(table(spark, sf_dir, "orders"), "o_orderstatus"))


@query(
    "D4",
    """SELECT 'mean' AS stat, round(avg(o_totalprice), 6) AS value FROM orders
       UNION ALL SELECT 'std', round(stddev_samp(o_totalprice), 6) FROM orders
       UNION ALL SELECT 'min', min(o_totalprice) FROM orders UNION ALL SELECT 'max', max(o_totalprice) FROM orders""",
)
def target_moments(spark, sf_dir):
    return rounded(P.target_stats(table(spark, sf_dir, "orders"), "o_totalprice"))


def _with_leak(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_extendedprice") * 2 + F.col("l_tax")).alias("copy"),
        F.when(F.col("l_orderkey") % 3 != 0, F.col("l_extendedprice") - 1).alias("gappy_copy"),
    )


_LEAK = """(SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * 2 + l_tax AS "copy",
                   CASE WHEN l_orderkey % 3 <> 0 THEN l_extendedprice - 1 END AS gappy_copy FROM lineitem)"""
_CORRS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", corr(\"{c}\", l_extendedprice) AS corr FROM {_LEAK}"
    for c in ("l_quantity", "l_discount", "l_tax", "copy", "gappy_copy")
)


@query("D7", f'SELECT "column", round(corr, 6) AS corr FROM ({_CORRS})')
def correlation_to_target(spark, sf_dir):
    return rounded(P.corr_to_target(_with_leak(spark, sf_dir), "l_extendedprice"))


@query("D5", f'SELECT "column", round(corr, 6) AS corr FROM ({_CORRS}) WHERE abs(corr) > 0.95')
def leakage_scan(spark, sf_dir):
    return rounded(P.leakage(_with_leak(spark, sf_dir), "l_extendedprice"))


_SHIFT = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", avg({c}) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS train_mean,
        avg({c}) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS test_mean,
        stddev_samp({c}) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS sd FROM
        (SELECT *, datediff('day', TIMESTAMP '1990-01-01', o_orderdate)::DOUBLE AS age, 1 AS one FROM orders)"""
    for c in ("o_orderkey", "o_custkey", "o_totalprice", "age", "one")
)


@query(
    "D6",
    f"""SELECT "column", round(train_mean, 6) AS train_mean, round(test_mean, 6) AS test_mean,
        round(abs(train_mean - test_mean) / sd, 6) AS shift_score FROM ({_SHIFT})
        WHERE sd > 0 AND abs(train_mean - test_mean) / sd > 0.01""",
)
def drift_scan(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns(
        {"age": F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("double"), "one": F.lit(1)}
    )
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    out = P.distribution_shift(o.filter(F.col("o_orderdate") < cut), o.filter(F.col("o_orderdate") >= cut), 0.01)
    return out.select("column", F.round("train_mean", 6).alias("train_mean"), F.round("test_mean", 6).alias("test_mean"),
                      F.round("shift_score", 6).alias("shift_score"))


_PAIRC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]


@query(
    "D8",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
        for i, a in enumerate(_PAIRC) for b in _PAIRC[i + 1:]
    ),
)
def correlation_matrix(spark, sf_dir):
    return rounded(P.corr_matrix(table(spark, sf_dir, "lineitem"), _PAIRC))


@query(
    "D8",
    """SELECT 'value' AS a, 'user_id' AS b, round(corr(value, user_id), 6) AS corr FROM (SELECT CASE WHEN event_id % 5 <> 0 THEN value END AS value, CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id, event_id FROM events)
       UNION ALL SELECT 'value', 'event_id', round(corr(value, event_id), 6) FROM (SELECT CASE WHEN event_id % 5 <> 0 THEN value END AS value, event_id FROM events)
       UNION ALL SELECT 'user_id', 'event_id', round(corr(user_id, event_id), 6) FROM (SELECT CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id, event_id FROM events)""",
)
def correlation_matrix_with_nulls(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("user_id"),
        "event_id",
    )
    return rounded(P.corr_matrix(ev, ["value", "user_id", "event_id"]))


@query(
    "D8",
    """SELECT "column", rank FROM (SELECT "column", row_number() OVER (ORDER BY v DESC, "column") AS rank FROM (
        SELECT 'l_quantity' AS "column", var_samp(l_quantity) AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', var_samp(l_extendedprice) FROM lineitem
        UNION ALL SELECT 'l_discount', var_samp(l_discount) FROM lineitem UNION ALL SELECT 'l_tax', var_samp(l_tax) FROM lineitem)) WHERE rank <= 3""",
)
def columns_by_variance(spark, sf_dir):
    names = P.widest_columns(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax"), 3)
    li = table(spark, sf_dir, "lineitem")
    ranks = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.lit(i + 1) for i in range(len(names))]))
    return P._long(li, {n: {"rows": F.count(n)} for n in names}).select("column", F.element_at(ranks, F.col("column")).cast("long").alias("rank"))


@query(
    "D28",
    """WITH s AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem)
       SELECT least(floor((l_extendedprice - lo) / (hi - lo) * 50), 49)::BIGINT AS bin, count(*) AS count FROM lineitem, s GROUP BY 1""",
)
def price_histogram(spark, sf_dir):
    return P.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 50)


@query(
    "D28",
    """SELECT 'value' AS "column", round(100 * avg(CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE 0.0 END), 6) AS missing_pct FROM events""",
)
def missing_share(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return rounded(P.missing_report(ev))


@query(
    "D34",
    """SELECT o_orderpriority, count(*) AS count, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 6) AS q1,
       round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS q3, max(o_totalprice) AS max
       FROM orders GROUP BY o_orderpriority""",
)
def target_by_category(spark, sf_dir):
    return rounded(P.feature_vs_target(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"))


@query(
    "D35",
    """SELECT 'train' AS split, count(*) AS rows, count(DISTINCT user_id) AS entities, 'user_id,value' AS columns FROM events WHERE user_id % 4 <> 0
       UNION ALL SELECT 'test', count(*), count(DISTINCT user_id), 'user_id,value' FROM events WHERE user_id % 4 = 0""",
)
def split_inventory(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "value")
    return P.inventory(ev.filter("user_id % 4 <> 0"), ev.filter("user_id % 4 = 0"), "user_id")


@query(
    "A15",
    """SELECT 'c_mktsegment' AS "column", 'c_mktsegment categorical unique ' || count(DISTinct c_mktsegment) || ' values ' ||
         (SELECT string_agg(c_mktsegment, '|' ORDER BY n DESC, c_mktsegment) FROM (SELECT c_mktsegment, count(*) n FROM customer GROUP BY 1)) AS line FROM customer
       UNION ALL SELECT 'c_nationkey', 'c_nationkey numeric range ' || min(c_nationkey) || '.00000 to ' || max(c_nationkey) || '.0000 nulls 0' FROM customer""",
)
def column_preview(spark, sf_dir):
    return P.preview(table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey"))


@query(
    "B3",
    """SELECT 'l_tax' AS "column", min(l_tax) = max(l_tax) AS constant FROM lineitem UNION ALL SELECT 'one', true
       UNION ALL SELECT 'empty', true UNION ALL SELECT 'one_or_null', false""",
)
def constant_column_scan(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_tax", F.lit(1).alias("one"), F.lit(None).cast("double").alias("empty"),
        F.when(F.col("l_orderkey") % 2 == 0, 1).alias("one_or_null"),
    )
    return S.constant_columns(li, li.columns)


@query(
    "B4",
    f"""SELECT "column", round(corr, 6) AS corr, false AS forced FROM (SELECT * FROM ({_CORRS}) ORDER BY abs(corr) DESC, "column" LIMIT 2)
        UNION ALL SELECT "column", round(corr, 6), true FROM ({_CORRS}) WHERE "column" = 'l_tax'""",
)
def top_correlated_features(spark, sf_dir):
    return rounded(S.top_corr_features(_with_leak(spark, sf_dir), "l_extendedprice", 2, always=["l_tax", "copy"]))


@query(
    "B5",
    """WITH e AS (SELECT l_quantity AS a, l_quantity * 2 + l_tax AS b, l_tax AS c, l_tax * 3 + 1 AS d, l_discount AS e FROM lineitem),
       r AS (SELECT 'b' AS later, abs(corr(a, b)) AS r FROM e UNION ALL SELECT 'c', abs(corr(a, c)) FROM e UNION ALL SELECT 'c', abs(corr(b, c)) FROM e
         UNION ALL SELECT 'd', abs(corr(a, d)) FROM e UNION ALL SELECT 'd', abs(corr(b, d)) FROM e UNION ALL SELECT 'd', abs(corr(c, d)) FROM e
         UNION ALL SELECT 'e', abs(corr(a, e)) FROM e UNION ALL SELECT 'e', abs(corr(b, e)) FROM e UNION ALL SELECT 'e', abs(corr(c, e)) FROM e UNION ALL SELECT 'e', abs(corr(d, e)) FROM e)
       SELECT 'a' AS "column", false AS dropped UNION ALL SELECT later, max(r) > 0.95 FROM r GROUP BY later""",
)
def near_duplicate_columns(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("a"), (F.col("l_quantity") * 2 + F.col("l_tax")).alias("b"), F.col("l_tax").alias("c"),
        (F.col("l_tax") * 3 + 1).alias("d"), F.col("l_discount").alias("e"),
    )
    gone = S.correlated_columns(li, li.columns, 0.95)
    return P._long(li, {c: {"n": F.count(c)} for c in li.columns}).select("column", F.col("column").isin(*gone).alias("dropped"))


# Scattered nulls: no row has all columns, every pair has common rows.
@query(
    "B5",
    """WITH e AS (SELECT l_quantity AS a, CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity * 2 + l_tax END AS b, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS c, CASE WHEN l_orderkey % 3 <> 1 THEN l_discount END AS d, CASE WHEN l_linenumber % 2 = 1 THEN l_quantity + l_tax END AS e FROM lineitem),
       r AS (SELECT 'b' AS later, corr(a, b) AS r FROM e UNION ALL SELECT 'c', corr(a, c) FROM e UNION ALL SELECT 'c', corr(b, c) FROM e UNION ALL SELECT 'd', corr(a, d) FROM e UNION ALL SELECT 'd', corr(b, d) FROM e UNION ALL SELECT 'd', corr(c, d) FROM e
         UNION ALL SELECT 'e', corr(a, e) FROM e UNION ALL SELECT 'e', corr(b, e) FROM e UNION ALL SELECT 'e', corr(d, e) FROM e)
       SELECT 'a' AS "column", false AS dropped UNION ALL SELECT later, max(abs(r)) > 0.95 FROM r GROUP BY later""",
)
def near_duplicate_columns_with_nulls(spark, sf_dir):
    q, key, line = F.col("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")
    li = table(spark, sf_dir, "lineitem").select(
        q.alias("a"), F.when(key % 3 != 0, q * 2 + F.col("l_tax")).alias("b"), F.when(line % 2 == 0, q).alias("c"),
        F.when(key % 3 != 1, F.col("l_discount")).alias("d"), F.when(line % 2 == 1, q + F.col("l_tax")).alias("e"),
    )
    gone = S.correlated_columns(li, li.columns, 0.95)
    return P._long(li, {c: {"n": F.count("*")} for c in li.columns}).select("column", F.col("column").isin(*gone).alias("dropped"))


_WIDE = [f"w{k}" for k in range(1, 65)]
_WIDE_EXPR = [
    f"CASE WHEN (l_orderkey + 3 * l_linenumber + {k}) % 7 <> 0 THEN l_quantity * {k % 5} + l_extendedprice / 1000 * {k % 3} + l_discount * {10 * (k % 7)} + l_tax * {100 + k % 2} END AS w{k}"
    for k in range(1, 65)
]
_WIDE_PAIRS = [(a, b) for i, a in enumerate(_WIDE) for b in _WIDE[i + 1 :]]


@query(
    "D8",
    f"""SELECT unnest([{', '.join(f"'{a}'" for a, _ in _WIDE_PAIRS)}]) AS a, unnest([{', '.join(f"'{b}'" for _, b in _WIDE_PAIRS)}]) AS b, unnest([{', '.join(f'round(corr({a}, {b}), 6)' for a, b in _WIDE_PAIRS)}]) AS corr
    FROM (SELECT {', '.join(_WIDE_EXPR)} FROM lineitem)""",
)
def wide_correlation_matrix_with_nulls(spark, sf_dir):
    """64 columns of which each row misses some: one scan for all 2016 pairs."""
    li = table(spark, sf_dir, "lineitem")
    return rounded(P.corr_matrix(li.selectExpr(*_WIDE_EXPR), _WIDE))


@query(
    "B8",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) lo, quantile_cont(l_extendedprice, 0.99) hi FROM lineitem)
       SELECT l_returnflag, count(*) AS n, round(sum(least(greatest(l_extendedprice, lo), hi)), 2) AS total FROM lineitem, q GROUP BY l_returnflag""",
)
def quantile_clip(spark, sf_dir):
    out = S.clip_quantile(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.01, 0.99)
    return out.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query(
    "B14",
    """SELECT 'a' AS "column", count(*) FILTER (WHERE event_id % 7 = 0)::BIGINT AS non_finite FROM events
       UNION ALL SELECT 'b', count(*) FILTER (WHERE event_id % 5 = 0)::BIGINT FROM events
       UNION ALL SELECT 'value', 0""",
)
def non_finite_counts(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("a"),
        F.when(F.col("event_id") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("b"),
        "value",
    )
    return S.non_finite(ev, ["a", "b", "value"])


@query(
    "B7 B2",
    """SELECT o_orderkey, 0.0::DOUBLE AS ghost, o_totalprice FROM orders""",
)
def aligned_inference_columns(spark, sf_dir):
    return S.align_columns(table(spark, sf_dir, "orders"), ["o_orderkey", "ghost", "o_totalprice"], 0.0)


@query(
    "B15",
    """WITH imp AS (SELECT l_shipmode AS feature, l_linenumber AS fold, CASE WHEN l_shipmode = 'A' THEN 0.0 ELSE q END AS gain FROM
         (SELECT l_returnflag AS l_shipmode, l_linenumber, avg(l_quantity) AS q FROM lineitem GROUP BY ALL))
       SELECT feature, round(avg(gain), 6) AS gain FROM imp GROUP BY feature HAVING avg(gain) > 0""",
)
def pruned_features(spark, sf_dir):
    imp = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("feature"), "l_linenumber").agg(F.avg("l_quantity").alias("q"))
    imp = imp.withColumn("gain", F.when(F.col("feature") == "A", 0.0).otherwise(F.col("q")))
    return rounded(S.prune_features(imp, "feature", "gain"))
