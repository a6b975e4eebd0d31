import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldline.operators import ranks as R
from foldline.operators.models import ridge_stats
from foldline.operators.quantiles import from_keys, radix_quantiles, sort_keys, training_quantiles


def slow_ranks(data, grouped):
    groups, want = {}, {}
    for i, g, v in data:
        groups.setdefault(g if grouped else 0, []).append((i, v))
    for members in groups.values():
        key = lambda x: (1, 0) if x != x else (0, x + 0.0)
        places = {}
        for k, x in enumerate(sorted(key(v) for _, v in members if v is not None)):
            places.setdefault(x, []).append(k + 1)
        n = sum(map(len, places.values()))
        for i, v in members:
            want[i] = (None if v is None else sum(places[key(v)]) / len(places[key(v)]), n)
    return want


@pytest.mark.parametrize("rows,stretch", [(2000, 37), (2000, 1 << 20), (50, 1), (1, 5), (0, 5)])
@pytest.mark.parametrize("by", [["g"], []])
def test_ranks_across_stretches(spark, monkeypatch, rows, stretch, by):
    """Ties, groups and nulls that cross from one sorted stretch into the next."""
    rng = random.Random(rows + stretch)
    values = [None, math.nan, 0.0, -0.0, 1.5, 1.5, 1.5, 1.5]
    data = [(i, rng.choice(["a", "a", "a", "b", None, f"d{i % 40}"]), rng.choice([*values, rng.random(), rng.random() * 3])) for i in range(rows)]
    monkeypatch.setattr(R, "STRETCH_ROWS", stretch)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(stretch, 10_000)))
    try:
        df = spark.createDataFrame(data, "id long, g string, v double").repartition(8)
        got = R.average_rank(df, "v", by, total="t").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == rows and {r["id"]: (r["rank"], r["t"]) for r in got} == slow_ranks(data, bool(by))


def test_ranks_of_strings_and_dates(spark):
    df = spark.sql("SELECT id, cast(id % 3 AS string) AS s, date_add(date'2020-01-01', cast(id % 4 AS int)) AS d, cast(id % 5 AS decimal(5,2)) AS `x.y` FROM range(60)")
    for c, m in (("s", 3), ("d", 4)):
        got = {r["id"]: r["rank"] for r in R.average_rank(df, c).collect()}
        n = 60 // m
        assert got == {i: i % m * n + (n + 1) / 2 for i in range(60)}


def test_one_sort_a_rank(spark):
    """Sorted rows are written by one range exchange; what is joined to them has at most two rows a stretch."""
    df = spark.range(0, 5000, 1, 6).select("id", (F.col("id") % 9).alias("v"))
    rows = R._ranked_stretches(df, [], "v")
    assert R._edges(rows, [], "v").count() <= 2 * rows.rdd.getNumPartitions() * 2
    plan = R.average_rank(df, "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 0 and plan.count("Exchange hashpartitioning") == 0


def test_keys_keep_the_order():
    x = np.array([-np.inf, -1e300, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.5, 1e300, np.inf, np.nan])
    k = sort_keys(x)
    assert (np.diff(k.astype(object)) >= 0).all() and k[4] == k[5] and len(set(k.tolist())) == 11
    assert np.array_equal(from_keys(k), x, equal_nan=True)


def test_radix_equals_percentile(spark):
    df = spark.range(0, 3000, 1, 7).select(
        (F.col("id") % 4).cast("int").alias("f"), (F.hash("id") / 1000.0).alias("a"), F.when(F.col("id") % 3 > 0, (F.hash("id") % 5).cast("double")).alias("b"),
        F.lit(None).cast("double").alias("c"), F.when(F.col("id") % 50 == 0, F.lit(math.nan)).when(F.col("id") % 2 == 0, -1.0 / (F.col("id") + 1)).otherwise(F.lit(-0.0)).alias("d"),
    )
    probs = [0.0, 0.03, 0.5, 0.77, 1.0]
    sets = [[1, 2, 3], [0], [0, 1, 2, 3], []]
    got = radix_quantiles(df, ["a", "b", "c", "d"], probs, "f", sets)
    for i, s in enumerate(sets):
        agg = [F.percentile(c, F.array(*map(F.lit, probs))) for c in "abcd"]
        want = df.filter(F.col("f").isin(s)).agg(*agg).first()
        for j in range(4):
            assert np.array_equal(got[i, j], [math.nan] * 5 if want[j] is None else want[j], equal_nan=True), (s, j)
    empty = radix_quantiles(df.limit(0), ["a"], [0.5])
    assert np.isnan(empty).all()


def test_many_targets_in_turns(spark, monkeypatch):
    from foldline.operators import quantiles

    df = spark.range(500).select((F.col("id") % 3).cast("int").alias("f"), (F.col("id") * 7 % 101).cast("double").alias("a"), (-F.col("id")).alias("b"))
    whole = radix_quantiles(df, ["a", "b"], [0.2, 0.9], "f", [[0], [1, 2]])
    monkeypatch.setattr(quantiles, "MOST_TARGETS", 1)
    assert np.array_equal(whole, radix_quantiles(df, ["a", "b"], [0.2, 0.9], "f", [[0], [1, 2]]))


def test_quantiles_of_small_and_large_groups(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.hash("id") % 1000).alias("v"))
    want = {r["g"]: r["q"] for r in R.exact_quantiles(df, "v", [0.1, 0.5], ["g"]).collect()}
    got = {r["g"]: r["q"] for r in R.exact_quantiles(df, "v", [0.1, 0.5], ["g"], task_rows=100).collect()}
    assert got == want and len(got) == 12
    assert R.exact_quantiles(df, "v", [0.25], task_rows=10).first()[0] == R.exact_quantiles(df, "v", [0.25]).first()[0]


def test_ridge_medians_in_nine_jobs(spark):
    """Forty columns with gaps, five folds: the jobs do not depend on either."""
    cols = [f"c{i}" for i in range(40)]
    df = spark.range(0, 2000, 1, 4).select((F.col("id") % 5).cast("int").alias("fold"), F.rand(1).alias("y"), *[F.when(F.hash(F.col("id") + i) % 4 > 0, F.hash(F.col("id") * 3 + i) / 1e6).alias(c) for i, c in enumerate(cols)])
    df = spark.createDataFrame(df.collect(), df.schema)
    spark.sparkContext.setJobGroup("medians", "medians")
    q = {(r["fold"], r["column"]): r["q"][0] for r in training_quantiles(df, cols, "fold", [0.5]).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("medians"))
    spark.sparkContext.setJobGroup("", "")
    stats = ridge_stats(df, "y", cols, "fold")
    for f in range(5):
        want = df.filter(F.col("fold") != f).agg(*[F.percentile(c, F.lit(0.5)) for c in cols]).first()
        assert [q[f, c] for c in cols] == [stats.medians[f][c] for c in cols] == list(want)
    assert jobs <= 9 * 2 + 4  # adaptive execution runs a scan's shuffle and its result as jobs of their own


def test_anchor_scan_ranks_shared_rows_once(spark, monkeypatch):
    """Predictions that are the out-of-fold rows are ranked once, with the values of two separate frames."""
    from foldline.operators import geometry as G

    df = spark.createDataFrame([(i, float(i * 7 % 41), float(i * 5 % 37), float(i % 11), float(i)) for i in range(80)], "id long, a double, b double, c double, y double")
    calls, rank = [], G.rank_columns
    monkeypatch.setattr(G, "rank_columns", lambda df, id, cols: calls.append(cols) or rank(df, id, cols))

    def scan(preds):
        return G.anchor_blend_scan(df, preds, "id", ["id"], "y", {"a": 1.0}, {"b": ["b"]}, (0.1,), "a", "c").collect()[0].asDict()

    shared = scan(df)
    assert calls == [["a", "b", "c"]]
    assert shared == pytest.approx(scan(df.select("*"))) and len(calls) == 3
