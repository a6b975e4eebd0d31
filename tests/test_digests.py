"""Bucket digests against exceptAll, and pair moments against NumPy."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldline.operators import digests as D
from foldline.operators import moments as M

SCHEMA = "k long, s string, x double, l array<int>"


def _key(row):
    x = row[2]
    return (row[0], row[1], "nan" if x is not None and x != x else x if x is None else x + 0.0, None if row[3] is None else tuple(row[3]))


def _rows(seed, n):
    r = random.Random(seed)
    return [
        (r.choice([None, 1, 2]), r.choice([None, "", "a", "b"]), r.choice([None, 0.0, -0.0, float("nan"), 1.5]), r.choice([None, [], [None], [1, 2]]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("n, m, buckets", [(0, 0, 8), (0, 40, 8), (300, 0, 1), (300, 280, 4096), (300, 300, 3)])
def test_differences_equal_except_all(spark, n, m, buckets):
    left, right = _rows(1, n), _rows(2, m)
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    got = Counter((_key(r), r.side) for r in D.row_differences(a, b, "side", buckets).collect())
    x, y = Counter(map(_key, left)), Counter(map(_key, right))
    want = Counter({(k, "left"): v for k, v in (x - y).items()}) + Counter({(k, "right"): v for k, v in (y - x).items()})
    assert got == want
    assert D.row_differences(a, b, buckets=buckets).columns == a.columns
    assert D.same_rows(a, b, buckets) == (not want) and D.same_rows(a, a.repartition(5).orderBy("s"), buckets)


def test_nulls_types_and_copies(spark):
    one = spark.createDataFrame([(None, 1), (2, None)], "a int, b int")
    swapped = spark.createDataFrame([(1, None), (None, 2)], "x long, y long")
    assert not D.same_rows(one, swapped)
    assert D.same_rows(one, spark.createDataFrame([(2, None), (None, 1)], "x long, y long"))  # int against long
    nested = "l array<int>, m array<int>, s struct<a: int, b: string>"
    flat = [spark.createDataFrame([r], nested) for r in (([1], [2], (1, None)), ([1, 2], [], (1, None)), ([1, None], [2], (1, None)), ([1], [2], None), ([1], [2], (None, None)))]
    assert [D.same_rows(flat[i], flat[j]) for i in range(5) for j in range(i + 1)] == [i == j for i in range(5) for j in range(i + 1)]
    twice = one.unionByName(one)
    assert not D.same_rows(one, twice)
    assert sorted(map(str, D.row_differences(one, twice, "side").collect())) == sorted(["Row(a=None, b=1, side='right')", "Row(a=2, b=None, side='right')"])
    with pytest.raises(ValueError):
        D.same_rows(one, one.select("a"))


def test_stored_digests_name_the_changed_buckets(spark, tmp_path):
    a = spark.range(5_000).select("id", (F.col("id") * 2).alias("v"))
    D.table_digests(a).write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    assert D.differing_buckets(stored, D.table_digests(a.repartition(3))).isEmpty()
    changed = a.withColumn("v", F.when(F.col("id") == 77, 0).otherwise(F.col("v")))
    assert 1 <= D.differing_buckets(stored, D.table_digests(changed)).count() <= 2


def test_pair_moments_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 5)) * [1, 1e-3, 1, 5, 1] + [0, 1e6, -40, 3, 0]
    x[:, 3] += 4 * x[:, 0]
    x[:, 4] = 0.1  # constant
    x = np.concatenate([x, np.full((900, 1), np.nan)], axis=1)
    x[rng.random(x.shape) < 0.2] = np.nan
    x = x[np.argsort(x[:, 2])]  # tasks and batches see different means
    cols = [f"c{i}" for i in range(6)]
    rows = [tuple(None if v != v and (i + k) % 2 else float(v) for k, v in enumerate(r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartitionByRange(7, "c2")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "31")
        got = {(r["i"], r["j"]): r for r in M.pair_moments(df, cols).withColumn("corr", M.pair_correlation()).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert set(got) == {(i, j) for i in range(6) for j in range(i + 1, 6)}
    for (i, j), r in got.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert r["n"] == both.sum()
        if both.sum() == 0 or 4 in (i, j):
            assert r["corr"] is None
            continue
        c = np.cov(x[both][:, [i, j]].T, bias=True) * both.sum()
        near = 1e-7 * np.sqrt(c[0, 0] * c[1, 1])  # doubles at 1e6 hold a spread of 1e-3 to 1e-7
        assert np.allclose([r["xx"], r["xy"], r["yy"]], [c[0, 0], c[0, 1], c[1, 1]], rtol=1e-7, atol=near if 1 in (i, j) else near / 1e4)
        assert abs(r["corr"] - np.corrcoef(x[both][:, [i, j]].T)[0, 1]) < (1e-7 if 1 in (i, j) else 1e-11)
    assert M.pair_moments(df.limit(0), cols).count() == 0


def test_wide_columns_are_evaluated_in_small_methods(spark, monkeypatch):
    """Rows over several slices of a batch, with nulls and a column of NaN alone; the session's setting comes back."""
    key, used, write = "spark.sql.codegen.hugeMethodLimit", [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: used.append(spark.conf.get(key)) or write(df))
    before = spark.conf.get(key)
    n, cols = 2 * M.SLICE_ROWS + 7, [f"w{k}" for k in range(12)]
    exprs = [f"CASE WHEN (id + {k}) % 7 <> 0 THEN id * {k} % 101 + 1e6 END AS w{k}" for k in range(11)]
    df = spark.range(n).repartition(1).selectExpr(*exprs, "double('NaN') AS w11")
    got = {(r["i"], r["j"]): (r["n"], r["corr"]) for r in M.pair_moments(df, cols).withColumn("corr", M.pair_correlation()).collect()}
    assert used == ["8000"] and spark.conf.get(key) == before
    x = df.toPandas().to_numpy(float)
    for i in range(12):
        for j in range(i + 1, 12):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert got[i, j][0] == both.sum()
            if i == 0 or j == 11:  # constant or empty
                assert got[i, j][1] is None
            else:
                assert abs(got[i, j][1] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9
