"""Window primitives against pandas, and the same result however the series is cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldline.operators import ranks as R
from foldline.operators import series as SE
from foldline.operators import windows as W


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 700
    v = rng.normal(50, 10, n)
    v[rng.random(n) < 0.15] = np.nan
    return pd.DataFrame({"e": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 5, n)), "t": rng.permutation(n), "v": v})


@pytest.fixture(scope="module")
def table(spark, frame):
    return spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(5)


def _same(got, want, cols):
    got = got.sort_values("t").reset_index(drop=True)
    want = want.sort_values("t").reset_index(drop=True)
    for c in cols:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


@pytest.mark.parametrize("chunk", [10**6, 61])
@pytest.mark.parametrize("part", [["e"], []])
def test_rolling_and_ema_match_pandas(table, frame, part, chunk):
    got = W.rolling_stats(table, ["v"], (3, 8), ["t"], part, chunk)
    got = SE.ema(got, {"ema_4": (F.col("v"), 4), "ema_50": (F.col("v"), 50)}, ["t"], part, chunk).toPandas()
    want = frame.sort_values("t").copy()
    g = want.groupby("e", group_keys=False) if part else want.assign(k=0).groupby("k", group_keys=False)
    for n in (3, 8):
        want[f"v_roll_mean_{n}"] = g["v"].apply(lambda s, n=n: s.rolling(n, min_periods=1).mean())
        want[f"v_roll_std_{n}"] = g["v"].apply(lambda s, n=n: s.rolling(n, min_periods=1).std())
    for n in (4, 50):
        want[f"ema_{n}"] = g["v"].apply(lambda s, n=n: s.ewm(span=n).mean())
    _same(got, want, ["v_roll_mean_3", "v_roll_std_8", "ema_4", "ema_50"])


def test_rsi_and_returns_match_pandas(table, frame):
    got = W.pct_change(W.rsi(table, "v", 14, ["t"], ["e"]), "v", (1, 5), ["t"], ["e"]).toPandas()

    def rsi(s):
        d = s.diff()
        up, down = d.where(d > 0, 0).rolling(14).mean(), (-d.where(d < 0, 0)).rolling(14).mean()
        return 100 - 100 / (1 + up / down.replace(0, np.nan))

    want = frame.sort_values("t").copy()
    g = want.groupby("e", group_keys=False)["v"]
    want["v_rsi_14"] = g.apply(rsi)
    want["v_return_5"] = g.apply(lambda s: s.ffill().pct_change(5, fill_method=None))
    _same(got, want, ["v_rsi_14", "v_return_5"])


@pytest.mark.parametrize("chunk", [10**6, 37])
def test_running_values(table, frame, chunk):
    got = SE.running(table, {"hi": ("max", F.col("v")), "fill": ("last", F.col("v")), "n": ("sum", F.col("v").isNotNull().cast("long"))}, ["t"], ["e"], chunk_rows=chunk)
    got = SE.running(got, {"back": ("last", F.col("v"))}, ["t"], ["e"], reverse=True, chunk_rows=chunk).toPandas()
    want = frame.sort_values("t").copy()
    g = want.groupby("e")["v"]
    want["hi"], want["fill"], want["back"] = g.cummax().groupby(want["e"]).ffill(), g.ffill(), g.bfill()
    want["n"] = want["v"].notna().groupby(want["e"]).cumsum()
    _same(got, want, ["hi", "fill", "back", "n"])


def test_positions_do_not_depend_on_layout(spark, table, frame):
    want = frame.sort_values(["e", "t"]).assign(pos=lambda d: d.groupby("e").cumcount())
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = SE.ordered_positions(table, ["t"], ["e"]).toPandas()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        _same(got, want, ["pos"])


def test_average_rank_matches_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"t": range(400), "g": rng.integers(0, 3, 400), "v": rng.integers(0, 20, 400).astype(float)})
    got = R.average_rank(spark.createDataFrame(pdf), "v", ["g"]).toPandas()
    _same(got, pdf.assign(rank=pdf.groupby("g")["v"].rank()), ["rank"])


def test_quantiles_agree_on_both_paths(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 501), "v": np.round(rng.normal(size=501), 1)})
    probs = (0.0, 0.01, 0.33, 0.5, 0.999, 1.0)
    for limit in (10**6, 5):
        got = {r["g"]: r["q"] for r in R.exact_quantiles(spark.createDataFrame(pdf), "v", probs, ["g"], task_rows=limit).collect()}
        for g, part in pdf.groupby("g"):
            np.testing.assert_allclose(got[g], part["v"].quantile(list(probs)).to_numpy(), atol=1e-12)


def test_inverse_normal(spark):
    from statistics import NormalDist

    from foldline.functions.normal import probit

    ps = [1e-6, 0.001, 0.02, 0.1, 0.5, 0.77, 0.98, 1 - 1e-6]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(probit(F.col("p"))).collect()]
    np.testing.assert_allclose(got, [NormalDist().inv_cdf(p) for p in ps], rtol=1e-7, atol=1e-9)
