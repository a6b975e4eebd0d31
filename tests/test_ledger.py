"""Budget, decision, trend and tree rules."""

import pytest

from foldline.operators import ledger as L
from foldline.operators import metrics as M


def _decide(spark, rows, policy):
    df = spark.createDataFrame(rows, "led string, seq int, ts string, ok boolean, cv double, force boolean")
    out = L.decide_submissions(df, "led", ["seq"], "ts", "ok", "cv", "force", policy).orderBy("led", "seq").collect()
    return [r["decision"] for r in out]


def test_decisions_follow_budget_and_threshold(spark):
    rows = [
        ("a", 1, "2024-01-01T10:00:00", True, 0.50, False), ("a", 2, "2024-01-01T11:00:00", True, 0.505, False),
        ("a", 3, "2024-01-01T12:00:00", True, 0.505, True), ("a", 4, "2024-01-01T13:00:00", True, 0.9, False),
        ("a", 5, "2024-01-02T01:00:00", False, 0.9, False), ("a", 6, "2024-01-02T02:00:00", True, 0.52, False),
        ("a", 7, "2024-01-02T03:00:00", True, None, False), ("b", 1, "2024-01-01T10:00:00", True, 0.1, False),
    ]
    got = _decide(spark, rows, L.Policy(2, 0.01, "maximize"))
    assert got == ["accepted", "queued_threshold", "accepted", "queued_budget", "invalid", "accepted", "accepted", "accepted"]
    assert set(_decide(spark, rows, L.Policy(2, 0.01, "maximize", "notebook"))) == {"invalid", "notebook_required"}


def test_trend_directions(spark):
    rows = [("up", i, float(i)) for i in range(4)] + [("down", i, -float(i)) for i in range(4)] + [("one", 0, 1.0)]
    df = spark.createDataFrame(rows, "k string, seq int, s double")
    got = {r["k"]: r["trend"] for r in L.score_trend(df, "s", "minimize", ["seq"], ["k"]).collect()}
    assert got == {"up": "stagnating", "down": "improving", "one": "insufficient_data"}
    got = {r["k"]: r["trend"] for r in L.score_trend(df, "s", "maximize", ["seq"], ["k"]).collect()}
    assert got == {"up": "improving", "down": "stagnating", "one": "insufficient_data"}


def test_tree_depths_and_cycles(spark):
    nodes = spark.createDataFrame([(1, None, True), (2, 1, True), (3, 2, False), (4, 3, False), (5, 99, False)], "id int, up int, bug boolean")
    got = {r["id"]: (r["root"], r["depth"], r["path"], r["debug_depth"]) for r in L.experiment_tree(nodes, "id", "up", "bug").collect()}
    assert got == {1: (1, 0, "1", 0), 2: (1, 1, "1/2", 1), 3: (1, 2, "1/2/3", 2), 4: (1, 3, "1/2/3/4", 0), 5: (5, 0, "5", 0)}
    loop = spark.createDataFrame([(1, 2, False), (2, 1, False)], "id int, up int, bug boolean")
    with pytest.raises(ValueError):
        L.experiment_tree(loop, "id", "up", "bug", max_rounds=4)


def test_metric_directions():
    assert M.better(0.4, 0.5, "minimize") and M.better(0.6, 0.5, "maximize") and M.better(0.1, None, "maximize")
    assert not M.better(None, 0.5, "minimize")
    with pytest.raises(ValueError):
        M.get_metric("nope")


def test_feature_registry_orders_dependencies(spark):
    from pyspark.sql import functions as F

    from foldline.operators import features as FE

    FE.feature("t_base")(lambda df: df.withColumn("b", F.col("a") + 1))
    FE.feature("t_top", deps=["t_base"])(lambda df: df.withColumn("c", F.col("b") * 2))
    FE.feature("t_loop", deps=["t_loop2"])(lambda df: df)
    FE.feature("t_loop2", deps=["t_loop"])(lambda df: df)
    try:
        assert FE.build_features(spark.createDataFrame([(1,)], "a int"), ["t_top", "t_base"]).first().asDict() == {"a": 1, "b": 2, "c": 4}
        with pytest.raises(ValueError):
            FE.build_features(spark.createDataFrame([(1,)], "a int"), ["t_loop"])
        with pytest.raises(KeyError):
            FE.get_feature("t_none")
    finally:
        for n in ("t_base", "t_top", "t_loop", "t_loop2"):
            FE.REGISTRY.pop(n)
