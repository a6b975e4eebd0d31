"""Audit queries on rows that the given tables hold rarely."""

from __future__ import annotations

import datetime as dt

import pytest

from foldline.plans import catalog
from tests.oracle import compare, duck

QUERIES = catalog.load()


def test_changed_rows_of_one_key_do_not_cancel(spark, tmp_path):
    """Two rows of one order line whose quantities differ by one: the changed first equals the unchanged second."""
    rows = [(7, 1, q, "A") for q in (4.0, 5.0, 5.0)] + [(7, 2, 3.0, "N"), (8, 1, 2.0, "R"), (8, 1, 2.0, "R"), (9, 1, 1.0, "A")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string").toPandas().to_parquet(tmp_path / "lineitem.parquet")
    status, note = compare(spark, duck(str(tmp_path)), str(tmp_path), QUERIES["changed_and_repeated_rows"])
    assert status == "ok", note


@pytest.mark.parametrize("value", [0.25, -0.25, 0.0, 12.5])
def test_every_hidden_target_moves(spark, tmp_path, value):
    """A target of 0.25 is the fixed point of -3 x + 1."""
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(hours=i), i % 4, "a", value, "{}") for i in range(40)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    status, note = compare(spark, duck(str(tmp_path)), str(tmp_path), QUERIES["target_independence"])
    assert status == "ok", note
