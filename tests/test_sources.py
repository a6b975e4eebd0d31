"""Readers and writers on small files."""

import hashlib
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldline.sources import entities as EN
from foldline.sources import files as FI
from foldline.sources import predictions as PR
from foldline.sources import sidecars as SI
from foldline.sources import tables as TA


def test_entity_files(spark, tmp_path):
    for name, rows in {"a_1": "MD,Z,seen\n0,1.5,3\n1,,4\n2,2.5,\n", "b": "Z,MD,seen\n7,0,x\n"}.items():
        (tmp_path / f"{name}__series.csv").write_text(rows)
    (tmp_path / "a_1__curve.csv").write_text("x,v\n1,2\n")
    schema = T.StructType().add("MD", "double").add("Z", "double").add("seen", "double")
    got = {(r["entity"], r["row_index"]): (r["MD"], r["Z"], r["seen"]) for r in EN.read_entities(spark, str(tmp_path), "__series.csv", schema).collect()}
    assert got == {("a_1", 0): (0.0, 1.5, 3.0), ("a_1", 1): (1.0, None, 4.0), ("a_1", 2): (2.0, 2.5, None), ("b", 0): (0.0, 7.0, None)}
    pairs = {r["entity"]: r["complete"] for r in EN.paired_entities(spark, str(tmp_path), "__series.csv", "__curve.csv").collect()}
    assert pairs == {"a_1": True, "b": False}


def test_quoted_cells(spark, tmp_path):
    (tmp_path / "q__series.csv").write_text('name,"a, b",v\n"x, ""y""",5,1\nplain,6,"2"\n')
    schema = T.StructType().add("name", "string").add("a, b", "integer").add("v", "double").add("absent", "integer")
    rows = EN.read_entities(spark, str(tmp_path), "__series.csv", schema).orderBy("row_index").collect()
    assert [tuple(r) for r in rows] == [("q", 0, 'x, "y"', 5, 1.0, None), ("q", 1, "plain", 6, 2.0, None)]


def test_versions_publish_and_schema(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    root = str(tmp_path / "m")
    assert [TA.write_versioned(df, root).rsplit("/", 1)[1] for _ in range(2)] == ["v001", "v002"]
    out = TA.publish(df, str(tmp_path / "x" / "t"))
    with pytest.raises(FileExistsError):
        TA.publish(df, out)

    def refuse(_):
        raise ValueError("no")

    with pytest.raises(ValueError):
        TA.publish(df, str(tmp_path / "x" / "u"), refuse)
    assert not (tmp_path / "x" / "u").exists()
    with pytest.raises(ValueError, match="missing column c"):
        TA.assert_schema(df, T.StructType().add("c", "integer"))
    with pytest.raises(ValueError, match="unexpected column b"):
        TA.assert_schema(df, T.StructType().add("a", "integer"), exact=True)


def test_csv_needs_schema(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,NaN\n")
    with pytest.raises(ValueError):
        TA.read_table(spark, str(tmp_path / "t.csv"))
    assert TA.read_table(spark, str(tmp_path / "t.csv"), "a int, b double").first()["b"] is None


def test_submission_order_and_refusal(spark, tmp_path):
    template = spark.createDataFrame([("x", 2), ("y", 0), ("z", 1)], "id string, pos int")
    preds = spark.createDataFrame([("z", 1.0), ("x", 2.0), ("y", 3.0)], "id string, p double")
    PR.write_submission(template, preds, "id", "pos", "p", str(tmp_path / "s"))
    lines = [line for f in sorted((tmp_path / "s").glob("part-*")) for line in f.read_text().splitlines() if line != "id,p"]
    assert lines == ["y,3.0", "z,1.0", "x,2.0"]
    for bad in (preds.filter("id <> 'x'"), preds.withColumn("p", F.lit(float("nan"))), preds.unionByName(preds)):
        with pytest.raises(ValueError):
            PR.write_submission(template, bad, "id", "pos", "p", str(tmp_path / "bad"))


def test_fingerprints(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.txt").write_text(n * 3)
    first = FI.fingerprint(spark, [str(tmp_path)])
    before = FI.snapshot(spark, [str(tmp_path)])
    (tmp_path / "b.txt").write_text("changed")
    assert FI.fingerprint(spark, [str(tmp_path)]) != first
    assert [r["path"].rsplit("/", 1)[1] for r in FI.hash_contract(before, FI.snapshot(spark, [str(tmp_path)])).collect()] == ["b.txt"]
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["lines"]) for r in FI.file_inventory(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == (3, 1) and got["b.txt"] == (7, 1)


def test_digests_read_files_in_parts(spark, tmp_path):
    """Every byte and the order of parts count, a part never holds more than its bytes, sizes around a part's end are whole."""
    for n in (1, 9, 10, 11, 35):
        (tmp_path / f"f {n}.bin").write_bytes(bytes(range(n)))
    parts = FI.part_digests(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length"), 10).collect()
    want = {(f"f {n}.bin", k): hashlib.sha256(bytes(range(n))[10 * k : 10 * k + 10]).hexdigest() for n in (1, 9, 10, 11, 35) for k in range(-(-n // 10))}
    assert {(unquote(r["path"]).rsplit("/", 1)[1], r["part"]): r["sha"] for r in parts} == want
    first = {r["path"]: r["digest"] for r in FI.file_hashes(spark, [str(tmp_path)], part_bytes=10).collect()}
    data = bytes(range(35))
    (tmp_path / "f 35.bin").write_bytes(data[10:20] + data[:10] + data[20:])
    after = {r["path"]: r["digest"] for r in FI.file_hashes(spark, [str(tmp_path)], part_bytes=10).collect()}
    assert len(first) == 5 and [p for p in first if first[p] != after[p]] == [p for p in first if "35" in p]


def test_score_precedence(spark):
    rows = [('{"scores": {"composite": 2}, "mean_score": 1}',), ('{"oof_pearson": 0.5, "local_cv_score": 9}',), ("{}",), ("not json",)]
    v, s = SI.pick_score(F.col("m"))
    got = spark.createDataFrame(rows, "m string").select(v, s).collect()
    assert [tuple(r) for r in got] == [(2.0, "scores.composite"), (0.5, "oof_pearson"), (None, None), (None, None)]
