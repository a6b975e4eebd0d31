import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from foldline.llm import merkle_manifest
from foldline.llm.queries import op11_merkle_manifest
from tests.llm.helpers import DOC_SCHEMA


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[2], row[3], row[4], text)))


def climb(nodes):
    """Levels of digests from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 16 * 16
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 16])))
        at //= 16
    return out


def slow_manifest(docs):
    docs = [(i, t, s, lg, n) for i, t, lg, s, n, *_ in docs]
    by = {}
    for d in docs:
        by.setdefault(d[2], []).append(d)
    trees, names = {}, sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        rows = sorted(by[s], key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(d, d[1])))
        trees[s] = rows, climb([leaf_of(d, d[1]) for d in rows])
    top = climb([trees[s][1][-1][0] for s in names])
    out = []
    for g, s in enumerate(names):
        rows, levels = trees[s]
        for at, d in enumerate(rows):
            path = siblings(levels, at) + siblings(top, g)
            changed = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0
            text = d[1] if d[1] is None or not changed else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d[1])
            folded = leaf_of(d, text)
            for before, after in path:
                folded = H(before + folded + after)
            out.append((d[0], levels[0][at], levels[-1][0], top[-1][0], H("".join(b + a for b, a in path)), folded, folded == top[-1][0]))
    return out


def fixture():
    rng = random.Random(3)
    rows = [(i, f"Text {i} Äß" if i % 7 else f"plain {i}", "en", "hot", i) for i in range(300)]
    rows += [(i, "Same", "de", f"s{i % 40}", 4) for i in range(300, 400)]
    rows += [(500, None, None, None, None), (501, "", "", "", 0), (None, "no id", "en", "hot", 5), (None, "no id", "en", "hot", 5)]
    rows += [(7, "Tie A", "en", "hot", 5), (7, "Tie b", "en", "hot", 5), (20, "Text 20 Äß", "en", "hot", 20), (600, "Long " * 200_000, "en", "lone", None)]
    rows += [(i, "x", "en", "exact", 1) for i in range(1000, 1256)]
    rng.shuffle(rows)
    return [(*r, 1, None) for r in rows]


@pytest.mark.parametrize("rows", [fixture(), [(5, "One", "en", "a", 3, 1, None)], [(i, "A", "en", None, 1, 1, None) for i in range(17)], []])
def test_query_equals_brute_force(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOC_SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op11_merkle_manifest(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    key = str
    assert sorted(got, key=key) == sorted(slow_manifest(rows), key=key)
    if rows:
        assert any(r[6] for r in got)


def test_manifest_of_any_columns(spark):
    df = spark.createDataFrame([(f"r{i:03d}", i % 3) for i in range(60)], "name string, pos int")
    rows = df.select(F.col("pos").cast("string").alias("source"), F.col("name").alias("key"), merkle_manifest.row_digest([F.col("name")]).alias("leaf"), "name", F.col("pos").alias("n"))
    found = merkle_manifest.manifest(rows, ["name", "n"])
    assert found.columns == ["name", "n", "leaf", "subroot", "root", "path"] and found.count() == 60
    assert found.filter(merkle_manifest.fold(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()
    assert found.select("root").distinct().count() == 1 and found.select("subroot").distinct().count() == 3
