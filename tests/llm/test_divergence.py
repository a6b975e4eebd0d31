import random
import re
from collections import Counter

import pytest

from foldline.llm import source_divergence
from foldline.llm.queries import op13_source_divergence
from tests.llm.helpers import DOC_SCHEMA


def slow_audit(docs, min_docs=3, most=200):
    docs = [(lg or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for _, t, lg, s, *_ in docs]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for d in mine for w in set(d[2]))
        kept = [w for w in df if df[w] >= min_docs]
        count = {s: Counter(w for d in mine if d[1] == s for w in d[2]) for s in {d[1] for d in mine}}
        whole = sum(count.values(), Counter())

        def shares(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 1) // (n + len(kept)) for w in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        for s in count:
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in count if o != s]
            terms = [((p[s][w] - q[w]) ** 2 // q[w], w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, found, to in (("pair", pairs, None), ("term", terms, most)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[:to])]
    return sorted(out)


def fixture():
    rng = random.Random(5)
    words = [a + b for a in "abcdefgh" for b in "ijklmnÄéß東"] + ["Hot"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40))) + ", 12 x_y", rng.choice(["en", "en", "de"]), rng.choice(["hot", "hot", "a", "b", "c", "d"]), 1) for i in range(200)]
    rows += [(300, None, None, None, None), (301, "", "", "", 0), (302, "12 34", "xx", "s1", 0), (303, "once", "xx", "s2", 0), (303, "once", "xx", "s2", 0)]
    rows += [(304, "Same same", "yy", "s", 0)] * 3 + [(305, "word " * 300_000, "en", "a", 1), (306, "z" * 100_000, "en", None, 1)]
    return [(*r, 7, None) for r in rows]


@pytest.mark.parametrize("bits", [64, 5, 1])
def test_equals_brute_force(spark, bits):
    rows = fixture()
    docs = spark.createDataFrame(rows, DOC_SCHEMA).withColumnRenamed("piece", "digest").withColumnRenamed("batch", "n").repartition(6)
    assert sorted(map(tuple, source_divergence.audit(docs, bits=bits).collect())) == slow_audit(rows)


def test_few_ranks_with_ties(spark, monkeypatch):
    rows = [(i, "tie ties tied tier tiny", "en", "a", 1, 1, None) for i in range(3)] + [(i, "other", "en", "b", 1, 1, None) for i in range(3)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    assert sorted(map(tuple, source_divergence.audit(docs, most=2).collect())) == slow_audit(rows, most=2)


def test_small_stretches_and_matrices(spark, tmp_path, monkeypatch):
    rows = fixture()
    monkeypatch.setattr(source_divergence, "STRETCH_BYTES", 500)
    monkeypatch.setattr(source_divergence, "SENT_BYTES", 2000)
    monkeypatch.setattr(source_divergence, "PAIR_CELLS", 100)
    spark.createDataFrame(rows, DOC_SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op13_source_divergence(spark, str(tmp_path)).collect())) == slow_audit(rows)


def test_empty_table(spark):
    assert source_divergence.audit(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**13, 3 * 10**13, 10**9)], "c long, t long, v long")
    assert df.select(source_divergence.share(df.c, df.t, df.v)).first()[0] == 1 + 10**9 * (10**13 + 1) // (3 * 10**13 + 10**9)
