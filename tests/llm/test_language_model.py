import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldline.llm import deleted_interpolation as D
from foldline.llm.exchange import pack_column, pack_keys, unpack_column, unpack_keys
from foldline.llm.queries import op6_deleted_interpolation
from tests.llm.helpers import SF, docs_frame, spark_rows, words_of


def slow_model(docs):
    """docs (text, train, aside): plain dictionaries; returns per text (n_tokens, n_known, base, score) and N."""
    texts = [words_of(t) + ["<end>"] for t, _, _ in docs]

    def count(keep):
        uni, bi, ctx = Counter(), Counter(), Counter()
        for w, d in zip(texts, docs):
            if keep(d):
                uni.update(w)
                bi.update(zip(["<s>", *w], w))
                ctx.update(["<s>", *w[:-1]])
        return uni, bi, ctx

    uni, bi, ctx = count(lambda d: d[1])
    u2, b2, c2 = count(lambda d: d[1] and not d[2])
    n, v, kept = sum(uni.values()), len(uni), sum(u2.values())
    uniform, cells = 1 / (v + 1), Counter()
    for w, d in zip(texts, docs):
        if d[1] and d[2]:
            for a, b in zip(["<s>", *w], w):
                pair, word = b2[a, b] / max(1, c2[a]) / uniform, u2[b] / max(1, kept) / uniform
                cells[int(D.bucket(np.array(c2[a]))), int(D._ratio_cell(np.array(pair))), int(D._ratio_cell(np.array(word)))] += 1
    weights = D.estimate([(*k, x) for k, x in sorted(cells.items())])
    out = []
    for w in texts:
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for a, b in zip(["<s>", *w], w):
            k = weights[int(D.bucket(np.array(ctx[a])))]
            score += math.log10(k[0] * bi[a, b] / max(1, ctx[a]) + k[1] * uni[b] / max(1, n) + k[2] * uniform)
        out.append((len(w), sum(uni[x] > 0 for x in w), base, score))
    return out, n


def test_query_equals_brute_force(spark):
    docs = spark_rows(spark, "documents")
    part = [zlib.crc32(str(d.doc_id).encode()) % 7 for d in docs]
    want, n = slow_model([(d.text, p != 2, p == 4) for d, p in zip(docs, part)])
    got = {r.doc_id: r for r in op6_deleted_interpolation(spark, SF).collect()}
    assert len(got) == len(docs)
    for d, p, w in zip(docs, part, want):
        r = got[d.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (p == 2, w[0], w[1], n)
        assert r.base_score == pytest.approx(w[2], rel=1e-9)
        assert r.score == pytest.approx(w[3], rel=1e-6)


def test_mixture_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in op6_deleted_interpolation(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_weights_are_those_of_likelihood():
    cells = [(3, 40, 9, 60), (3, 0, 9, 40), (5, 0, 0, 10)]
    w = D.estimate(cells)
    assert np.allclose(w.sum(axis=1), 1) and w[3, 0] > 0.5 and w[5, 2] > 0.99

    def like(x):
        return sum(n * math.log(x[0] * (2 ** ((a - 5) / 4) if a else 0) + x[1] * (2 ** ((b - 5) / 4) if b else 0) + x[2]) for _, a, b, n in cells[:2])

    best = like(w[3])
    for i, j in ((0, 1), (1, 0), (1, 2), (2, 1)):
        moved = w[3].copy()
        step = min(0.01, moved[i])
        moved[i] -= step
        moved[j] += step
        assert like(moved) <= best + 5e-3


def test_packed_arrays():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (unpack_keys(pack_keys(keys)) == keys).all() and len(unpack_keys(pack_keys(keys[:0]))) == 0
    assert (unpack_column(pack_column(np.arange(-5, 9)), np.int64) == np.arange(-5, 9)).all()


def test_edge_rows(spark, monkeypatch):
    rows = [(1, None), (1, ""), (None, "a b a"), (2, "A  b\tc"), (2, "a b c"), (3, "word " * 40_000)]
    train, aside = F.col("doc_id").isNotNull(), F.coalesce(F.col("doc_id") == 1, F.lit(False))
    monkeypatch.setattr(D, "BATCH_TOKENS", 3)  # many small rows
    got = D.score(docs_frame(spark, rows), train, aside).collect()
    want, n = slow_model([(t, i is not None, i == 1) for i, t in rows])
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 4), r.train_tokens) for r in got) == sorted((a, b, round(c, 6), round(d, 4), n) for a, b, c, d in want)
    assert D.score(docs_frame(spark, []), train, aside).count() == 0
    none = D.score(docs_frame(spark, rows), F.lit(False), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in none)
