import itertools

import numpy as np

from foldline.llm.hilbert_neighbours import hilbert_keys, nearest
from foldline.llm.queries import op7_hilbert_neighbours
from tests.llm.helpers import spark_rows


def slow_nearest(rows, k=20):
    """rows (id, vector): id -> [(vec_id, score)] for ids divisible by 20."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for i, v in good:
        if i % 20 == 0:
            score = (x * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_keys_walk_through_neighbouring_cells():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        key = hilbert_keys(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    want = slow_nearest([(r.vec_id, r.embedding) for r in spark_rows(spark, "embeddings", sf)])
    got = {}
    for r in op7_hilbert_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21)) and rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        true = dict(want[q])
        hits += sum(v in true for _, v, _ in rows)
        assert all(abs(true[v] - s) < 1e-12 for _, v, s in rows if v in true)
    assert hits >= 0.9 * 20 * len(want)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (20, [None, 1.0]), (40, [inf, 1.0]), (None, [1.0, 1.0]), (5, [1.0, 1.0, 1.0]), (60, [-1.0, 0.5])]
    rows += [(i, [0.5, 0.5]) for i in range(100, 200)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "id long, v array<float>, node int")
    got = {}
    for r in nearest(frame, frame.filter("id % 20 = 0").select("id")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = slow_nearest([r for r in rows if r[0] != 5])
    assert got == want and set(got) == {0, 60, 100, 120, 140, 160, 180}
    assert nearest(frame.limit(0), frame.select("id")).count() == 0
    assert nearest(frame, frame.limit(0).select("id")).count() == 0
    few = frame.filter("id in (0, 60)")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in nearest(few, few.select("id")).collect()) == [(0, 1, 60), (60, 1, 0)]
