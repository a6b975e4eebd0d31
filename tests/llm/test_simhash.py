import random

from foldline.llm.graph import connected_components
from foldline.llm.queries import op2_simhash_dedup
from foldline.llm.simhash_dedup import link_classes, near_duplicates
from tests.llm.helpers import SF, components, docs_frame, slow_simhash, spark_rows


def test_query_equals_brute_force(spark):
    docs = spark_rows(spark, "documents")
    fp = {d.doc_id: slow_simhash(d.text) for d in docs}
    want = components(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash_dedup(spark, SF).collect()}
    assert got == {d: (f"{fp[d]:016x}", want[d]) for d in fp}


def test_links_of_a_dense_clump_and_of_chains(spark):
    """Random fingerprints, a clump of near ones and chains of small steps: components as over all pairs."""
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(150)]
    centre = rng.getrandbits(64)
    fps += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for _ in range(150)]
    at = rng.getrandbits(64)
    for _ in range(60):
        for b in rng.sample(range(64), 4):
            at ^= 1 << b
        fps.append(at)
    fps = {i: f for i, f in enumerate(dict.fromkeys(fps))}
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()]
    edges = link_classes(spark.createDataFrame(rows, "node long, fp long"))
    want = components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert {i: got.get(i, i) for i in fps} == want
    assert edges.count() < 6 * len(fps)


def test_edge_rows(spark):
    long_text = "word " * 70_000
    rows = [(4, None), (2, ""), (9, " \t\n"), (None, "a b c d e"), (7, "A b c d e"), (7, "A b c d e"), (8, long_text), (3, long_text + "x"), (None, "only here")]
    got = near_duplicates(docs_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    found = sorted((r.doc_id or -1, r.component_id or -1) for r in got)
    assert found == [(-1, -1), (-1, 7), (2, 2), (3, 3), (4, 2), (7, 7), (7, 7), (8, 3), (9, 2)]
    assert near_duplicates(docs_frame(spark, [])).count() == 0
