import corpus_pipeline
from foldline.llm import line_dedup, toxicity
from foldline.llm.queries import TOXIC_SCORE
from foldline.session import cut_lineage
from tests.llm.helpers import SF, components, docs_frame, slow_simhash, spark_rows
from tests.llm.test_decontamination import slow_leaks
from tests.llm.test_line_dedup import slow_dedup
from tests.llm.test_packing import check_layout, slow_best_fit


def test_stages_equal_brute_force(spark, monkeypatch):
    """Every stage on the rows that the stage before has kept, against its twin."""
    monkeypatch.setattr(line_dedup, "FILTER_ROOM", 1 << 13)
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    kept = {d: r.text for d, r in rows.items() if r.score < TOXIC_SCORE}

    now = cut_lineage(stage["toxicity"](spark, docs, SF))
    assert now.columns == columns and {r.doc_id: r.text for r in now.collect()} == kept

    kept = dict(zip(kept, slow_dedup(list(kept.items()))))
    now = cut_lineage(stage["line_dedup"](spark, now, SF))
    got = now.collect()
    assert now.columns == columns and {r.doc_id: r.text for r in got} == kept
    assert all(r.n_chars == len(r.text) for r in got if r.text != rows[r.doc_id].text)

    fp = {d: slow_simhash(t) for d, t in kept.items()}
    root = components(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    kept = {d: t for d, t in kept.items() if root[d] == d}
    now = cut_lineage(stage["simhash_dedup"](spark, now, SF))
    assert now.columns == columns and {r.doc_id: r.text for r in now.collect()} == kept

    bad = {d for d, _ in slow_leaks(kept.items(), [(r.item_id, r.text) for r in spark_rows(spark, "benchmark")])}
    kept = {d: t for d, t in kept.items() if d not in bad}
    now = cut_lineage(stage["template_decontamination"](spark, now, SF))
    assert now.columns == columns and {r.doc_id: r.text for r in now.collect()} == kept

    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(kept)
    assert check_layout([(r.sequence_id, r.offset, r.length) for r in packed], 4096) == slow_best_fit([r.length for r in packed], 4096)


def test_edge_rows(spark):
    docs = docs_frame(spark, [(1, None), (2, ""), (None, "a b"), (None, "a b"), (3, "c d e f g h"), (3, "c d e f g h"), (4, "C d e f g h")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        n = out.count()
        assert n == (3 if name == "simhash_dedup" else 7), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 7
