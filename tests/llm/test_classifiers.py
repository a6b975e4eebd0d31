"""Toxicity, language codes and personal data: held-out accuracy, brute force and edge rows."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from foldline.llm import language_codes, pii_spans, toxicity
from foldline.llm.queries import op5_toxicity, op8_pii_spans, op10_language_codes
from tests.llm.helpers import SF, docs_frame, spark_rows

FULL = "/root/testdata/sf0.1"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_toxicity_held_out(spark):
    got = {r.doc_id: r for r in op5_toxicity(spark, FULL).collect()}
    labels = {r.doc_id: r.toxic for r in spark_rows(spark, "labels", FULL)}
    assert len(got) == spark.read.parquet(f"{FULL}/documents.parquet").count()
    assert all(r.held_out == held_out(d) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    test = [(labels[d], got[d].predicted) for d in labels if held_out(d)]
    hits, toxic = sum(y and p for y, p in test), sum(y for y, _ in test)
    false = sum(p and not y for y, p in test)
    assert hits > 0.5 * toxic and false < 0.005 * len(test)


def test_toxicity_windows_cover_the_text():
    gains = toxicity.Gains(b"x" * 64, b"y" * 32 + b" zebra quagga \xff" * 2, 4, block=3)
    words = ["plain"] * 57 + ["zebra", "quagga"]
    assert len(gains(" ".join(words))) == 15
    assert gains(" ".join(words))[-1] > 0 and not gains(" ".join(words))[:14].any()
    assert len(gains("")) == len(gains(None)) == 0


def test_toxicity_phrase_across_a_boundary():
    gains = toxicity.Gains(b"x" * 46 + b"s" * 64, b" zebra quagga \xff" + b"y" * 30 + b"\xff" + b"s" * 64, 4, block=2)
    whole, halves = (gains(" ".join(["plain"] * n + ["zebra", "quagga"] + ["plain"] * 9)) for n in (9, 11))
    assert halves.max() >= whole.max() > 0


def test_toxicity_sample_has_whole_texts(spark):
    rows = [(i, f"{i} " + "word " * 2_000 + "the end") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    found = toxicity.labelled_sample(docs_frame(spark, rows), labels)
    assert len(found) > 20 and all(t.endswith("the end") for t, _ in found)
    few = toxicity.labelled_sample(docs_frame(spark, rows), labels, size=35_000)
    assert {y for _, y in few} == {0, 1} and len(few) == 6 and set(few) <= set(found)


def test_toxicity_edge_rows(spark):
    rows = [(1, None), (1, ""), (None, "some words here"), (2, "word " * 60_000)]
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs_frame(spark, rows), labels)
    got = toxicity.score(docs_frame(spark, rows), model).collect()
    assert [(r.doc_id, r.text, r.piece) for r in got] == [(i, t, 7) for i, t in rows]
    assert all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score
    assert toxicity.score(docs_frame(spark, []), model).count() == 0
    assert toxicity.fit(docs_frame(spark, []), labels).weights


def test_language_held_out(spark):
    docs = {r.doc_id: r for r in spark_rows(spark, "documents", FULL)}
    got = op10_language_codes(spark, FULL).collect()
    assert len(got) == len(docs) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert np.mean(right) > 0.97


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 6, 9, 30):
        code = language_codes.codewords(n)
        assert set(np.unique(code)) <= {-1, 1} and not (np.abs(code.sum(axis=0)) == n).any()
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= max(1, code.shape[1] // 4)


def slow_decode(model, text):
    """Language, score and margin with every n-gram and every bit written out."""
    raw, count = text.lower().encode(), {}
    for n in language_codes.ORDERS:
        for at in range(len(raw) - n + 1):
            key = 0
            for k in range(n):
                key = (key * 0x01000193 % 2**32) ^ (raw[at + k] + (k + 1) * 257)
            cell = (key * 0x9E3779B1 % 2**32) >> 20
            count[cell] = count.get(cell, 0) + 1
    total = sum(count.values())
    f = [w[-1] + sum(w[c] * (k / total) ** 0.5 for c, k in count.items()) for w in model.weights.tolist()]
    all_bits = sum(model.reliability)
    loss = [sum(r * np.log1p(np.exp(-c * v)) for c, v, r in zip(code, f, model.reliability)) / all_bits for code in model.codewords.tolist()]
    near = sorted(range(len(loss)), key=loss.__getitem__)
    return model.languages[near[0]], 1 / sum(np.exp((loss[near[0]] - x) * len(f)) for x in loss), loss[near[1]] - loss[near[0]]


def test_language_decoder_equals_brute_force(spark):
    docs = [r for r in spark_rows(spark, "documents") if r.text and r.lang]
    model = language_codes.train([(r.text, r.lang) for r in docs[:60]])
    many = language_codes.train([(r.text, r.lang + r.source) for r in docs[:60]])
    texts = [r.text for r in docs[60:75]] + ["a", "\u00e9t\u00e9", "\u65e5\u672c" * 40, docs[0].text * 3]
    for m in (model, many):
        for text in texts:
            lang, score, unsure, margin = language_codes.decode(m, text)
            want = slow_decode(m, text)
            assert lang == want[0] and np.allclose([score, margin], want[1:], atol=1e-9) and unsure == (want[2] < 0.05)


def test_language_sample_is_whole_texts_of_all_languages(spark):
    rows = [(i, f"l{i % 500:03d}", f"words of {i % 500} " + "x" * (i % 7)) for i in range(3_000)] + [(9_000 + k, "long", "long text " * 20_000) for k in range(9)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("a.b", F.lit(1))
    known = {(t, lang) for i, lang, t in rows if not held_out(i)}
    got = language_codes.labelled_sample(docs, 1_000, 400_000)
    assert set(got) <= known and {lang for _, lang in got} == {lang for _, lang in known} and len(got) == len(set(got)) <= 3_000
    assert sum(lang == "long" for _, lang in got) == 1  # its shortest text, though longer than the room of a language
    assert got == language_codes.labelled_sample(docs.repartition(7), 1_000, 400_000)
    model = language_codes.train([("the house and the tree", "en"), ("das Haus und der Baum", "de")] * 15)
    assert language_codes.predict(docs.limit(5), model).columns == [*docs.columns, "lang_pred", "score", "ambiguous", "margin"]


def test_language_edge_rows(spark):
    rows = [(1, None), (2, "12 34 !"), (None, "the house"), (4, "a" * 300_000), (4, "")]
    model = language_codes.train([("the house and the tree", "en"), ("das Haus und der Baum", "de")] * 15)
    got = language_codes.predict(docs_frame(spark, rows), model).collect()
    assert [r.lang_pred == "und" for r in got] == [True, True, False, False, True]
    assert got[2].lang_pred == "en" and got[0].score == 0 and got[0].ambiguous
    assert language_codes.predict(docs_frame(spark, []), model).count() == 0
    empty = language_codes.fit(docs_frame(spark, rows))  # no lang is set
    assert {r.lang_pred for r in language_codes.predict(docs_frame(spark, rows), empty).collect()} == {"und"}
    one = language_codes.train([("the house", "en")])
    assert language_codes.decode(one, "anything") == ("en", 1.0, False, 1.0)


def slow_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii_spans.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_patterns_equal_plain_ones(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("a@@..-- 0123456789+()%é\n") for _ in range(rng.randrange(40))) for _ in range(20_000)]
    for t in texts + [r.text for r in spark_rows(spark, "documents")]:
        assert pii_spans.base_spans(t) == slow_spans(t)
    assert pii_spans.base_spans("1" * 50_000 + "@" * 50_000 + "a." * 50_000) == []
    assert pii_spans.luhn("4111111111111111") and not pii_spans.luhn("4111111111111112")


def test_personal_data_query(spark):
    texts = {r.doc_id: r.text for r in spark_rows(spark, "documents", "/root/testdata/sf0.01")}
    got = op8_pii_spans(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts)
    for r in got:
        base = slow_spans(texts[r.doc_id])
        joined = [":".join(map(str, s)) for s in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in base) for k in pii_spans.KINDS]
        assert set(joined) <= set(r.spans.split(",")) | {""}


def test_gradient_is_that_of_the_likelihood():
    """The forward-backward sums against finite differences."""
    rng = np.random.default_rng(2)
    text, gold = "ab 12 345-6789", [(0, 0, 0), (1, 4, 4)]
    tokens = pii_spans.islands("x1" + text)[0][-5:]
    tokens = [(a - 2, b - 2) for a, b in tokens][1:] if len(tokens) > 5 else [(0, 2), (3, 5), (6, 9), (9, 10), (10, 14)]
    cand = pii_spans.candidates(text, tokens)
    model = pii_spans.Model(rng.normal(size=(5, pii_spans.FEATURES)) * 0.1, rng.normal(size=(5, 5)) * 0.1)
    like, seg, moves = pii_spans.gradient(model, cand, gold, 5)
    for at in ((0, 4), (4, 0), (4, 4)):
        model.moves[at] += 1e-5
        assert abs((pii_spans.gradient(model, cand, gold, 5)[0] - like) / 1e-5 - moves[at]) < 1e-3
        model.moves[at] -= 1e-5
    (key, g) = next((k, v) for k, v in seg.items() if k == (1, 4))
    f = next(f for f in cand[key] if sum(f in c for c in cand.values()) == 1)
    model.weights[4, f] += 1e-5 / cand[key].count(f)
    assert abs((pii_spans.gradient(model, cand, gold, 5)[0] - like) / 1e-5 - g[4]) < 1e-3


def test_model_adds_spans_the_patterns_miss(spark):
    docs = [r.text for r in spark_rows(spark, "documents", FULL)]
    model = pii_spans.train([t for t in docs if re.search("[0-9@]", t)][:1500], rounds=4, limit=250)
    base, every = pii_spans.find(model, "write to (212) 555-0134 or joe.doe@example.com, +1 (212) 555-0135 4532015112830366 end")
    assert ("email", 27, 46) in base and ("phone", 9, 23) in every and ("card", 66, 82) in every
    assert pii_spans.find(model, None) == pii_spans.find(model, "") == ([], [])
    assert pii_spans.find(model, "no data in 1999 here") == ([], [])


def test_personal_data_edge_rows(spark):
    rows = [(1, None), (None, ""), (2, "a@b.cd " * 20_000), (2, "1 " * 5_000)]
    model = pii_spans.train([])
    got = pii_spans.mark(docs_frame(spark, rows), model).collect()
    assert [len(r.base_spans) for r in got] == [0, 0, 20_000, 0]
    assert pii_spans.mark(docs_frame(spark, []), model).count() == 0


def test_long_digits_and_long_words_end():
    assert pii_spans.base_spans("0" * 5000 + ".1.1.1 " + "9" * 5000 + ".1.1.1 0300.1.1.1") == [("ip", 0, 5006)]
    text = "x" * 1_000_000 + " 1 a@b.c " + "y" * 1_000_000
    assert [[text[s:e] for s, e in g] for g in pii_spans.islands(text)] == [["1", "a", "@", "b", ".", "c"]]
    assert pii_spans.base_spans(text) == [("email", 1_000_003, 1_000_008)]
    many = "1.2.3.4 x " * 20_000
    assert pii_spans.islands(many, pii_spans.base_spans(many)) == []


def test_islands_equal_plain_ones():
    rng = np.random.default_rng(7)
    pattern = re.compile(r"\S*[0-9@]\S*(?:[^\S\n]{1,2}\S*[0-9@]\S*)*")
    for _ in range(500):
        text = "".join(rng.choice(list("ab1@. \t\n-"), rng.integers(0, 40)))
        taken = sorted(("ip", int(a), int(a) + 3) for a in rng.integers(0, 40, rng.integers(0, 4)))
        want = []
        for m in pattern.finditer(text):
            group = []
            for t in pii_spans._TOKEN.finditer(text, *m.span()):
                if any(t.start() < b and a < t.end() for _, a, b in taken):
                    want += [group] if group else []
                    group = []
                else:
                    group.append(t.span())
            want += [group] if group else []
        assert pii_spans.islands(text, taken) == want


def test_toxicity_training_holds_few_numbers():
    """Copies are found by sorted numbers, with the result of a plain set and a fraction of its memory."""
    import tracemalloc

    rng = np.random.default_rng(4)
    texts = [b" ".join(b"w%d" % v for v in rng.integers(0, 10**6, 1500)) for _ in range(200)]
    texts += [texts[3], texts[5][:4000] + b" " + texts[7][:200], b"", b"one", b"one"]
    seen, want = set(), []
    for text in texts:
        w = text.split()
        own = {hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))}
        if len(own & seen) <= 0.3 * len(own):
            want.append(text)
        seen |= own
    windows = len(seen)
    del seen
    tracemalloc.start()
    got = toxicity._without_copies(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and len(got) < len(texts)
    assert peak < 30 * windows
