import random
import re
from collections import defaultdict

from foldline.llm import template_decontamination as T
from foldline.llm.queries import op4_template_decontamination
from tests.llm.helpers import SF, docs_frame, spark_rows

ITEM = "Alice has 3 red apples and Bob has 5 green pears in the big basket. How many fruits does Alice carry home after 3 days?"


def slow_tokens(text):
    """(token, slot kind or None) with the rules written out one token at a time."""
    out, begins = [], True
    for t in re.findall(r"[.!?\n]|[^\W_]+(?:[.,][0-9]+)*", text or ""):
        if t in ".!?\n":
            begins = True
            continue
        low = t.lower()
        kind = "n" if t[0].isdigit() or low in T.NUMBER_WORDS else "u" if low in T.UNITS else "c" if t[0].isupper() and not begins else None
        out.append((low, kind))
        begins = False
    return out


def slow_leaks(docs, items, window=8, coverage=0.5, run=24):
    """Template windows with consistent slots, and windows of the tokens themselves."""
    found = slow_excerpts(docs, items, window, coverage, run)
    for item, itext in items:
        a = slow_tokens(itext)
        width = min(window, len(a))
        good = [p for p in range(len(a) - width + 1) if 2 * sum(k is None for _, k in a[p : p + width]) >= width] if width else []
        for doc, dtext in docs:
            b = slow_tokens(dtext)
            by = defaultdict(set)
            index = defaultdict(list)
            for q in range(len(b) - width + 1):
                index[tuple(k or t for t, k in b[q : q + width])].append(q)
            for p in good:
                for q in index[tuple(k or t for t, k in a[p : p + width])]:
                    by[q - p].add(p)
            for d, ps in by.items():
                pairs = {(a[i], b[i + d]) for p in ps for i in range(p, p + width) if a[i][1]}
                if len(pairs) == len({x for x, _ in pairs}) and len(ps) >= coverage * len(good):
                    found.add((doc, item))
    return found


def slow_excerpts(docs, items, window, coverage, run):
    found = set()
    for item, itext in items:
        a = [t for t, _ in slow_tokens(itext)]
        n = len(a) - window + 1
        for doc, dtext in docs if n > 0 else []:
            b, by, index = [t for t, _ in slow_tokens(dtext)], defaultdict(int), defaultdict(list)
            for q in range(len(b) - window + 1):
                index[tuple(b[q : q + window])].append(q)
            for p in range(n):
                for q in index.get(tuple(a[p : p + window]), ()):
                    by[q - p] += 1
            if by and max(by.values()) >= min(coverage * n, run):
                found.add((doc, item))
    return found


def test_query_equals_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        docs = [(r.doc_id, r.text) for r in spark_rows(spark, "documents", sf)]
        items = [(r.item_id, r.text) for r in spark_rows(spark, "benchmark", sf)]
        if sf != SF:
            docs = [d for d in docs if len(d[1] or "") < 6_000]
        got = {(r.doc_id, r.item_id) for r in op4_template_decontamination(spark, sf).collect()}
        want = slow_leaks(docs, items)
        assert got & {(d, i) for d, _ in docs for i, _ in items} == want and want


def test_reparameterised_and_inconsistent(spark):
    bench = spark.createDataFrame([(7, ITEM), (8, ITEM.replace("3", "9")), (9, None), (10, ""), (11, "1 2 3 km"), (None, "short odd phrase here")], "item_id long, text string")
    same = ITEM.replace("Alice", "Carol").replace("3", "12")
    rows = [
        (1, "Some words before. " + ITEM + " And after."), (2, "Intro text. " + same), (3, "Intro. " + ITEM.replace("after 3", "after 4")),
        (4, ITEM[:60]), (5, None), (6, ""), (6, "1 2 3 km"), (None, "x " * 3000 + ITEM), (None, "a short odd phrase here too"), (1, "Some words before. " + ITEM + " And after."),
    ]
    docs = docs_frame(spark, rows)
    got = [(r.doc_id, r.item_id, r.kind) for r in T.leaks(docs, bench).collect()]
    assert len(got) == 5 and set(got) == {(3, 7, "excerpt"), (None, 7, "verbatim"), (None, None, "verbatim"), (1, 7, "verbatim"), (2, 7, "reparameterised")}
    kept = T.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t or "") for i, t in [rows[k] for k in (3, 4, 5, 6)])
    assert T.leaks(docs_frame(spark, []), bench).count() == 0
    assert T.without_leaks(docs, bench.limit(0)).count() == len(rows)


def test_every_item_of_a_template(spark):
    other = ITEM.replace("5", "6").replace("Bob", "Dan")
    same = "Alice has 3 red apples and Bob has 3 green pears in the big basket. How many fruits does Alice carry home after 3 days?"
    bench = spark.createDataFrame([(3, same), (7, ITEM), (9, other), (12, other)], "item_id long, text string")
    rows = [(1, "Intro. " + ITEM), (2, "Intro. " + other), (3, "Intro. " + ITEM.replace("5", "8")), (4, "Intro. " + same)]
    got = {(r.doc_id, r.item_id, r.kind) for r in T.leaks(docs_frame(spark, rows), bench).collect()}
    assert got == {(1, 7, "verbatim"), (2, 9, "verbatim"), (2, 12, "verbatim"), (3, 7, "reparameterised"), (4, 3, "verbatim")}


def test_copies_that_slots_hide(spark):
    sums = "12 + 7 19 30 4 26 km 5 days 3"
    names = "Ada Bob Carl Dora Emil Fritz Gina Hugo Ida"
    long = " ".join(f"w{i}" for i in range(200))
    bench = spark.createDataFrame([(1, ITEM), (2, sums), (3, names), (4, long)], "item_id long, text string")
    rows = [
        (1, "INTRO. " + ITEM.upper()), (2, "intro " + ITEM.lower()), (3, "So " + sums + "."), (4, names.lower()), (5, long[200:380]),
        (6, long[200:300]), (7, ITEM.replace("How many", "How very many")), (8, ITEM[:60]), (9, sums.replace("19", "20")),
    ]
    docs = docs_frame(spark, rows)
    got = {(r.doc_id, r.item_id): r.kind for r in T.leaks(docs, bench).collect()}
    assert set(got) == slow_leaks(rows, [(r.item_id, r.text) for r in bench.collect()]) == {(1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (7, 1)}
    assert [got[1, 1], got[2, 1], got[3, 2], got[4, 3], got[5, 4]] == ["verbatim"] * 4 + ["excerpt"]
    assert {r.doc_id for r in T.without_leaks(docs, bench).collect()} == {6, 8, 9}


def test_tokens_of_joined_texts():
    """Scripts, digits of any kind, decimals, letters whose lower case has two letters or depends on its place."""
    rng, find = random.Random(1), T.Templates()
    slot = {T.NUMBER: "n", T.UNIT: "u", T.NAME: "c", T.LITERAL: None}
    letters = "aBz9.,!?\n _²٣İΣσςé-ßDžǅ½Ⅷ三💥 km0 7 "
    for _ in range(400):
        texts = ["".join(rng.choices(letters, k=rng.randrange(25))) for _ in range(3)] + [None, "", "3.5abc.7x two Km Three. Inches a,5,6.7 abc.5x.7"]
        data, first, start, end, kind, _, plain = find.find(texts)
        for i, text in enumerate(texts):
            own = slice(first[i], first[i + 1])
            tokens = [data[a:b].lower() for a, b in zip(start[own], end[own])]
            assert list(zip(tokens, map(slot.get, kind[own].tolist()))) == slow_tokens(text)
            assert [T._word_hash(t, find.powers) for t in tokens] == plain[own].tolist()
