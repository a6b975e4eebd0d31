import random
from collections import defaultdict

import numpy as np

from foldline.llm import line_dedup
from foldline.llm.line_dedup import MIN_BYTES, Powers, cut_out, dedup_lines, spans
from foldline.llm.queries import op1_line_dedup
from tests.llm.helpers import SF, docs_frame, spark_rows


def runs(spans, least=MIN_BYTES):
    """Merged spans (touching ones merge) of at least ``least`` bytes."""
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= least]


def own_spans(data):
    _, _, _, s, e, _ = spans([data], Powers())
    return list(zip(s.tolist(), e.tolist()))


def chunks(data):
    """(span, chunk bytes with a mark between its two spans) for each span."""
    own = own_spans(data)
    return [((a, b), (data[a:b], data[slice(*own[i + 1])] if i + 1 < len(own) else None)) for i, (a, b) in enumerate(own)]


def slow_dedup(rows):
    """rows (doc_id, text): texts after the same cuts, with dictionaries of whole chunks."""
    docs, places, count, long = {r: r[1].encode() for r in rows if r[1] is not None}, defaultdict(list), defaultdict(int), {}
    for row in rows:
        if row[1] is not None:
            for _, chunk in chunks(docs[row]):
                count[chunk] += 1
    for (doc, _), data in docs.items():
        own, hit = chunks(data), set()
        for i, (_, chunk) in enumerate(own):
            if count[chunk] > 1:
                hit |= {i, min(i + 1, len(own) - 1)}
        seen = [own[i][0] for i in sorted(hit)]
        long[doc, data] = [(a, b) for a, b in seen if any(x <= a and b <= y for x, y in runs(seen))]
    for row in rows:
        if row[1] is not None:
            for a, b in long[row[0], docs[row]]:
                places[docs[row][a:b]].append((row[0] if row[0] is not None else 2**63 - 1, a))
    out = []
    for doc, text in rows:
        if text is None:
            out.append(None)
            continue
        data = text.encode()
        place = doc if doc is not None else 2**63 - 1
        again = [(a, b) for a, b in long[doc, data] if (place, a) > min(places[data[a:b]])]
        for a, b in reversed(runs(again)):
            while b < len(data) and data[b] in b" \t\n\x0b\x0c\r":
                b += 1
            data = data[:a] + data[b:]
        out.append(data.decode())
    return out


def test_query_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_ROOM", 1 << 13)  # no chunk passes by mistake
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = [(r.doc_id, r.text) for r in spark_rows(spark, "documents", sf)]
        want = dict(zip([d for d, _ in rows], slow_dedup(rows)))
        got = {r.doc_id: r.text for r in op1_line_dedup(spark, sf).collect()}
        assert got == want
        assert sum(len(t) for t in want.values()) < sum(len(t) for _, t in rows)


def test_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_FILTER_BITS", 9)  # nearly every chunk passes by mistake
    rng = random.Random(3)
    common = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(40)]
    rows = [(i, "\n".join(" ".join(rng.choice(common) for _ in range(2)) for _ in range(200))) for i in range(40)]
    rows += [(r.doc_id + 100, r.text) for r in spark_rows(spark, "documents", SF)]
    got = {r.doc_id: r.text for r in dedup_lines(docs_frame(spark, rows)).collect()}
    assert got == dict(zip([d for d, _ in rows], slow_dedup(rows)))


def test_boundaries_come_back_after_an_insertion():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000))
    own = {text.encode()[a:b] for a, b in own_spans(text.encode())}
    changed = (text[:5000] + " some new words " + text[5000:]).encode()
    assert len(own & {changed[a:b] for a, b in own_spans(changed)}) > 0.97 * len(own)
    many = [text.encode(), b"", b" \n", changed, b"one"]
    data, begin, of, s, e, h = spans(many, Powers())
    for i, t in enumerate(many):
        mine = of == i
        assert list(zip((s[mine] - begin[i]).tolist(), (e[mine] - begin[i]).tolist())) == own_spans(t)
        assert h[mine].tolist() == spans([t], Powers())[5].tolist()


def test_planted_passages(spark):
    rng = random.Random(9)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(3, 9))) for _ in range(n))

    passages = [prose(60) for _ in range(30)]
    rows = [(i, prose(80) + " " + passages[i % 30] + " " + prose(80)) for i in range(90)]
    got = {r.doc_id: r.text for r in dedup_lines(docs_frame(spark, rows)).collect()}
    share = []
    for i, text in rows:
        if i < 30:
            assert got[i] == text
        else:
            share.append(sum(w in got[i].split() for w in passages[i % 30].split()) / 60)
            assert got[i].startswith(text[:300]) and got[i].endswith(text[-300:])
    assert max(share) < 0.75 and sum(share) < 0.25 * len(share)


def test_edge_rows(spark):
    block = "\n".join(f"line number {i} of the block that repeats" for i in range(12))
    rows = [(3, block), (1, block + "\nand an end"), (None, block), (None, None), (5, ""), (5, " \n "), (7, block + "\n" + block), (8, "short short short short"), (8, "short short short short"), (9, "é" * 40_000), (10, "wörd " * 40_000)]
    got = dedup_lines(docs_frame(spark, rows))
    assert got.columns == [*docs_frame(spark, rows).columns, "cut_runs"]
    found = [(r.doc_id, r.text, r.piece) for r in got.collect()]
    assert len(found) == len(rows) and all(p == 7 for _, _, p in found)
    texts = defaultdict(list)
    for i, t, _ in found:
        texts[i].append(t)
    assert texts[1] == [block + "\nand an end"] and texts[8] == ["short short short short"] * 2 and sorted(texts[5]) == ["", " \n "]
    assert len(texts[3][0]) < 60 and None in texts[None] and len(texts[7][0]) < 120 and texts[9] == ["é" * 40_000]
    assert dedup_lines(docs_frame(spark, [])).count() == 0
    assert cut_out(b"abc def ghi jkl", [{"start": 4, "end": 11}], 3) == (b"abc jkl", 1)


def test_stretches_are_the_long_runs():
    rng = np.random.default_rng(5)
    for _ in range(300):
        start = np.sort(rng.integers(0, 60, rng.integers(0, 12)))
        end = start + rng.integers(1, 9, len(start))
        kept = line_dedup._long_runs(start, end, 10)
        got = list(zip(*(v.tolist() for v in line_dedup._stretches(start, end, 10))))
        assert got == runs(list(zip(start[kept].tolist(), end[kept].tolist())), 10)
        assert line_dedup._without(b"x" * 80, got) == (b"x" * (80 - sum(b - a for a, b in got)), len(got))
