import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from foldline.llm.best_fit_packing import pack, plan_bins
from foldline.llm.queries import op3_best_fit_packing, word_bpe
from tests.llm.helpers import SF, docs_frame, spark_rows


def slow_best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [(c, i) for i, c in enumerate(bins) if c >= x]
        if fits:
            bins[min(fits)[1]] -= x
        else:
            bins.append(capacity - x)
    return len(bins)


def check_layout(rows, capacity):
    """rows (sequence, offset, length): gapless from 0, never too long."""
    by = defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_plan_equals_piecewise_best_fit():
    rng = random.Random(3)
    for trial in range(200):
        capacity = rng.choice([10, 37, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(150))] + [rng.randint(1, capacity)] * (60 * (trial % 3))
        seen, rows = Counter(), []
        for length, rank, n, first, per, offset in plan_bins(Counter(lengths), capacity).tolist():
            assert rank == seen[length]
            seen[length] += n * per
            rows += [(first + b, offset + k * length, length) for b in range(n) for k in range(per)]
        assert seen == Counter(lengths)
        assert check_layout(rows, capacity) == slow_best_fit(lengths, capacity)


def test_encoder_equals_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, encode = Tokenizer.from_file(path), word_bpe()()
    rng = random.Random(1)
    alphabet = "abzABZ'éÉßñÑĐİΣς ık中́ \u0085 \x0b\x1c\n .,!-_<|>*1²٣½@#\"’`^~{}ſK"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(5000)]
    for t in [*texts, "", "<|endoftext|> a<|startoftext|>b", "it's I'LL they're", "DON'T 's"]:
        assert encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_query_round_trip(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d.doc_id: tok.encode(d.text or "", add_special_tokens=False).ids + [1] for d in spark_rows(spark, "documents")}
    rows = op3_best_fit_packing(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in rows) == sorted((d, k, at, len(t[at : at + 4096])) for d, t in ids.items() for k, at in enumerate(range(0, len(t), 4096)))
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert check_layout([(r.sequence_id, r.offset, r.length) for r in rows], 4096) == slow_best_fit([r.length for r in rows], 4096)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 9000), (3, "word " * 9000)]
    got = pack(docs_frame(spark, rows), word_bpe(), 1).collect()
    assert sum(r.length for r in got) == 1 + 1 + 3 + 2 * 9001
    assert check_layout([(r.sequence_id, r.offset, r.length) for r in got], 4096) == 5
    assert all(len(r.tokens) == r.length for r in got)
    assert pack(docs_frame(spark, []), word_bpe(), 1).count() == 0
