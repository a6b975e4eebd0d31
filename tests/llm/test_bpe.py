import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foldline.llm.heap_bpe import Bpe, encode_texts, ids_of, text_of
from foldline.llm.queries import op12_heap_bpe
from tests.llm.helpers import SF, docs_frame, spark_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return Bpe(PATH), Tokenizer.from_file(PATH)


TEXTS = [
    "", " ", "\n", "a", "Hello, world! It's 2024's end<|endoftext|> next", "<|endoftext|><|endoftext|>", "  lead and trail  ", "tabs\t\tand\r\n\r\nlines\x0b\x0c",
    "\x1c\x1d\x1e\x1f\x85\xa0 　x", "naïve café Straße 東京 здравствуй مرحبا 👩‍👩‍👧 é", "'S 'T we'll WE'LL don''t", "1234 ½ Ⅻ ٣", "a" * 5000, "ab" * 3000 + " " * 300 + "é" * 2000, "\x00\x7f�\U0010ffff",
]


def test_equals_the_library(both):
    bpe, lib = both
    rng = random.Random(1)
    alphabet = "abcdeABC  \n'\t.,!0123éß東 ‍<|>"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(2000)]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        assert bpe.encode(t).tolist() == want, t
        assert bpe.decode(np.array(want, "<u4")) == lib.decode(want, skip_special_tokens=False) == t


def test_every_code_point(both):
    bpe, lib = both
    for at in range(0, 0x20000, 64):
        t = "".join(f"a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}" for c in range(at, at + 64) if not 0xD800 <= c <= 0xDFFF)
        assert bpe.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids, hex(at)


def test_ids_that_split_a_character(both):
    bpe, lib = both
    ids = bpe.encode("東京 é")[:-1]
    assert bpe.decode(ids) == lib.decode(ids.tolist(), skip_special_tokens=False)


def test_long_words_and_a_full_cache(both):
    bpe, lib = both
    own = Bpe(PATH)
    own.words.size = 20_000
    text = " ".join(str(i * 7919) for i in range(20_000)) + " " + "xyz" * 100_000
    assert own.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids
    assert own.words.held <= 20_000 and len(own.words) + len(own.words.older) < 1000


def test_query_equals_the_library(spark, both):
    lib = both[1]
    want = {}
    for r in spark_rows(spark, "documents"):
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in op12_heap_bpe(spark, SF).collect()} == want


def test_nulls_repeats_and_clashing_columns(spark, both):
    rows = [(1, None), (1, ""), (None, "a b"), (None, "a b"), (2, "Long text. " * 200_000)]
    docs = docs_frame(spark, rows).withColumnRenamed("piece", "ids").withColumnRenamed("batch", "a.b")
    got = encode_texts(docs, PATH, ids_of, "ids array<int>").collect()
    want = [(i, both[1].encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r[1] for r in encode_texts(docs, PATH, text_of, "text string").collect()} == {t or "" for _, t in rows}
    assert encode_texts(docs.limit(0), PATH, ids_of, "ids array<int>").count() == 0
