"""Byte-level BPE by a priority queue of merge ranks over a doubly linked symbol list; decoding by concatenation."""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import HashCache, slices_by_bytes, tidy

#: Fixed value: the public splitting pattern of byte-level vocabularies. ``regex`` counts the separators U+001C to U+001F
#: as white space and the tokenizers library does not, so white space is written out as the Unicode property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bytes of words and their ids that a task remembers.
CACHE_BYTES = 96 << 20
#: Words of a text that are Python strings at the same time.
WORDS_AT_ONCE = 1 << 16


def byte_letters() -> list[str]:
    """The public alphabet of byte-level vocabularies: printable bytes stand for themselves, the others for U+0100 and on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """Vocabulary and merges of a tokenizer file without normaliser; added tokens are found in the text first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.byte_ids = [vocab[c] for c in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        back = {c: b for b, c in enumerate(letters)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: bytes(map(back.__getitem__, s)) for s, i in vocab.items()} | {i: s.encode() for s, i in added.items()}
        self.strings = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.added = {s: array("I", [i]).tobytes() for s, i in added.items()}
        self.added_at = re.compile("|".join(re.escape(s) for s in sorted(added, key=len, reverse=True))) if added else None
        self.split = regex.compile(SPLIT)
        #: Ids of a word as little-endian 32-bit integers.
        self.words = HashCache(lambda word: array("I", self.merge(word.encode())).tobytes(), 1_000_000, CACHE_BYTES)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: always the pair of lowest rank, leftmost first.

        Symbols are places in a linked list. A queue entry names its left place and the two ids it saw there; it is stale,
        and skipped, when either has changed since.
        """
        ids = [self.byte_ids[b] for b in word]
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            m = merges.get((ids[i], ids[i + 1]))
            if m:
                queue.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1  # no entry names -1, so the place j is dead for good
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges.get((new, ids[k]))
                if m:
                    heapq.heappush(queue, (m[0], i, new, ids[k], m[1]))
            h = before[i]
            if h >= 0:
                m = merges.get((ids[h], new))
                if m:
                    heapq.heappush(queue, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> Iterator[bytes]:
        words = (m[0] for m in self.split.finditer(text)) if len(text) > WORDS_AT_ONCE else iter(self.split.findall(text))
        while part := list(islice(words, WORDS_AT_ONCE)):
            yield b"".join(map(self.words.__getitem__, part))

    def encode(self, text: str) -> np.ndarray:
        out, at = [], 0
        for m in self.added_at.finditer(text) if self.added_at else ():
            out += self._plain(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        out += self._plain(text[at:] if at else text)
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary strings of the ids in a row; bytes that are no UTF-8 become U+FFFD."""
        strings, parts = self.strings, []
        for at in range(0, len(ids), WORDS_AT_ONCE):
            parts.append(b"".join(map(strings.__getitem__, ids[at : at + WORDS_AT_ONCE].tolist())))
        return b"".join(parts).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, path: str, derive: Callable[[Bpe, np.ndarray], tuple], out: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and, for each text, the columns of the DDL ``out`` that ``derive`` makes of its ids.

    Null texts count as empty and give no ids; null and repeated keys are kept as they are, an empty table gives no rows.
    One text is in work at a time and goes through whole; nothing is shuffled. ``derive`` decides what leaves the task:
    :func:`ids_of` the ids, :func:`text_of` the text that they decode to.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    picked = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("binary").alias("__text"))
    full = StructType([picked.schema["__key"], *_parse_datatype_string(out)])
    schema = to_arrow_schema(full)

    def run(batches):
        bpe = Bpe(path)
        for part in slices_by_bytes(batches, 1):
            rows = [derive(bpe, bpe.encode((t.as_py() or b"").decode("utf-8", "replace"))) for t in part.column(1)]
            made = [pa.array(v, type=f.type) for v, f in zip(zip(*rows), list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(schema[0].type), *made], schema=schema)

    return picked.mapInArrow(tidy(run), full).withColumnRenamed("__key", key)


def ids_of(bpe: Bpe, ids: np.ndarray) -> tuple:
    return (ids.astype(np.int32),)


def text_of(bpe: Bpe, ids: np.ndarray) -> tuple:
    return (bpe.decode(ids),)
