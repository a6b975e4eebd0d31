"""Best-fit decreasing packing of tokenised documents, planned on the histogram of lengths."""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import HashCache, slices, tidy
from foldline.session import cut_lineage

CAPACITY = 4096


class OpenBins:
    """Segment tree over remaining capacities 0..capacity; a leaf holds the runs of bins with that capacity."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.runs: dict[int, deque] = {}

    def add(self, capacity: int, first: int, n: int) -> None:
        if n:
            self.runs.setdefault(capacity, deque()).append((first, n))
            self._change(capacity, n)

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """Up to ``most`` bins of one run: first bin and how many."""
        first, n = self.runs[capacity].popleft()
        got = min(n, most)
        if got < n:
            self.runs[capacity].appendleft((first + got, n - got))
        self._change(capacity, -got)
        return first, got

    def _change(self, capacity: int, by: int) -> None:
        at = self.size + capacity
        while at:
            self.count[at] += by
            at //= 2

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` that has an open bin, in logarithmic time."""
        at = self.size + need
        while not self.count[at]:
            while at & 1:  # up until a right neighbour exists
                at //= 2
                if at <= 1:
                    return None
            at += 1
        while at < self.size:
            at *= 2
            if not self.count[at]:
                at += 1
        return at - self.size


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing for ``histogram`` (length -> pieces), equal pieces in one step.

    Rows (length, first rank, bins, first bin, pieces a bin, offset): the pieces of the length with ranks from the first
    on go to the bins in turn, ``pieces a bin`` into each, from ``offset`` on. The tightest bin takes pieces of one length
    until they no longer fit (it only gets tighter), so a run of equal bins is filled in one step and its capacity at least
    halves each time: the plan has at most about 3 * capacity * log2(capacity) rows, whatever the number of documents.
    """
    bins, plan, made = OpenBins(capacity), [], 0
    for length in sorted((x for x, n in histogram.items() if x > 0 and n > 0), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                per = capacity // length
                room, first, n = capacity, made, max(1, left // per)
                made += n
            else:
                per = room // length
                first, n = bins.take(room, max(1, left // per))
            per = min(per, left)  # the last bin may get fewer
            plan.append((length, rank, n, first, per, capacity - room))
            bins.add(room - per * length, first, n)
            rank, left = rank + n * per, left - n * per
    return np.array(plan, dtype=np.int64).reshape(-1, 6)


#: Letters whose lower case is one precomposed letter, between ASCII punctuation that cannot begin a contraction or a special token.
_PLAIN = re.compile(r"([!-&(-/:;=?@\[-`{}~]*)([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=?@\[-`{}~]*)")


def _byte_letters() -> list[str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def word_bpe_encoder(path: str, cache_bytes: int = 240 << 20) -> Callable[[], Callable[[str], np.ndarray]]:
    """Encoder for lower-case vocabularies that drop white space: a word is encoded once per task and then looked up.

    A task remembers words and runs of letters within ``cache_bytes``. White space separates ids, so whole texts have the ids of their words. A run of plain letters goes to the BPE
    model directly, without the general normaliser and splitter; any other word takes the general way.
    """

    def load():
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        letters = _byte_letters()

        def whole(word: str) -> bytes:
            return array("I", tok.encode(word, add_special_tokens=False).ids).tobytes()

        def run_of_letters(run: str) -> bytes:
            spelled = run if run.isascii() else "".join(map(letters.__getitem__, run.encode()))
            return array("I", [t.id for t in model.tokenize(spelled)]).tobytes()

        model = tok.model
        runs, marks = HashCache(run_of_letters, 1_000_000, cache_bytes * 2 // 5), HashCache(whole, 20_000, 2 << 20)

        def word_ids(word: bytes) -> bytes:
            text = word.decode()
            m = _PLAIN.fullmatch(text)
            if not m:
                return whole(text)
            return (marks[m[1]] if m[1] else b"") + runs[m[2].lower()] + (marks[m[3]] if m[3] else b"")

        words = HashCache(word_ids, 1_000_000, cache_bytes * 3 // 5)

        def encode(text: str) -> np.ndarray:
            return np.frombuffer(b"".join(map(words.__getitem__, text.encode().lower().split())), dtype="<u4")

        return encode

    return load


def pieces(docs: DataFrame, encoder: Callable, end_id: int, capacity: int = CAPACITY, digest: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """(doc_id, piece, start, tokens, length, part, nth): each document's ids and the end id, cut into pieces of ``capacity``.

    part is the task and nth the number of earlier pieces of that length in it. With ``digest`` the column ``digest`` has its
    value instead of tokens.
    """

    def run(batches):
        encode, part, seen = encoder(), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows in slices(batches, 128):
            out = []
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end_id))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    tokens = ids[at : at + capacity]
                    out.append((doc, k, at, tokens, len(tokens), seen[len(tokens)]))
                    seen[len(tokens)] += 1
            if not out:
                continue
            doc, k, at, tokens, length, nth = zip(*out)
            if digest:
                content = pa.array([digest(t) for t in tokens], pa.int64())
            else:
                content = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(np.concatenate(tokens).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(at, pa.int64()), content, pa.array(length, pa.int64()), pa.array([part] * len(out), pa.int64()), pa.array(nth, pa.int64()),
                ],
                names=["doc_id", "piece", "start", kept.split()[0], "length", "part", "nth"],
            )

    kept = "digest long" if digest else "tokens array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), f"doc_id long, piece int, start long, {kept}, length long, part long, nth long")


def pack(docs: DataFrame, encoder: Callable, end_id: int, capacity: int = CAPACITY, digest: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """(doc_id, piece, start, tokens, length, sequence_id, offset): where each piece of each document lies.

    With ``digest``, a number made of a piece's ids, the tokens themselves stay out of the written table and the joins.

    Best-fit decreasing over all documents: only the histogram of lengths (at most ``capacity`` rows) reaches the driver,
    and the plan made from it is bounded by the capacity too. A piece finds its place by its rank among all pieces of its
    length: its number in its task plus the counts of the tasks before. Null texts count as empty: their piece is the
    end id alone. Null and repeated doc_ids are packed like any other row; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = cut_lineage(pieces(docs, encoder, end_id, capacity, digest))
    counts = cut_lineage(cut.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = cut_lineage(counts.selectExpr("part", "length", "sum(n) OVER (PARTITION BY length ORDER BY part) - n AS earlier"))
    runs = plan_runs(spark, plan_bins(histogram, capacity))
    ranked = cut.join(before, ["part", "length"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    r = F.element_at(F.filter("runs", lambda x: x["rank"] <= F.col("rank")), -1)
    placed = ranked.join(runs, "length").withColumn("r", r).withColumn("k", F.col("rank") - F.col("r.rank"))
    return placed.selectExpr(
        "doc_id", "piece", "start", "digest" if digest else "tokens", "length", "r.first_bin + k div r.per_bin AS sequence_id", "r.offset + k % r.per_bin * length AS offset"
    )


def plan_runs(spark, plan: np.ndarray) -> DataFrame:
    """(length, runs) of a plan: an array of its steps in the order of ranks; as bounded as the plan."""
    rows = [(int(p[0][0]), [(int(x[1]), int(x[3]), int(x[4]), int(x[5])) for x in p]) for p in np.split(plan, np.flatnonzero(np.diff(plan[:, 0])) + 1) if len(p)]
    return spark.createDataFrame(rows, "length long, runs array<struct<rank: long, first_bin: long, per_bin: long, offset: long>>")
