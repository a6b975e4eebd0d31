"""Line dedup: content-defined chunks of lines that repeat anywhere in the corpus are cut out after byte comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import slices, slices_by_bytes, tidy
from foldline.llm.exchange import dealt, pack_column, pack_keys, range_bits, unpack_column, unpack_keys
from foldline.session import cut_lineage, discard

#: Only repeated stretches of at least this many bytes are cut out (about twenty words).
MIN_BYTES = 110
#: Chunks of one packed row, and the usual bytes from one boundary to the next.
BATCH_CHUNKS, CHUNK_BYTES = 1_000_000, 25
#: Bits of the filter for each repeated chunk: one in so many other chunks passes it by mistake.
FILTER_ROOM = 32
#: Bytes of texts that are looked at together: their arrays stay in a core's cache.
SLICE_BYTES = 1 << 18
#: Largest size of the filter of repeated chunks, as a logarithm of bits: 32 MB.
MOST_FILTER_BITS = 28

_FACTOR = np.uint64(0xD1342543DE82EF95)
_LETTERS = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GAP = b"\n\n"


class Powers:
    """Powers of the factor and of its inverse modulo 2^64, as far as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            out = []
            for f in (int(_FACTOR), pow(int(_FACTOR), -1, 1 << 64)):
                steps = np.full(max(n, 1 << 20), f, np.uint64)
                steps[0] = 1
                out.append(np.cumprod(steps, dtype=np.uint64))
            self.up, self.down = out
        return self.up[:n], self.down


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def spans(texts: list[bytes], powers: Powers, fold: int = 2, divisor: int = 2) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, first byte of each text in it, text, start, end, hash): the spans of lines between boundaries, end exclusive.

    Lines end at a newline; a long line is folded after every word whose hash is a multiple of ``fold``, so that text
    without newlines behaves alike. A rolling hash over two consecutive line hashes sets a boundary where it is a multiple
    of ``divisor``: boundaries follow the content and come back after any insertion. Words are parted by ASCII white
    space. Texts are joined, so that one pass serves many; no line or span crosses from one to the next.
    """
    data = _GAP.join(texts) + _GAP
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + len(_GAP)
    begin = np.cumsum(size) - size
    a = np.frombuffer(data, np.uint8)
    word = ~_SPACE[a]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(a) and word[0]:
        edge = np.append(0, edge)
    start, end = edge[::2], edge[1::2]
    if not len(start):
        empty = np.zeros(0, np.int64)
        return data, begin, empty, empty, empty, np.zeros(0, np.uint64)
    up, down = powers(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_LETTERS[a] * up[:-1], out=total[1:])

    def hashes(s, e):
        return _mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))

    text = np.searchsorted(begin, start, side="right") - 1
    newline = np.flatnonzero(a == 10)
    after = np.append(newline, len(a))[np.searchsorted(newline, end)]  # the first newline after each word
    breaks = after < np.append(start[1:], len(a))
    breaks |= hashes(start, end) % np.uint64(fold) == 0
    breaks[-1] = True
    last = np.flatnonzero(breaks)
    first = np.append(0, last[:-1] + 1)
    line = hashes(start[first], end[last])
    of = text[first]
    before = np.append(np.uint64(0), line[:-1])
    before[np.append(True, of[1:] != of[:-1])] = 0
    cut = _mix(before * _FACTOR + line) % np.uint64(divisor) == 0
    cut[np.append(of[1:] != of[:-1], True)] = True
    stop = np.flatnonzero(cut)
    s, e = start[first[np.append(0, stop[:-1] + 1)]], end[last[stop]]
    return data, begin, of[stop], s, e, hashes(s, e)


def chunk_keys(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hash of the chunk that begins with each span: this span and the next of the same text; the last one alone."""
    after = np.append(h[1:], np.uint64(0))
    after[np.append(text[1:] != text[:-1], True)] = 0
    return _mix(h * _FACTOR + after)


def _long_runs(start: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """Which of these sorted spans lie in a merged stretch of at least ``least`` bytes (touching spans merge)."""
    if not len(start):
        return np.zeros(0, bool)
    reach = np.maximum.accumulate(end)
    new = np.append(True, start[1:] > reach[:-1] + 1)
    run = np.cumsum(new) - 1
    size = np.maximum.reduceat(reach, np.flatnonzero(new)) - start[new]
    return (size >= least)[run]


def _packed_chunks(docs: DataFrame) -> DataFrame:
    """One row per stretch of texts: (batch, keys, columns [occurrences])."""

    def run(batches):
        base, made, held, size, powers = TaskContext.get().partitionId() << 32, 0, [], 0, Powers()

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([base + made]), pa.array([pack_keys(keys)], pa.binary()), pa.array([[pack_column(n.astype(np.int64))]], pa.list_(pa.binary()))], names=["batch", "keys", "columns"]
            )

        for rows in slices_by_bytes(batches, 0, SLICE_BYTES):
            _, _, text, _, _, h = spans(rows.column(0).to_pylist(), powers)
            held.append(chunk_keys(text, h))
            size += len(h)
            if size >= BATCH_CHUNKS:
                yield flush()
                made, held, size = made + 1, [], 0
        if size:
            yield flush()

    return docs.select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).mapInArrow(tidy(run), "batch long, keys binary, columns array<binary>")


def repeated_filter(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(bitmap, bits): places of all chunk hashes that occur more than once, by their top bits.

    The bitmap has some bits for each repeated chunk and never more than 2^MOST_FILTER_BITS; where it fills up, more chunks
    pass on to :func:`_confirmed`, which counts them exactly; none is lost and none is cut for passing.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = range_bits(total // CHUNK_BYTES)

    def repeats(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpack_keys(k) for k in pdf["keys"]])
        n = np.concatenate([unpack_column(c[0], np.int64) for c in pdf["columns"]])
        uniq, at = np.unique(keys, return_inverse=True)
        again = uniq[np.bincount(at, weights=n) > 1]
        return pd.DataFrame({"range": [int(pdf["range"].iloc[0])], "n": [len(again)], "keys": [pack_keys(again)]})

    found = cut_lineage(dealt(_packed_chunks(docs), ranges).groupBy("range").applyInPandas(repeats, "range long, n long, keys binary"))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = int(min(MOST_FILTER_BITS, max(ranges + 6, np.ceil(np.log2(FILTER_ROOM * total + 64)))))
    each = 1 << (bits - ranges)  # bits of one range

    def mark(parts):
        for rows in parts:
            for at, packed_keys in zip(*(c.to_pylist() for c in rows.columns)):
                flags = np.zeros(each, np.uint8)
                flags[(unpack_keys(packed_keys) >> np.uint64(64 - bits)).astype(np.int64) - at * each] = 1
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["range", "flags"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in found.select("range", "keys").mapInArrow(tidy(mark), "range long, flags binary").toLocalIterator():
        out[r["range"] * each // 8 : (r["range"] + 1) * each // 8] = np.frombuffer(r["flags"], np.uint8)
    return out, bits


def repeated_spans(docs: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """(key, spans): byte spans (start * 2^32 + end, in no order) of each row's text that repeat a chunk of an earlier document, or an earlier place of its own.

    key is a hash of doc_id and text. Chunks of two spans that pass the filter are counted by hash and bytes; the
    spans of long runs of chunks that repeat are then compared as bytes (if spans of one hash differ, none of them is cut). The
    one in the smallest doc_id and there at the first place stays. Merged spans are at least ``least`` bytes long. Documents without doc_id come after
    all others and keep what only they share; so do different texts under one doc_id at equal places.
    """
    flags, bits = repeated_filter(docs)
    bitmap = docs.sparkSession.sparkContext.broadcast(flags)
    names = ["key", "place", "start", "end", "hash", "chunk", "both", "long"]

    def run(batches):
        table, powers = bitmap.value, Powers()
        for rows in slices_by_bytes(batches, 2, SLICE_BYTES):
            data, begin, text, s, e, h = spans(rows.column(2).to_pylist(), powers)
            if not len(h):
                continue
            chunk = chunk_keys(text, h)
            at = (chunk >> np.uint64(64 - bits)).astype(np.int64)
            begins = (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            pair = np.append(text[1:] == text[:-1], False)
            hit = np.flatnonzero(begins | np.append(False, (begins & pair)[:-1]))  # both spans of a chunk
            long = np.zeros(len(h), bool)
            long[hit] = _long_runs(s[hit], e[hit], least)
            keep = np.flatnonzero(long | begins)
            after = np.minimum(keep + 1, len(h) - 1)
            two = begins[keep] & pair[keep]
            both = [data[a:b] + data[c:d] for a, b, c, d in zip(s[keep].tolist(), e[keep].tolist(), s[after].tolist(), np.where(two, e[after], 0).tolist())]
            text, s, e = text[keep], s[keep], e[keep]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).take(pa.array(text)), rows.column(1).take(pa.array(text)), pa.array(s - begin[text]), pa.array(e - begin[text]),
                    pa.array(h[keep].view(np.int64)), pa.array(chunk[keep].view(np.int64), mask=~begins[keep]), pa.array(both, pa.binary()), pa.array(long[keep]),
                ],
                names=names,
            )

    d = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("place"), F.encode("text", "UTF-8").alias("text"))
    passed = cut_lineage(d.filter("text IS NOT NULL").mapInArrow(tidy(run), "key long, place long, start long, end long, hash long, chunk long, both binary, long boolean"))
    seen = cut_lineage(_confirmed(passed, least))
    pieces = passed.filter("long").select("hash", F.expr("substring(both, 1, cast(end - start AS INT))").alias("piece"))
    mixed = pieces.groupBy("hash", "piece").agg(F.lit(1)).groupBy("hash").count().filter("count > 1").select("hash")
    # numbers alone in every aggregate: no rows are sorted for it
    own = seen.groupBy("hash", "place").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    first = own.groupBy("hash").agg(
        F.struct(F.min("place").alias("place"), F.min_by("low", "place").alias("start")).alias("first"),
        F.struct(F.max("place").alias("place"), F.max_by("high", "place").alias("start")).alias("last"),
    ).filter("first <> last")
    first = cut_lineage(first.join(mixed, "hash", "left_anti").select("hash", "first"))
    discard(passed)
    again = seen.join(first, "hash").filter(F.struct("place", "start") > F.col("first"))
    # a text's spans are in ``seen`` once, however often its row is repeated
    out = cut_lineage(again.groupBy("key").agg(F.collect_list(F.shiftleft("start", 32) + F.col("end")).alias("spans")))
    discard(seen, first)
    return out


def _confirmed(passed: DataFrame, least: int) -> DataFrame:
    """(key, place, start, end, hash): spans in long runs of chunks that do repeat, of those that passed the filter.

    Chunks are counted by hash and the bytes of both spans. One that occurs once names its only place, so that
    each text needs to get but these back and to find its long runs anew.
    """
    count = passed.filter("chunk IS NOT NULL").groupBy("chunk", (F.col("end") - F.col("start")).alias("width"), "both").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.min("start").alias("start"), F.min("long").alias("long")
    )
    alone = count.filter("n = 1 AND long").selectExpr("key", "CAST(NULL AS LONG) AS place", "NULL AS span", "start AS alone")
    span = F.struct("start", "end", "hash", F.col("chunk").isNotNull().alias("begins")).alias("span")
    parts = passed.filter("long").select("key", "place", span, F.lit(None).cast("long").alias("alone")).unionByName(alone)
    texts = parts.groupBy("key").agg(F.min("place").alias("place"), F.collect_set("span").alias("spans"), F.collect_set("alone").alias("alone"))

    def run(batches):
        for rows in slices(batches):
            own, other = rows.column(2), rows.column(3)
            text = np.repeat(np.arange(rows.num_rows), np.diff(own.offsets.to_numpy()))
            s, e, h, begins = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in own.flatten().flatten())
            order = np.lexsort((s, text))
            text, s, e, h, begins = text[order], s[order], e[order], h[order], begins[order].astype(bool)
            at = (text.astype(np.int64) << 40) + s
            once = (np.repeat(np.arange(rows.num_rows), np.diff(other.offsets.to_numpy())) << 40) + other.flatten().to_numpy(zero_copy_only=False)
            begins &= ~np.isin(at, once)
            hit = begins.copy()
            hit[1:] |= begins[:-1] & (text[1:] == text[:-1])  # the span after one that begins a chunk is here, too
            hit = np.flatnonzero(hit)
            keep = hit[_long_runs(at[hit], at[hit] + e[hit] - s[hit], least)]
            if len(keep):
                of = pa.array(text[keep])
                yield pa.RecordBatch.from_arrays([rows.column(0).take(of), rows.column(1).take(of), pa.array(s[keep]), pa.array(e[keep]), pa.array(h[keep])], names=["key", "place", "start", "end", "hash"])

    return texts.mapInArrow(tidy(run), "key long, place long, start long, end long, hash long")


def _stretches(start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the merged stretches of at least ``least`` bytes of sorted spans, as :func:`_long_runs` merges them."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    head = np.flatnonzero(np.append(True, start[1:] > reach[:-1] + 1))
    start, end = start[head], np.maximum.reduceat(reach, head)
    keep = end - start >= least
    return start[keep], end[keep]


def _without(data: bytes, stretches: list[tuple[int, int]]) -> tuple[bytes, int]:
    """``data`` without these stretches and the white space after them; how many were cut."""
    out, at, n = b"", 0, 0
    for a, b in stretches:
        if a > at:
            out += data[at:a]
            n += 1
        elif at == 0:
            n += 1
        at = max(at, b)
        while at < len(data) and _SPACE[data[at]]:
            at += 1
    return out + data[at:], n


def cut_out(data: bytes, cuts: list, least: int = MIN_BYTES) -> tuple[bytes, int]:
    """Text without the merged spans of at least ``least`` bytes and the white space after them; how many were cut."""
    s, e = _stretches(*(np.array([r[k] for r in cuts], np.int64) for k in ("start", "end")), least)
    return _without(data, list(zip(s.tolist(), e.tolist())))


def dedup_lines(docs: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """``docs`` (all columns, doc_id and text among them) with repeated chunks cut out of text, and ``cut_runs``, their number.

    The first occurrence stays, see :func:`repeated_spans`. Every row stays, too: of whole copies an empty text is left.
    Rows with equal doc_id and text count as one document and stay alike. Null texts stay null.
    """
    found = repeated_spans(docs, least).withColumnRenamed("key", "__key").withColumnRenamed("spans", "__spans")
    names = docs.columns
    both = docs.withColumn("__own", F.xxhash64("doc_id", "text")).join(found, F.col("__own") == F.col("__key"), "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", cut_runs long"
    at = names.index("text")

    def run(batches):
        for rows in slices(batches):
            texts, runs, own = rows.column(at).to_pylist(), [0] * rows.num_rows, rows.column(len(names))
            of = np.repeat(np.arange(rows.num_rows), pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False))
            span = own.flatten().to_numpy(zero_copy_only=False)
            order = np.lexsort((span, of))
            of, span = of[order] << 40, span[order]
            s, e = _stretches(of + (span >> 32), of + (span & 0xFFFFFFFF), least)
            of = s >> 40
            s, e = (s - (of << 40)).tolist(), (e - (of << 40)).tolist()
            head = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
            for i, a, b in zip(of[head].tolist() if len(of) else (), head, [*head[1:], len(of)]):
                data, runs[i] = _without(texts[i].encode(), list(zip(s[a:b], e[a:b])))
                texts[i] = data.decode()
            columns = [pa.array(texts, pa.string()) if j == at else rows.column(j) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(runs, pa.int64())], names=[*names, "cut_runs"])

    return both.select(*[F.col(f"`{c}`") for c in names], "__spans").mapInArrow(tidy(run), schema)
