"""SimHash near-duplicates with pigeonring candidate filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import slices, tidy
from foldline.llm.graph import connected_components
from foldline.session import cut_lineage

SEED = 42
#: The ring: widths of the five consecutive segments of a fingerprint, from the highest bit on.
SEGMENTS = (13, 13, 13, 13, 12)
MAX_BITS = 4


def simhash(text: bytes | None, words: int = 4, block: int = 1 << 16) -> int:
    """64-bit fingerprint of a UTF-8 text: bit set if it is set in over half of the hashes of its word shingles."""
    parts = (text or b"").lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0d separate
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    end = np.cumsum(size + 1) - 1
    start = end - size
    w = min(words, len(parts))
    start, end = start[: len(parts) - w + 1].tolist(), end[w - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(start), block):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(start[at : at + block], end[at : at + block])], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(start)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of each row's whole ``text``."""

    def run(batches):
        for part in slices(batches):
            fps = np.array([simhash(t, words) for t in part.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    i %= len(SEGMENTS)
    below = sum(SEGMENTS[i + 1 :])
    return F.shiftrightunsigned(fp, below).bitwiseAND(F.lit((1 << SEGMENTS[i]) - 1))


def chain_keys(fp: Column) -> list[Column]:
    """Join keys of a fingerprint. Two fingerprints that pass the pigeonring filter share at least one.

    On a ring of five segments with a budget of 4 bits (0.8 a segment) a pair has some segment from which every chain of
    l consecutive segments differs in at most floor(0.8 * l) bits: 0, 1, 2, 3, 4. So the first segment is equal and
    the next two together differ in at most 2 bits, hence one of their three parts is equal. A key is the position,
    the first segment, the part's number and the part.
    """
    keys = []
    for i in range(len(SEGMENTS)):
        width = SEGMENTS[(i + 1) % 5] + SEGMENTS[(i + 2) % 5]
        pair = F.shiftleft(_segment(fp, i + 1), SEGMENTS[(i + 2) % 5]).bitwiseOR(_segment(fp, i + 2))
        at = 0
        for j, bits in enumerate((width // 3, width // 3, width - 2 * (width // 3))):
            part = F.shiftrightunsigned(pair, width - at - bits).bitwiseAND(F.lit((1 << bits) - 1))
            at += bits
            keys.append(F.lit((i * 3 + j) << 40).bitwiseOR(F.shiftleft(_segment(fp, i), 16)).bitwiseOR(part))
    return keys


def pigeonring(a: Column, b: Column, budget: int = MAX_BITS) -> Column:
    """Some segment starts a ring walk whose cumulative differences stay within the proportional budgets; then all bits are counted."""
    d = a.bitwiseXOR(b)
    m = len(SEGMENTS)
    diff = [F.bit_count(_segment(d, i)) for i in range(m)]
    chains = None
    for i in range(m):
        total, ok = None, None
        for length in range(1, m):
            total = diff[(i + length - 1) % m] if total is None else total + diff[(i + length - 1) % m]
            step = total <= budget * length // m
            ok = step if ok is None else ok & step
        chains = ok if chains is None else chains | ok
    return chains & (F.bit_count(d) <= budget)


def link_classes(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes of ``classes`` (node, fp; distinct fingerprints) with the components of all links.

    Not every link is listed: one whose ends already hang together through others is skipped. First each node is compared
    with the smallest node of each of its buckets (one row per node and key, however large the bucket), and what hangs
    together gets one label. Then pairs are compared only in buckets that still hold several labels, and only across
    labels. So a dense clump of near copies costs one comparison a member, not one a pair.
    """
    keyed = cut_lineage(classes.select("node", "fp", F.explode(F.array(*chain_keys(F.col("fp")))).alias("key")))
    lead = keyed.groupBy("key").agg(F.min(F.struct("node", "fp")).alias("l"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("l.node").alias("to"), F.col("l.fp").alias("to_fp"))
    stars = keyed.join(lead, "key").filter("node <> to").filter(pigeonring(F.col("fp"), F.col("to_fp")))
    stars = cut_lineage(stars.select(F.col("node").alias("a"), F.col("to").alias("b")).distinct())
    label = connected_components(stars)
    lab = keyed.join(label, "node", "left").select("key", "node", "fp", F.coalesce("component", "node").alias("label"))
    several = lab.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    mixed = cut_lineage(lab.join(several, "key", "left_semi"))
    left, right = mixed.alias("p"), mixed.alias("q")
    across = left.join(right, (F.col("p.key") == F.col("q.key")) & (F.col("p.label") < F.col("q.label")) & pigeonring(F.col("p.fp"), F.col("q.fp")))
    return stars.union(across.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct())


def near_duplicates(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp, component_id, links) for every row of ``docs`` (doc_id, text).

    Fingerprints link at ``MAX_BITS`` or fewer differing bits; component_id is the smallest doc_id that can be reached, the
    own included; links counts the other rows of the same fingerprint. Equal fingerprints form one class, represented
    by its smallest doc_id, and only classes are compared. Null and empty texts have fingerprint zero. A row without
    doc_id joins its fingerprint's class and represents none: without a numbered row in it, its component is null.
    Repeated rows each get a row.
    """
    fps = cut_lineage(fingerprints(docs, words))
    classes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")))
    label = connected_components(link_classes(classes.filter("node IS NOT NULL").select("node", "fp")))
    known = cut_lineage(
        classes.join(label, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"), (F.col("rows") - 1).alias("links"))
    )
    return fps.join(known, "fp").select("doc_id", "fp", "component_id", "links")
