"""Toxicity by compression distance: windows compressed against dictionaries of ordinary and of toxic text."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import crc_remainder, fit_logistic, hash_sample, sigmoid, slices, tidy

GRAM = 6
#: Bounds of the labelled sample of each class, whole texts, that the dictionaries and the calibration are fitted on.
SAMPLE_ROWS = 5_000
SAMPLE_BYTES = 20_000_000


@dataclass(frozen=True)
class Model:
    """Two raw dictionaries of equal size, the words of a window and the calibration of the features."""

    ordinary: bytes
    toxic: bytes
    window: int
    weights: tuple[float, ...]


def _normal(text: str | None) -> bytes:
    return b" " + b" ".join((text or "").encode().lower().split()) + b" "


def _grams(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(0, len(a) - GRAM + 1)
    key = np.zeros(n, np.uint64)
    for j in range(GRAM):
        key = key * np.uint64(256) + a[j : j + n]
    return key


def _document_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = [np.unique(_grams(t)) for t in texts]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Value of each wanted key, 0 where it is missing."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], 0)


def _without_copies(texts: list[bytes], most: float = 0.3) -> list[bytes]:
    """Texts of which at most a share of the five-word windows occurred in texts before: what copies share is no evidence."""
    own = []
    for text in texts:
        w = text.split()
        own.append(np.unique(np.fromiter((hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))), np.int64)))
    # a window is new in the first text that holds it; sorted numbers, a sixteenth at a time, take a fraction of a set's memory
    sizes, new = [len(o) for o in own], np.zeros(len(own), np.int64)
    for part in range(16 if own else 0):
        mine = [o[o & 15 == part] for o in own]
        first = np.unique(np.concatenate(mine), return_index=True)[1]
        new += np.bincount(np.searchsorted(np.cumsum([len(m) for m in mine]), first, side="right"), minlength=len(own))
    return [t for t, fresh, n in zip(texts, new, sizes) if n - fresh <= most * n]


def toxic_segments(toxic: list[bytes], ordinary: list[bytes], share: float = 0.015, odds: float = 30.0, most: int = 160) -> list[bytes]:
    """Byte runs that many toxic texts and next to no ordinary ones hold, the most frequent first.

    Like the usual dictionary training it picks segments by how many samples hold their grams, but a gram scores only
    if its share among toxic texts is ``odds`` times that among ordinary ones. Runs are cut to their frequent core.
    """
    keys, counts = _document_counts(toxic)
    many = counts >= max(3, share * len(toxic))
    keys, counts = keys[many], counts[many]
    other = np.zeros(len(keys), np.int64)
    for text in ordinary if len(keys) else ():  # only grams that may be kept are counted, text by text
        grams = np.unique(_grams(text))
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        other[at[keys[at] == grams]] += 1
    keep = counts / max(1, len(toxic)) > odds * (other + 1) / max(1, len(ordinary))
    keys, counts = keys[keep], counts[keep]
    found: Counter = Counter()
    for text in toxic if len(keys) else ():
        n = _at(keys, counts, _grams(text))
        hits = np.flatnonzero(n)
        for run in np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1):
            core = run[n[run] * 2 >= n[run].max()] if len(run) else run
            for r in np.split(core, np.flatnonzero(np.diff(core) > 1) + 1):
                if len(r):
                    found[text[r[0] : r[-1] + GRAM]] += 1
    return [s for s, c in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most] if c >= 5]


def dictionaries(toxic: list[bytes], ordinary: list[bytes], size: int = 4096) -> tuple[bytes, bytes]:
    """(ordinary, toxic): trained on ordinary windows; the toxic one has the toxic segments before the same content.

    The ordinary dictionary has as many unmatched bytes in that place, so that offsets and tables are the same and a
    window's two lengths differ only by what the toxic segments save.
    """
    import zstandard

    # every step-th window of eight words, only those are made
    step = max(1, sum(-(-len(t.split()) // 8) for t in ordinary) // 50_000)
    samples, at = [], 0
    for text in ordinary:
        w = text.split()
        samples += [b" ".join(w[i : i + 8]) for i in range(8 * (-at % step), len(w), 8 * step)]
        at += -(-len(w) // 8)
    try:
        shared = zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        shared = b" ".join(samples)[-size:]
    segments = toxic_segments(toxic, ordinary)
    own = b"\xff".join(segments[::-1]) + b"\xff"  # the frequent ones last; 0xff is in no UTF-8 text
    filler = np.random.default_rng(5).integers(0x80, 0xC0, len(own), dtype=np.uint8).tobytes()
    return filler + shared, own + shared


def _compressor(raw: bytes):
    import zstandard as z

    d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
    p = z.ZstdCompressionParameters(
        window_log=15, hash_log=12, chain_log=12, search_log=1, target_length=0, min_match=6, strategy=z.STRATEGY_GREEDY,
        format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    d.precompute_compress(compression_params=p)
    return z.ZstdCompressor(dict_data=d, compression_params=p)


class Gains:
    """Bytes that the toxic dictionary saves over the ordinary one, for every window of a text.

    Each window begins as many bytes early as the longest toxic segment has, so that no segment is seen in halves only.
    """

    def __init__(self, ordinary: bytes, toxic: bytes, window: int, block: int = 8192):
        self.pair, self.window, self.block = (_compressor(ordinary), _compressor(toxic)), window, block
        n = min(len(ordinary), len(toxic))
        differ = np.flatnonzero(np.frombuffer(ordinary[len(ordinary) - n :], np.uint8) != np.frombuffer(toxic[len(toxic) - n :], np.uint8))
        own = toxic[: len(toxic) - n + int(differ[-1]) + 1] if len(differ) else b""
        self.overlap = max(map(len, own.split(b"\xff")))

    def __call__(self, text: str | None) -> np.ndarray:
        import zstandard as z

        words = (text or "").encode().lower().split()
        out = [np.zeros(0, np.int64)]
        for at in range(0, len(words), self.block * self.window):
            w = words[at : at + self.block * self.window]
            lead = words[max(0, at - self.overlap) : at]
            head = sum(map(len, lead)) + len(lead)
            data = b" " + b" ".join(lead + w) + b" "
            end = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) + 1 + head
            stop = np.append(end[self.window - 1 :: self.window], end[-1:]) if len(w) % self.window else end[self.window - 1 :: self.window]
            start = np.maximum(np.append(head, stop[:-1] - 1) - self.overlap, 0)
            cut = np.column_stack([start, stop - start]).astype(np.uint64).tobytes()
            sizes = [np.fromiter(map(len, c.multi_compress_to_buffer(z.BufferWithSegments(data, cut))), np.int64, len(stop)) for c in self.pair]
            out.append(sizes[0] - sizes[1])
        return np.concatenate(out)


def features(gains: np.ndarray) -> tuple[float, ...]:
    """Largest gain, total gain (logarithm) and share of windows that gain."""
    won = gains[gains > 0]
    return (float(won.max(initial=0)), float(np.log1p(won.sum())), float(len(won) / max(1, len(gains))))


def train(sample: list[tuple[str | None, int]], window: int = 16) -> Model:
    """Fit on labelled texts: dictionaries on two thirds, calibration on the rest, where the dictionaries are new to the texts."""
    fit, rest = [x for i, x in enumerate(sample) if i % 3], [x for i, x in enumerate(sample) if i % 3 == 0]
    toxic = _without_copies([_normal(t) for t, y in fit if y])
    ordinary = _without_copies([_normal(t) for t, y in fit if not y])
    raw = dictionaries(toxic, ordinary)
    gains = Gains(*raw, window)
    x = np.array([features(gains(t)) for t, _ in rest]).reshape(-1, 3)
    y = np.array([float(y) for _, y in rest])
    if not len(y) or y.min() == y.max():  # nothing to calibrate on: any saved byte counts
        return Model(*raw, window, (2.0, 0.0, 0.0, -3.0) if len(y) == 0 or y.max() else (0.0, 0.0, 0.0, -3.0))
    return Model(*raw, window, tuple(fit_logistic(x, y, ridge=1.0)))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """At most ``rows`` labelled whole texts of each class, chosen by a hash of doc_id, as many of them as have ``size`` bytes together.

    Only rows whose crc32(doc_id as text) mod 3 is not 1 are learned from. The chosen labels are few enough to be sent to
    the texts.
    """
    known = labels.filter("toxic IS NOT NULL").filter(crc_remainder(F.col("doc_id"), 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = []
    for y in (0, 1):
        some = hash_sample(known.filter(F.col("toxic") == y), ["doc_id"], rows)
        texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
        long = sorted(texts.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).collect(), key=lambda r: hash_order(str(r["doc_id"])))
        fits = np.cumsum([r["size"] for r in long]) <= size
        texts = texts.filter(F.col("doc_id").isin([r["doc_id"] for r, f in zip(long, fits) if f]))
        # as Arrow: the driver's JVM makes no objects of the texts
        found += [(t, y) for t in texts.select("text").limit(rows).toArrow().column(0).to_pylist()]
    return sorted(found, key=lambda r: hash_order(r[0]))


def hash_order(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode())


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(labelled_sample(docs, labels))


def score(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1, higher: toxic likelier) to the given columns (all by default) of ``docs``.

    Every whole text is cut into windows of ``model.window`` words; empty and null texts have no gain and the lowest score.
    Rows are scored one by one: repeated and null ids do no harm, an empty table gives no rows.
    """
    columns = columns or docs.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    own = columns if "text" in columns else [*columns, "text"]
    at = own.index("text")

    def run(batches):
        gains, weights = Gains(model.ordinary, model.toxic, model.window), np.array(model.weights)
        for rows in slices(batches):
            scores = [float(sigmoid(np.array([*features(gains(t)), 1.0]) @ weights)) for t in rows.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(columns)], pa.array(scores, pa.float64())], names=[*columns, "score"])

    return docs.select(*own).mapInArrow(tidy(run), f"{ddl}, score double")
