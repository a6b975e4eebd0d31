"""Deleted interpolation: n-gram estimates mixed by context-frequency buckets, weights by expectation-maximisation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import HashCache, give_back, slices, tidy
from foldline.llm.exchange import ask, pack_column, pack_keys, read_answers
from foldline.session import cut_lineage

#: Tokens of one row of coded documents.
BATCH_TOKENS = 600_000
#: Context counts 0, 1, 2-3, 4-7, ... share their weights.
BUCKETS = 24
#: Cells of the held-out histogram: steps of a quarter of a power of two of each ratio.
STEPS = 128

END, START = np.uint64(1 << 8), np.uint64(2 << 8)


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7) & ~0xFF | 1 << 63  # fixed codes are below


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hash of two keys in order."""
    x = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + np.uint64(0x632BE59BD9B4E019))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def contexts(tokens: np.ndarray) -> np.ndarray:
    """The token before each: a text starts after START, which follows each END."""
    out = np.empty_like(tokens)
    out[:1] = START
    out[1:] = np.where(tokens[:-1] == END, START, tokens[:-1])
    return out


def squeeze(values: np.ndarray) -> bytes:
    """Four-byte numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def coded(docs: DataFrame, train, held) -> DataFrame:
    """One row per stretch of about ``BATCH_TOKENS`` tokens: (batch, docs, lengths, parts, words, codes, n_train).

    ``train`` and ``held`` are columns: who is learned from, and which of those are set aside for the weights; they are bits
    of parts. words are the stretch's word hashes, the most frequent first, codes the tokens as places in words. A text is
    never cut.
    """
    names = ["batch", "docs", "lengths", "parts", "words", "codes", "n_train"]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]

    def run(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        hashes = HashCache(lambda w: np.uint64(_word_hash(w)).tobytes(), 200_000)
        ids, lengths, parts, words, size = [], [], [], [], 0

        def flush():
            uniq, at, n = np.unique(np.frombuffer(b"".join(words), np.uint64), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            train_tokens = sum(x for x, p in zip(lengths, parts) if p & 1)
            values = [base + made, ids, lengths, parts, uniq[order].tobytes(), squeeze(rank[at]), train_tokens]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        end = END.tobytes()
        for rows in slices(batches):
            for doc, text, learn, aside in zip(*(c.to_pylist() for c in rows.columns)):
                w = [*map(hashes.__getitem__, (text or "").encode().lower().split()), end]
                if size and size + len(w) > BATCH_TOKENS:
                    yield flush()
                    made += 1
                    ids, lengths, parts, words, size = [], [], [], [], 0
                ids.append(doc)
                lengths.append(len(w))
                parts.append(learn + 2 * aside)
                words += w
                size += len(w)
        if ids:
            yield flush()

    ddl = "batch long, docs array<long>, lengths array<long>, parts array<long>, words binary, codes binary, n_train long"
    return docs.select(F.col("doc_id").cast("long").alias("d"), "text", train.cast("int").alias("t"), held.cast("int").alias("h")).mapInArrow(tidy(run), ddl)


#: Hashes are compared by their upper 56 bits.
KEY = np.uint64(0xFFFFFFFFFFFFFF00)


def _keys(words: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, distinct keys of words, pairs and START, place of each token's pair, place of each word and of START)."""
    word = np.frombuffer(words, np.uint64)
    tokens = word[unsqueeze(codes)]
    keys, at = np.unique(np.concatenate([pair_key(contexts(tokens), tokens), word, [START]]) & KEY, return_inverse=True)
    return tokens, keys, at[: len(tokens)], at[len(tokens) :]


def asked(numbered: DataFrame) -> DataFrame:
    """(batch, keys, columns): counts of each key in training, in the set-aside texts, and whether it is a word."""

    def run(parts):
        for rows in parts:
            for r in rows.to_pylist():
                tokens, keys, pair, word = _keys(r["words"], r["codes"])
                flag = np.repeat(np.array(r["parts"]), r["lengths"])
                codes = word[unsqueeze(r["codes"])]
                starts = np.full(len(r["parts"]), word[-1])
                where = np.concatenate([pair, codes, starts])
                flags = np.concatenate([flag, flag, np.array(r["parts"])])
                columns = [np.bincount(where, weights=(flags & bit) > 0, minlength=len(keys)).astype(np.int64) for bit in (1, 2)]
                is_word = np.zeros(len(keys), np.int64)
                is_word[word[:-1]] = 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["batch"]]), pa.array([pack_keys(keys)], pa.binary()), pa.array([[pack_column(c) for c in (*columns, is_word)]], pa.list_(pa.binary()))],
                    names=["batch", "keys", "columns"],
                )

    return numbered.mapInArrow(tidy(run), "batch long, keys binary, columns array<binary>")


def _sum_keys(group: np.ndarray, columns: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    train, held = (np.bincount(group, weights=v).astype(np.int64) for v in columns[:2])
    word = np.bincount(group, weights=columns[2]) > 0
    return [train, held], int(np.sum(word & (train > 0)))


def with_counts(numbered: DataFrame, answers: DataFrame) -> DataFrame:
    """The stretches with the corpus counts of their words, of START (last), and of each token's pair, in training and set aside."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        r = left.iloc[0]
        tokens, keys, pair, word = _keys(r["words"], r["codes"])
        counts = read_answers(right.sort_values("range")["answers"].tolist(), 2)
        end = np.flatnonzero(np.frombuffer(r["words"], np.uint64) == END)
        out = pd.DataFrame({
            "docs": [r["docs"]], "lengths": [r["lengths"]], "parts": [r["parts"]], "codes": [r["codes"]], "end": [int(end[0])],
            "words": [[squeeze(c[word]) for c in counts]], "pairs": [[squeeze(c[pair]) for c in counts]],
        })
        del tokens, keys, pair, word, counts
        give_back()
        return out

    kept = "docs array<long>, lengths array<long>, parts array<long>, codes binary, end long, words array<binary>, pairs array<binary>"
    return numbered.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(run, kept)


def _opened(r: dict) -> list[np.ndarray]:
    """Counts of (pair, context, word) of each token, each in training and set aside."""
    codes = unsqueeze(r["codes"])
    out = []
    for words, pairs in zip(r["words"], r["pairs"]):
        word = unsqueeze(words)
        seen = word[codes]
        before = np.empty_like(seen)
        before[:1] = word[-1]
        before[1:] = np.where(codes[:-1] == r["end"], word[-1], seen[:-1])
        out.append((unsqueeze(pairs), before, seen))
    return [x for pair in zip(*out) for x in pair]


@dataclass(frozen=True)
class Model:
    """Mixture weights of (pair, word, uniform) for each bucket of context counts, with the corpus totals."""

    weights: np.ndarray
    tokens: int
    vocabulary: int


def bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(count + 1)).astype(np.int64), BUCKETS - 1)


def _ratio_cell(x: np.ndarray) -> np.ndarray:
    """0 for zero, else quarters of a power of two from 2^-1 on."""
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.clip(np.round(np.log2(np.maximum(x, 1e-300)) * 4) + 5, 1, STEPS - 1), 0).astype(np.int64)


def estimate(histogram: list[tuple[int, int, int, int]], rounds: int = 200) -> np.ndarray:
    """EM on cells (bucket, pair ratio, word ratio, tokens): ratios of the estimates to the uniform one."""
    h = np.array(histogram, dtype=np.float64).reshape(-1, 4)
    which = h[:, 0].astype(int)
    odds = np.column_stack([np.where(h[:, i] > 0, 2.0 ** ((h[:, i] - 5) / 4), 0.0) for i in (1, 2)] + [np.ones(len(h))])
    w = np.tile([0.3, 0.5, 0.2], (BUCKETS, 1))
    for _ in range(rounds):
        share = w[which] * odds
        share *= (h[:, 3] / share.sum(axis=1))[:, None]
        new = np.full_like(w, 1e-3)  # a context never seen has a little of each
        np.add.at(new, which, share)
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - w).max() < 1e-7:
            return new
        w = new
    return w


def score(docs: DataFrame, train, held) -> DataFrame:
    """(doc_id, flag, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    Tokens are the words of the A-Z lower-cased text and one end. base_score is the add-one unigram log10 probability;
    score mixes, by the count of the context in training, the share of the word after the context, the word's share of
    all training tokens and the uniform share 1 / (V + 1). The weights are learned on the ``held`` part of the training
    texts, with their counts deleted; the counts that score are those of all training texts. Words and pairs are
    compared by 55-bit hashes. Counts travel as packed sorted arrays, one per stretch and range of keys, so a frequent word
    costs one number a stretch. To the driver come totals and a histogram of a fixed number of cells.
    Null texts count as empty. Repeated rows are scored, and counted, once each. Without training texts the base is
    uniform over an empty vocabulary.
    """
    numbered = cut_lineage(coded(docs, train, held))
    lengths = F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y)
    size = numbered.agg(F.coalesce(F.sum(lengths), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    answers = cut_lineage(ask(asked(numbered.select("batch", "lengths", "parts", "words", "codes")), _sum_keys, int(1.2 * size[0])))
    vocabulary = int(answers.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0])
    both = cut_lineage(with_counts(numbered, answers.select("batch", "range", "answers")))
    uniform = 1.0 / (vocabulary + 1)
    total = int(size[1])

    aside = both.select(F.explode(F.arrays_zip("parts", "lengths")).alias("x")).filter("x.parts & 2 > 0").agg(F.sum("x.lengths")).first()[0] or 0
    kept = total - aside

    def cells(parts):
        for rows in parts:
            for r in rows.to_pylist():
                p_all, p_held, c_all, c_held, w_all, w_held = _opened(r)
                flag = np.repeat(np.array(r["parts"]), r["lengths"]) & 2 > 0
                pair, ctx, word = (p_all - p_held)[flag], (c_all - c_held)[flag], (w_all - w_held)[flag]
                cell = (bucket(ctx) * STEPS + _ratio_cell(pair / np.maximum(ctx, 1) / uniform)) * STEPS + _ratio_cell(word / max(1, kept) / uniform)
                uniq, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(uniq), pa.array(n.astype(np.int64))], names=["cell", "n"])

    found = both.mapInArrow(tidy(cells), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS * STEPS * STEPS cells
    model = Model(estimate([(r["cell"] // STEPS**2, r["cell"] // STEPS % STEPS, r["cell"] % STEPS, r["n"]) for r in sorted(found)]), total, vocabulary)

    def scored(parts):
        for rows in parts:
            for r in rows.to_pylist():
                pair, _, ctx, _, word, _ = _opened(r)
                w = model.weights[bucket(ctx)]
                p = w[:, 0] * pair / np.maximum(ctx, 1) + w[:, 1] * word / max(1, total) + w[:, 2] * uniform
                base = np.log10((word + 1) / (total + vocabulary + 1))
                start = np.cumsum(r["lengths"]) - np.array(r["lengths"])
                sums = [np.add.reduceat(v, start) for v in ((word > 0).astype(np.int64), base, np.log10(p))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["docs"], pa.int64()), pa.array(np.array(r["parts"])), pa.array(r["lengths"], pa.int64()), *map(pa.array, sums)],
                    names=["doc_id", "flag", "n_tokens", "n_known", "base_score", "score"],
                )

    rows = both.mapInArrow(tidy(scored), "doc_id long, flag long, n_tokens long, n_known long, base_score double, score double")
    return rows.withColumn("train_tokens", F.lit(total).cast("long"))
