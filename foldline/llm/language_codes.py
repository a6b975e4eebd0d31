"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import crc_remainder, map_rows, sigmoid

DIMENSIONS = 1 << 12
ORDERS = (1, 2, 3)
#: Bounds of the labelled sample, whole texts: rows and bytes over all languages.
SAMPLE_ROWS = 4_000
SAMPLE_BYTES = 20_000_000
#: Multiplications spent on the choice among random codes.
CODE_WORK = 2_000_000_000
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codewords: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # bits x (DIMENSIONS + 1)
    reliability: np.ndarray  # weight of each bit's loss


def codewords(n: int, bits: int | None = None) -> np.ndarray:
    """n codewords of -1 and 1, far apart: all two-sided splits for few languages, else the best of seeded random codes."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6 and bits is None:
        splits = np.arange(2 ** (n - 1) - 1)
        rest = (splits[None, :] >> np.arange(n - 1)[:, None]) & 1
        return np.vstack([np.ones((1, len(splits)), np.int8), rest * 2 - 1]).astype(np.int8)
    bits, rng = bits or int(np.ceil(15 * np.log2(n))), np.random.default_rng(17)
    best, far = None, -1
    for _ in range(max(1, min(200, CODE_WORK // (n * n * bits)))):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        alike = code.astype(np.float32) @ code.T.astype(np.float32)
        np.fill_diagonal(alike, -bits)
        apart = (bits - int(alike.max())) // 2
        if apart > far:
            best, far = code, apart
    return best


def ngram_counts(text: str | None, block: int = 1 << 20) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams of the lower-cased whole text; length one."""
    raw = np.frombuffer((text or "").lower().encode(), np.uint8)
    counts = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(raw), block):
        a = raw[at : at + block + max(ORDERS) - 1].astype(np.uint32)
        key = np.zeros(len(a), np.uint32)
        for n in ORDERS:
            m = min(block, len(a) - n + 1)
            if m <= 0:
                break
            key = key[:m] * np.uint32(0x01000193) ^ (a[n - 1 : n - 1 + m] + np.uint32(n * 257))
            counts += np.bincount((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12), minlength=DIMENSIONS)
    return np.sqrt(counts / max(1, counts.sum()))


def train(sample: list[tuple[str, str]], rounds: int = 60) -> Model:
    """One ridge-logistic n-gram classifier for each bit of the code, by gradient steps on the bounded sample."""
    names = tuple(sorted({lang for _, lang in sample}))
    code = codewords(len(names))
    if len(names) < 2:
        return Model(names, code, np.zeros((code.shape[1], DIMENSIONS + 1)), np.ones(code.shape[1]))
    x = np.ones((len(sample), DIMENSIONS + 1), np.float32)
    for i, (t, _) in enumerate(sample):
        x[i, :-1] = ngram_counts(t)
    lang = np.array([names.index(y) for _, y in sample])
    balance = (len(sample) / len(names) / np.bincount(lang, minlength=len(names)))[lang][:, None].astype(np.float32)
    y = ((code[lang] + 1) / 2).astype(np.float32)
    held = np.arange(len(sample)) % 5 == 0
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    velocity, rate = np.zeros_like(w), 8.0
    xt, bt, yt = x[~held], balance[~held], y[~held]
    for _ in range(rounds):
        ahead = w + np.float32(0.9) * velocity
        grad = xt.T @ (bt * (sigmoid(xt @ ahead) - yt)) / len(xt) + np.float32(1e-5) * ahead
        velocity = np.float32(0.9) * velocity - np.float32(rate) * grad
        w += velocity
    check, truth = (x[held], y[held]) if held.sum() >= 20 else (xt, yt)
    right = ((check @ w > 0) == (truth > 0.5)).mean(axis=0)
    return Model(names, code, w.T.astype(np.float64), np.maximum(right - 0.5, 1e-3) * 2)


def decode(model: Model, text: str | None) -> tuple[str, float, bool, float]:
    """(language, score, ambiguous, margin) by loss-weighted distance from the bits' margins to each codeword."""
    if not _LETTER.search(text or "") or not model.languages:
        return "und", 0.0, True, 0.0
    if len(model.languages) == 1:
        return model.languages[0], 1.0, False, 1.0
    f = model.weights[:, :-1] @ ngram_counts(text) + model.weights[:, -1]
    loss = np.logaddexp(0, -model.codewords * f) @ model.reliability / model.reliability.sum()
    order = np.argsort(loss, kind="stable")
    p = np.exp((loss[order[0]] - loss) * len(f))
    margin = float(loss[order[1]] - loss[order[0]])
    return model.languages[order[0]], float(1.0 / p.sum()), margin < 0.05, margin


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """About ``rows`` whole texts over all languages, chosen by a hash, as many as have ``size`` bytes together.

    Every language gets an equal part of both bounds; in the order of the hash each text that still fits is taken, and of a
    language without one its shortest. No text is cut and no language left out. Only rows whose crc32(doc_id as text)
    mod 3 is not 1 and whose lang is set are learned from.
    """
    d = docs.filter((crc_remainder(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    d = d.select("lang", "text", F.octet_length("text").alias("size"), F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 40) - 1)).alias("part"))
    counts = d.groupBy("lang").agg(F.count("*").alias("count"), F.min(F.struct("size", "part")).alias("least"))
    known = counts.collect()
    if not known:
        return []
    each = max(1, rows // len(known))
    below = [(r["lang"], r["least"]["part"], (1 << 40) * min(1.0, each / r["count"])) for r in known]
    below = F.broadcast(docs.sparkSession.createDataFrame(below, "lang string, least long, below double"))
    some = d.join(below, "lang").filter((F.col("part") < F.col("below")) | (F.col("part") == F.col("least")))
    order, held, chosen = some.groupBy("lang", "part").agg(F.min("size").alias("size")).collect(), {}, {}
    room = size / len(known)
    for r in sorted(order, key=lambda r: (r["lang"], r["part"])):
        if held.get(r["lang"], 0) + r["size"] <= room:
            held[r["lang"]] = held.get(r["lang"], 0) + r["size"]
            chosen.setdefault(r["lang"], set()).add(r["part"])
    for r in sorted(order, key=lambda r: (r["size"], r["part"])):
        chosen.setdefault(r["lang"], {r["part"]})
    parts = [p for c in chosen.values() for p in c]
    found = some.filter(F.col("part").isin(parts)).groupBy("lang", "part").agg(F.max("text").alias("text")).collect()
    texts = [(r["text"], r["lang"]) for r in found if r["part"] in chosen[r["lang"]]]
    return sorted(texts, key=lambda r: (xxhash.xxh64_intdigest(r[0].encode()), r[1]))


def fit(docs: DataFrame) -> Model:
    return train(labelled_sample(docs))


def predict(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """Add lang_pred, score (0 to 1), ambiguous and margin to the given columns (all by default) of ``docs``.

    Whole texts are read. Null texts and texts without a letter are ``und`` with score 0. A text is ambiguous if the two
    nearest codewords are about equally far. Rows are taken one by one: repeated and null ids do no harm.
    """
    columns = columns or docs.columns
    quoted = ["`" + c.replace("`", "``") + "`" for c in columns]
    plain = [f"c{k}" for k in range(len(columns))]
    rows = docs.select(*quoted, F.col("text").alias("__text")).toDF(*plain, "__text")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    found = map_rows(
        rows, rows.columns, f"{ddl}, lang_pred string, score double, ambiguous boolean, margin double", lambda *row: (*row[:-1], *decode(model, row[-1])),
    )
    return found.toDF(*columns, "lang_pred", "score", "ambiguous", "margin")
