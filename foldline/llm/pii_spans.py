"""Personal data by pattern rules and a semi-Markov conditional random field over whole spans."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import hash_sample, map_rows

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
FEATURES = 1 << 11
MAX_TOKENS = 24
#: Bounds of the training sample.
SAMPLE_ROWS = 1_500
SAMPLE_LENGTH = 100_000
SAMPLE_ISLANDS = 700

_HAS = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs that start where a run starts: the same leftmost matches, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\S+")
_GAP = re.compile(r"[^\S\n]{1,2}")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\sA-Za-z0-9]")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches, leftmost and non-overlapping within each kind, in the order of KINDS, then start."""
    if not _HAS.search(text):
        return []
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        while at > last and text[at - 1] in _LOCAL:
            at -= 1
        if at < m.start():
            out.append(("email", at, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def islands(text: str, taken: list[tuple[str, int, int]] = ()) -> list[list[tuple[int, int]]]:
    """Token spans of each stretch of words with a digit or an @, without the characters that ``taken`` spans hold."""
    held: list[list[int]] = []  # taken spans, merged
    for _, a, b in sorted(taken, key=lambda x: x[1]):
        if held and a <= held[-1][1]:
            held[-1][1] = max(held[-1][1], b)
        else:
            held.append([a, b])
    out, at = [], 0
    for start, end in _stretches(text):
        group = []
        for t in _TOKEN.finditer(text, start, end):
            s, e = t.span()
            while at < len(held) and held[at][1] <= s:
                at += 1
            if at < len(held) and held[at][0] < e:
                if group:
                    out.append(group)
                group = []
            else:
                group.append((s, e))
        if group:
            out.append(group)
    return out


def _stretches(text: str):
    """(start, end) of neighbouring words that all have a digit or an @; one pass over the text."""
    start = end = None
    for m in _WORD.finditer(text):
        if not _HAS.search(text, *m.span()):
            continue
        if end is not None and _GAP.fullmatch(text, end, m.start()):
            end = m.end()
            continue
        if end is not None:
            yield start, end
        start, end = m.span()
    if end is not None:
        yield start, end


def _shape(s: str) -> str:
    return re.sub(r"([a9 ])\1+", r"\1", "".join("9" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in s))


def span_features(text: str, start: int, end: int) -> list[int]:
    """Hashed features of a whole candidate: its shape, counts, checks and neighbours."""
    s = text[start:end]
    digits = re.sub("[^0-9]", "", s)
    groups = re.findall("[0-9]+", s)
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    word = re.search(r"(\w*)\W*$", text[max(0, start - 20) : start])[1].lower()

    def side(c):
        return "edge" if not c or c.isspace() else "letter" if c.isalnum() else c

    found = [
        "bias", "shape " + _shape(s)[:40], f"digits {min(len(digits), 21)}", f"groups {min(len(groups), 7)}", f"sizes {[min(len(g), 6) for g in groups[:6]]}",
        f"at {min(s.count('@'), 2)}", f"dots {min(s.count('.'), 5)}", f"dashes {min(s.count('-'), 4)}", f"blanks {min(s.count(' '), 5)}", f"letters {any(c.isalpha() for c in s)}",
        f"luhn {len(digits) >= 12 and luhn(digits)} {len(digits)}", f"octets {len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)}",
        f"first {s[0] if not s[0].isalnum() else _shape(s[0])}", f"last {_shape(s[-1])}", f"before {side(before)}", f"after {side(after)}", f"word {word}",
    ]
    return [zlib.crc32(f.encode()) % FEATURES for f in found]


def candidates(text: str, tokens: list[tuple[int, int]]) -> dict[tuple[int, int], list[int]]:
    """Features of each bounded segment (first, last token) that may be an entity, and of every single token."""
    out = {}
    for i, (start, end) in enumerate(tokens):
        out[i, i] = span_features(text, start, end)
        head = text[start]
        if not (head in "+(" or head.isascii() and head.isalnum()):
            continue
        digits = 0
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            if j > i and tokens[j][0] - tokens[j - 1][1] > 2:
                break
            piece = text[tokens[j][0] : tokens[j][1]]
            digits += len(piece) * piece[0].isdigit()
            if digits > 20:
                break
            if j > i and piece[0].isascii() and piece[0].isalnum() and (digits >= 4 or "@" in text[start : tokens[j][1]]):
                out[i, j] = span_features(text, start, tokens[j][1])
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # labels x FEATURES; the first label is a single token outside of entities
    moves: np.ndarray  # labels x labels


def _scores(model: Model, cand: dict) -> dict:
    return {k: model.weights[:, f].sum(axis=1) for k, f in cand.items()}


def decode(model: Model, text: str, tokens: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Boundaries and kinds of the best segmentation, by dynamic programming over ends of segments of bounded length."""
    cand = candidates(text, tokens)
    score = _scores(model, cand)
    n, k = len(tokens), len(LABELS)
    best, back = np.full((n + 1, k), -np.inf), [[None] * k for _ in range(n + 1)]
    best[0, 0] = 0.0
    ends: dict[int, list[int]] = {}
    for i, j in cand:
        ends.setdefault(j, []).append(i)
    for j in range(n):
        for i in ends[j]:
            into = best[i][:, None] + model.moves
            prev = into.argmax(axis=0)
            for y in range(k):
                if y == 0 and i != j:
                    continue
                v = into[prev[y], y] + score[i, j][y]
                if v > best[j + 1, y]:
                    best[j + 1, y], back[j + 1][y] = v, (i, int(prev[y]))
    out, j, y = [], n, int(best[n].argmax()) if n else 0
    while j:
        i, prev = back[j][y]
        if y:
            out.append((LABELS[y], tokens[i][0], tokens[j - 1][1]))
        j, y = i, prev
    return out[::-1]


def _gold(tokens, spans) -> list[tuple[int, int, int]]:
    """Segments (first, last, label) of the tokens under the given spans."""
    out, i = [], 0
    while i < len(tokens):
        hit = next(((k, b) for k, a, b in spans if a == tokens[i][0]), None)
        j = i
        if hit:
            while j + 1 < len(tokens) and tokens[j + 1][1] <= hit[1]:
                j += 1
        ok = hit is not None and tokens[j][1] == hit[1]
        out.append((i, j if ok else i, LABELS.index(hit[0]) if ok else 0))
        i = (j if ok else i) + 1
    return out


def gradient(model: Model, cand: dict, gold: list, n: int) -> tuple[float, dict, np.ndarray]:
    """Log-likelihood of the gold segmentation and its gradient, by the semi-Markov forward and backward sums."""
    score, k = _scores(model, cand), len(LABELS)
    allowed = {s: (range(k) if s[0] == s[1] else range(1, k)) for s in cand}
    fwd, bwd = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
    fwd[0, 0] = 0.0
    bwd[n] = 0.0
    by_end, by_start = {}, {}
    for i, j in cand:
        by_end.setdefault(j, []).append(i)
        by_start.setdefault(i, []).append(j)
    with np.errstate(divide="ignore"):
        into = {}
        for j in range(n):
            for i in by_end[j]:
                if i not in into:
                    into[i] = np.logaddexp.reduce(fwd[i][:, None] + model.moves, axis=0)
                add = into[i] + score[i, j]
                if i != j:
                    add[0] = -np.inf
                fwd[j + 1] = np.logaddexp(fwd[j + 1], add)
        out_of = {}
        for i in range(n - 1, -1, -1):
            total = np.full(k, -np.inf)
            for j in by_start[i]:
                add = score[i, j] + bwd[j + 1]
                if i != j:
                    add[0] = -np.inf
                total = np.logaddexp(total, add)
            out_of[i] = total
            bwd[i] = np.logaddexp.reduce(model.moves + total[None, :], axis=1)
    z = np.logaddexp.reduce(fwd[n])
    seg = {}
    for (i, j), ys in allowed.items():
        p = np.exp(into[i] + score[i, j] + bwd[j + 1] - z)
        if i != j:
            p[0] = 0.0
        seg[i, j] = -p
    moves = np.zeros((k, k))
    for i in range(n):
        moves -= np.exp(fwd[i][:, None] + model.moves + out_of[i][None, :] - z)
    like, before = -z, 0
    for i, j, y in gold:
        seg[i, j][y] += 1
        moves[before, y] += 1
        like += model.moves[before, y] + score[i, j][y]
        before = y
    return float(like), seg, moves


def variants(text: str) -> list[tuple[str, list]]:
    """A text with its pattern matches, and again with phones and cards written in other common ways, still marked."""
    spans = sorted(base_spans(text), key=lambda s: s[1])
    spans = [s for i, s in enumerate(spans) if not any(a < s[2] and s[1] < b for _, a, b in spans[:i])]
    out = [(text, spans)]
    for style in range(2 if any(s[0] == "phone" for s in spans) else 0):
        made, moved, at = "", [], 0
        for kind, a, b in spans:
            made += text[at:a]
            new = text[a:b]
            if kind == "phone":
                d = re.sub("[^0-9]", "", new)[-10:]
                new = f"({d[:3]}) {d[3:6]}-{d[6:]}" if style else f"{d[:3]}-{d[3:6]}-{d[6:]}"
            moved.append((kind, len(made), len(made) + len(new)))
            made += new
            at = b
        out.append((made + text[at:], moved))
    return out


def train(texts: list[str], rounds: int = 8, limit: int = SAMPLE_ISLANDS) -> Model:
    """Maximum likelihood with AdaGrad steps on islands of the sample; the pattern matches are the marks to learn from."""
    model = Model(np.zeros((len(LABELS), FEATURES)), np.zeros((len(LABELS), len(LABELS))))
    cases = []
    for text in texts:
        for version, spans in variants(text):
            for tokens in islands(version):
                if len(tokens) <= 80:
                    cand = candidates(version, tokens)
                    gold = _gold(tokens, spans)
                    if all((i, j) in cand for i, j, _ in gold):
                        cases.append((cand, gold, len(tokens)))
        if len(cases) >= limit:
            break
    sums_w, sums_m = np.full_like(model.weights, 1e-3), np.full_like(model.moves, 1e-3)
    for _ in range(rounds):
        for cand, gold, n in cases:
            _, seg, moves = gradient(model, cand, gold, n)
            grad = np.zeros_like(model.weights)
            for key, g in seg.items():
                if np.abs(g).max() > 1e-6:
                    np.add.at(grad, (slice(None), cand[key]), g[:, None])
            sums_w += grad**2
            sums_m += moves**2
            model.weights[:] += 0.3 * grad / np.sqrt(sums_w) - 1e-5 * model.weights
            model.moves[:] += 0.3 * moves / np.sqrt(sums_m)
    return model


def find(model: Model, text: str | None) -> tuple[list, list]:
    """(base, all) spans of a whole text; what the model adds never overlaps a pattern match."""
    text = text or ""
    base = base_spans(text)
    more = [s for tokens in (islands(text, base) if _HAS.search(text) else ()) for s in decode(model, text, tokens)]
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + more, key=lambda s: (order[s[0]], s[1]))


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``rows`` whole texts of up to SAMPLE_LENGTH characters with digits or an @, chosen by a hash."""
    some = docs.filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_LENGTH)).select("text")
    return train(sorted(r["text"] for r in hash_sample(some, ["text"], rows).collect()))


def mark(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """Add base_spans and spans (arrays of kind, start, end in code points, end exclusive) to the columns of ``docs``.

    Null and empty texts have none; whole texts are read, row by row.
    """
    columns = columns or docs.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    kind = "array<struct<kind: string, start: long, end: long>>"

    def run(*row):
        base, every = find(model, row[-1])
        return (*row[:-1], *([{"kind": k, "start": a, "end": b} for k, a, b in x] for x in (base, every)))

    return map_rows(docs.select(*columns, F.col("text").alias("__text")), [*columns, "__text"], f"{ddl}, base_spans {kind}, spans {kind}", run)
