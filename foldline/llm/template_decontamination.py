"""Benchmark decontamination by templates: numbers, names and units become typed slots whose fillings must be consistent.

Beside the templates, windows of the lower-cased tokens themselves find copies that the slots hide: in other case, of
items that are mostly slots, and copies of which a slot or a word was changed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import slices, slices_by_bytes, tidy
from foldline.llm.line_dedup import Powers, _mix
from foldline.session import cut_lineage

#: Tokens of a template window; a shorter item is one window.
WINDOW = 8
#: Windows of plain tokens on one alignment that are a leak however long the item is: 31 tokens in a row.
LONG_RUN = 24
#: Mark of plain windows and items, which no template begins with.
PLAIN = "="
#: Bits of the filter of benchmark windows: its size is fixed, a larger benchmark only lets more windows reach the join.
FILTER_BITS = 25

#: Bytes of texts that are looked at together.
SLICE_BYTES = 1 << 18

#: Fixed word lists of the slots.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())
UNITS = frozenset("mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters mph kph watt watts volt volts joule joules".split())

LITERAL, NUMBER, UNIT, NAME = range(4)
_SLOT = {k: np.uint64(0x5107000000000000 + k) for k in (NUMBER, UNIT, NAME)}
_SPELLED = {NUMBER: "<number>", UNIT: "<unit>", NAME: "<name>"}


#: What a character can be: part of a word, a digit (any script, as a token's first one), 0 to 9, upper case, a mark of sentences.
_WORD, _DIGIT, _ASCII, _UPPER, _MARK = (1 << i for i in range(5))


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """(what it is, number of its lower case) of every code point."""
    every = range(0x110000)
    is_a = np.zeros(len(every), np.uint8)
    for bit, test in ((_WORD, str.isalnum), (_DIGIT, str.isdigit), (_UPPER, str.isupper)):
        is_a[np.fromiter(map(test, map(chr, every)), bool, len(every))] |= bit
    is_a[48:58] |= _ASCII
    is_a[[ord(c) for c in ".!?\n"]] |= _MARK
    lower = np.fromiter((ord(c.lower()[0]) for c in map(chr, every)), np.uint64, len(every))
    return is_a, _letters(lower)


def _letters(code_points: np.ndarray) -> np.ndarray:
    return _mix(_mix((code_points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1)


def _word_hash(low: str, powers: Powers) -> np.uint64:
    """Hash of one lower-cased word, as :meth:`Templates.find` has it."""
    up, _ = powers(len(low) + 1)
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _mix((_letters(points) * up[:-1]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(low)))[0]


class Templates:
    r"""Tokens, kinds and hashes of texts after their slots are found, and the hashes of the tokens themselves.

    A token is ``[^\W_]+(?:[.,][0-9]+)*``. Texts are joined and looked at as arrays of code points, so that no
    token becomes a string before a window of it is needed.
    """

    #: Lower case of these depends on what is around them or has two letters.
    ODD = "\u0130\u03a3"

    def __init__(self):
        self.powers, (self.is_a, self.letters) = Powers(), _characters()
        self.words = {k: np.sort([_word_hash(w, self.powers) for w in words]) for k, words in ((UNIT, UNITS), (NUMBER, NUMBER_WORDS))}

    def find(self, texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(data, first token of each text and their number, start, end, kind, code, plain): tokens are ``data[start:end]``."""
        data = "\n".join([t or "" for t in texts]) + "\n"
        points = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)
        is_a = self.is_a[points]
        word = np.zeros(len(is_a) + 1, bool)
        word[1:] = is_a & _WORD > 0
        edge = np.flatnonzero(word[1:] != word[:-1])  # the last character is a newline, so that every word ends
        start, end = edge[::2], edge[1::2]
        start, end, joints = self._with_decimals(points, is_a, start, end)
        size = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
        first = np.searchsorted(start, np.append(0, np.cumsum(size)))
        # a sentence begins where a mark is between a token and the one before
        marks = np.flatnonzero(is_a & _MARK)
        marks = marks[~np.isin(marks, joints)] if len(joints) else marks
        seen = np.searchsorted(marks, start)
        begins = np.ones(len(start), bool)
        begins[1:] = seen[1:] != seen[:-1]
        up, down = self.powers(len(points) + 1)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(self.letters[points] * up[:-1], out=total[1:])
        plain = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        for i in self._odd(points, start, end) if any(c in data for c in self.ODD) else ():
            plain[i] = _word_hash(data[start[i] : end[i]].lower(), self.powers)
        head = is_a[start]
        kind = np.where((head & _UPPER > 0) & ~begins, NAME, LITERAL).astype(np.int8)
        for k, words in self.words.items():
            kind[words[np.minimum(np.searchsorted(words, plain), len(words) - 1)] == plain] = k
        kind[head & _DIGIT > 0] = NUMBER
        code = plain.copy()
        for k, h in _SLOT.items():
            code[kind == k] = h
        return data, first, start, end, kind, code, plain

    def _with_decimals(self, points, is_a, start, end):
        """(start, end, joints): runs of word characters to which points or commas join digits, and the places of these."""
        after = start[1:] - 1
        joined = (end[:-1] == after) & ((points[after] == 46) | (points[after] == 44)) & (is_a[start[1:]] & _ASCII > 0)
        at = np.flatnonzero(joined) + 1
        if not len(at):
            return start, end, at
        # the digits go to the token before; what follows them in the same run is a token of its own
        stop = np.flatnonzero(is_a & _ASCII == 0)
        digits = np.minimum(end[at], stop[np.searchsorted(stop, start[at])])
        rest = np.flatnonzero(digits < end[at])
        new, piece_end = np.append(True, ~joined), end.copy()
        piece_end[at] = digits
        begin = np.insert(start, at[rest] + 1, digits[rest])
        piece_end = np.insert(piece_end, at[rest] + 1, end[at[rest]])
        head = np.flatnonzero(np.insert(new, at[rest] + 1, True))
        return begin[head], piece_end[np.append(head[1:], len(begin)) - 1], start[at] - 1

    def _odd(self, points, start, end):
        places = np.flatnonzero(np.isin(points, [ord(c) for c in self.ODD]))
        of = np.searchsorted(start, places, side="right") - 1
        return np.unique(of[(of >= 0) & (places < end[of])])

    def __call__(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        data, _, start, end, kind, code, plain = self.find([text])
        return _cut(data, start, end), kind, code, plain


def _cut(data: str, start: np.ndarray, end: np.ndarray) -> list[str]:
    return [data[a:b] for a, b in zip(start.tolist(), end.tolist())]


def _rolled(code: np.ndarray, width: int, start: int) -> np.ndarray:
    n = max(0, len(code) - width + 1)
    h = np.full(n, np.uint64(start), np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[j : j + n]
        h ^= h >> np.uint64(29)
    return h


def plain_hashes(plain: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of tokens."""
    return _rolled(plain, width, 1 << 20)


def window_hashes(code: np.ndarray, kind: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows of which at least half is literal."""
    h = _rolled(code, width, width)
    if not len(h):
        return np.zeros(0, np.int64), h
    literal = np.cumsum(np.append(0, kind == LITERAL))
    at = np.flatnonzero(2 * (literal[width:] - literal[:-width]) >= width)
    return at, h[at]


def _spell(tokens: list[str], kind: np.ndarray, at: int, width: int) -> tuple[str, list[str]]:
    """Template text of a window and its slots as position:kind:value."""
    template, slots = [], []
    for i in range(at, at + width):
        k = int(kind[i])
        template.append(_SPELLED.get(k) or tokens[i].lower())
        if k != LITERAL:
            slots.append(f"{i - at}:{k}:{tokens[i].lower()}")
    return " ".join(template), slots


def _digest(tokens: list[str], kind: np.ndarray) -> str:
    """Digest of a text's whole template."""
    return xxhash.xxh3_128_hexdigest(_spell(tokens, kind, 0, len(tokens))[0].encode())


def _words(tokens: list[str]) -> str:
    return " ".join(t.lower() for t in tokens)


def _plain_digest(tokens: list[str]) -> str:
    return PLAIN + xxhash.xxh3_128_hexdigest(_words(tokens).encode())


def row_key() -> Column:
    """Two hashes of doc_id and text, 128 bits: the same for repeated rows only."""
    return F.concat(F.hex(F.xxhash64("doc_id", "text")), F.lit("-"), F.hex(F.xxhash64("text", "doc_id")))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(hash, template, pos, width, windows, whole) of every distinct whole template; whole is its digest.

    Windows of plain tokens, of items with at least ``window`` tokens, have marked templates and digests.
    """

    def run(batches):
        find = Templates()
        for rows in slices(batches):
            out = []
            for text in rows.column(0).to_pylist():
                tokens, kind, code, plain = find(text)
                width = min(window, len(tokens))
                if width == window:
                    h, whole = plain_hashes(plain, width), _plain_digest(tokens)
                    out += [(int(x), PLAIN + _words(tokens[a : a + width]), a, width, len(h), whole) for a, x in enumerate(h.view(np.int64))]
                at, h = window_hashes(code, kind, width) if width else ((), ())
                whole = _digest(tokens, kind)
                out += [(int(x.view(np.int64)), _spell(tokens, kind, int(a), width)[0], int(a), width, len(at), whole) for a, x in zip(at, h)]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], schema=schema)

    names = ["hash", "template", "pos", "width", "windows", "whole"]
    schema = pa.schema([("hash", pa.int64()), ("template", pa.string()), ("pos", pa.int64()), ("width", pa.int64()), ("windows", pa.int64()), ("whole", pa.string())])
    found = benchmark.select("text").mapInArrow(tidy(run), "hash long, template string, pos long, width long, windows long, whole string")
    return found.dropDuplicates(["whole", "pos"])


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(whole, base, item_id, own): digests of each item's whole template and its slots' fillings as kind:value by position, null for literals.

    Each item has a second row with the digest of its plain tokens and no fillings; base is the template's digest in both.
    """

    def run(batches):
        find = Templates()
        for rows in slices(batches):
            out = []
            for item, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                tokens, kind, _, _ = find(text)
                base = _digest(tokens, kind)
                out.append((base, base, item, [None if k == LITERAL else f"{k}:{t.lower()}" for t, k in zip(tokens, kind.tolist())]))
                out.append((_plain_digest(tokens), base, item, None))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o)) for o in out], schema=schema)

    schema = pa.schema([("whole", pa.string()), ("base", pa.string()), ("item_id", pa.int64()), ("own", pa.list_(pa.string()))])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(tidy(run), "whole string, base string, item_id long, own array<string>").distinct()


def window_filter(windows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Set of the windows' hashes as a bitmap of fixed size, joined word by word before it comes to the driver."""
    place = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    words = windows.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("set"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in words.collect():
        out[r["word"]] = r["set"]
    return out.view(np.uint64)


def _plain(column: str) -> Column:
    return F.startswith(F.col(column), F.lit(PLAIN))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5, long_run: int = LONG_RUN) -> DataFrame:
    """(key, doc_id, item_id, kind, coverage, windows, at): benchmark items whose template or tokens a document holds.

    A window is a run of ``window`` tokens with at least half of them literal; numbers, units and names (capitalised
    within a sentence) are typed slots. Windows of a document and an item are joined by hash and compared as text. Of
    windows on one alignment (same distance of the positions) all slots must agree: a value of the item is always filled
    by the same value of the document. The document leaks the item if they cover at least ``coverage`` of the item's windows;
    kind is verbatim if the fillings are the item's own, else reparameterised.

    Windows of plain lower-cased tokens, whatever their kinds, are joined likewise for items of at least ``window`` tokens:
    on one alignment ``coverage`` of the item's, or ``long_run`` of them, is a leak, verbatim if they are all of them, else an excerpt.
    So copies in other case, items of numbers or names, and copies with a changed word or an inconsistent slot are found.

    Items of one template are all checked, each with its own fillings: those held verbatim are named, or, if there is none,
    the one covered most (of equals the smallest id, null last). key is :func:`row_key`; of several alignments of a pair the
    one that covers most counts. Items of fewer tokens without a literal window (null, empty, slots only) match nothing;
    null texts leak nothing.
    """
    known = cut_lineage(benchmark_windows(benchmark, window))
    widths = sorted(r["width"] for r in known.filter(~_plain("template")).select("width").distinct().collect())  # at most ``window`` of them
    bitmap = docs.sparkSession.sparkContext.broadcast(window_filter(known))
    schema = pa.schema([("key", pa.string()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("template", pa.string()), ("filled", pa.list_(pa.string())), ("doc_pos", pa.int64())])

    def run(batches):
        find, bits = Templates(), bitmap.value
        mask = np.uint64(len(bits) * 64 - 1)

        def hits(h):
            place = h & mask
            return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0

        for rows in slices_by_bytes(batches, 2, SLICE_BYTES):
            out, (keys, ids, texts) = [], (c.to_pylist() for c in rows.columns)
            data, first, start, end, kind, code, plain = find.find(texts)
            of = np.repeat(np.arange(len(texts)), np.diff(first))

            def found(at, h, width):
                """(row, place in it, place, hash) of the windows that pass the filter and lie in one text."""
                hit = hits(h)
                at, h = at[hit], h[hit]
                whole = of[at] == of[at + width - 1]
                at, h = at[whole], h[whole]
                return zip(of[at].tolist(), (at - first[of[at]]).tolist(), at.tolist(), h.view(np.int64).tolist())

            def tokens(at, width):
                return _cut(data, start[at : at + width], end[at : at + width])

            h = plain_hashes(plain, window)
            out += [(keys[r], ids[r], x, PLAIN + _words(tokens(a, window)), [], p) for r, p, a, x in found(np.arange(len(h)), h, window)]
            for width in widths:
                for r, p, a, x in found(*window_hashes(code, kind, width), width):
                    out.append((keys[r], ids[r], x, *_spell(tokens(a, width), kind[a : a + width], 0, width), p))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    d = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = d.mapInArrow(tidy(run), "key string, doc_id long, hash long, template string, filled array<string>, doc_pos long")
    met = cut_lineage(seen).join(known, ["hash", "template"]).withColumn(
        "filled", F.transform("filled", lambda s: F.struct((F.col("pos") + F.substring_index(s, ":", 1).cast("int")).cast("int").alias("i"), F.regexp_replace(s, r"^\d+:", "").alias("other")))
    )
    group = met.groupBy("key", "doc_id", "whole", (F.col("doc_pos") - F.col("pos")).alias("at")).agg(
        F.count_distinct("pos").alias("windows"), F.first("windows").alias("of"), F.array_distinct(F.flatten(F.collect_set("filled"))).alias("filled")
    )
    pairs = F.array_distinct(F.transform("filled", lambda s: F.struct(F.get("own", s["i"]).alias("own"), s["other"].alias("other"))))
    least = F.when(_plain("whole"), F.least(coverage * F.col("of"), F.lit(float(long_run)))).otherwise(coverage * F.col("of"))
    each = group.filter(F.col("windows") >= least).join(benchmark_items(benchmark), "whole").withColumn("pairs", pairs)
    consistent = F.size("pairs") == F.size(F.array_distinct(F.col("pairs.own")))
    own = F.forall("pairs", lambda p: p["own"] == p["other"])
    kind = F.when(_plain("whole") & (F.col("windows") < F.col("of")), "excerpt").when(own, "verbatim").otherwise("reparameterised")
    best = F.struct((F.col("windows") / F.col("of")).alias("coverage"), kind.alias("kind"), "windows", (-F.col("at")).alias("before"))
    found = each.filter(consistent).groupBy("key", "doc_id", "base", "item_id").agg(F.max(best).alias("best"))
    order = F.struct((-F.col("best.coverage")).alias("less"), F.col("item_id").isNull().alias("last"), "item_id", "best")
    verbatim = F.col("best.kind") == "verbatim"
    named = found.groupBy("key", "doc_id", "base").agg(F.collect_list(F.when(verbatim, order)).alias("same"), F.min(order).alias("other"))
    named = named.select("key", "doc_id", F.explode(F.when(F.size("same") > 0, F.col("same")).otherwise(F.array("other"))).alias("one"))
    return named.select("key", "doc_id", "one.item_id", "one.best.kind", "one.best.coverage", "one.best.windows", (-F.col("one.best.before")).alias("at"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """Rows of ``docs`` (all columns) that leak no item; repeated rows, null texts and null ids stay unless their text leaks."""
    bad = cut_lineage(leaks(docs, benchmark, window, coverage).select(F.col("key").alias("__leak")).distinct())
    return docs.withColumn("__key", row_key()).join(bad, F.col("__key") == F.col("__leak"), "left_anti").drop("__key")
