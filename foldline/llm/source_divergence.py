"""How the terms of each source differ from those of the other sources and of the whole language.

Strings are late: tasks count terms per stretch of documents and send digests of fixed width; a term's text leaves a task
once, in a side column for the dictionary. The smallest and the largest text of a digest tell whether two terms share it;
such digests, if any, are counted again by text. Ranked terms get their text back at the end.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldline.llm.common import slices_by_bytes, tidy
from foldline.session import cut_lineage, discard

#: p and q are integers: shares of this scale.
SCALE = 1_000_000_000
MIN_DOCS, MOST_TERMS = 3, 200
#: Bytes of text after which a task sends its counts, and bytes of terms that it remembers as sent.
STRETCH_BYTES, SENT_BYTES = 64 << 20, 48 << 20
DIGEST_BITS = 64
#: Bits of the filter that finds texts with shared digests again; what passes by mistake is dropped by a join.
FILTER_BITS = 1 << 20
#: Parts of a group that rank their terms apart before the group does.
SALTS = 16
#: Cells of the pair sums that a task holds before it sends them.
PAIR_CELLS = 1 << 22

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_LETTERS).split()


def digests_of(terms: list[bytes], bits: int) -> np.ndarray:
    """XXH64 of each term, or its lowest ``bits`` bits, as signed integers."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms))
    return (h & np.uint64((1 << bits) - 1)).view(np.int64)


def _groups(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


COUNTED = "lang string, source string, digest long, docs long, n long, term string"


def stretch_counts(docs: DataFrame, bits: int = DIGEST_BITS, only: np.ndarray | None = None) -> DataFrame:
    """(lang, source, digest, docs, n, term): counts of a term in a stretch of documents of one task.

    term is set the first time the task sends it. With ``only``, a filter of digests, just terms that pass it are counted
    and each row has its term.
    """

    def run(batches):
        docs_with, occurs, held, sent, sent_bytes = {}, {}, 0, set(), 0

        def flush():
            nonlocal sent_bytes
            for group, counter in occurs.items():
                having, every = docs_with[group], list(counter)
                for at in range(0, len(every), 1 << 16):
                    terms = every[at : at + (1 << 16)]
                    digests = digests_of(terms, bits)
                    if only is not None:
                        pick = only[digests % FILTER_BITS]
                        terms, digests = [t for t, x in zip(terms, pick) if x], digests[pick]
                        shown = terms
                    else:
                        shown = [None if t in sent else t for t in terms]
                        sent.update(terms)
                        sent_bytes += sum(100 + len(t) for t in shown if t is not None)
                        if sent_bytes > SENT_BYTES:
                            sent.clear()
                            sent_bytes = 0
                    if terms:
                        ns, in_docs = (np.fromiter(map(c.__getitem__, terms), np.int64, len(terms)) for c in (counter, having))
                        same = [pa.DictionaryArray.from_arrays(np.zeros(len(terms), np.int32), pa.array([g], pa.string())).dictionary_decode() for g in group]
                        yield pa.RecordBatch.from_arrays(
                            [*same, pa.array(digests), pa.array(in_docs), pa.array(ns), pa.array(shown, pa.binary()).cast(pa.string())],
                            names=["lang", "source", "digest", "docs", "n", "term"],
                        )

        for part in slices_by_bytes(batches, 2):
            for lang, source, text in zip(*(c.to_pylist() for c in part.columns)):
                words = terms_of(text)
                if words:
                    group = (lang, source)
                    if group not in occurs:
                        occurs[group], docs_with[group] = Counter(), Counter()
                    occurs[group].update(words)
                    docs_with[group].update(set(words))
                    held += len(text)
            if held > STRETCH_BYTES:
                yield from flush()
                docs_with, occurs, held = {}, {}, 0
        yield from flush()

    return _groups(docs).mapInArrow(tidy(run), COUNTED)


def dictionary(stretches: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, low, high): smallest and largest text of each wanted digest."""
    sent = stretches.filter("term IS NOT NULL").select("digest", "term")
    return sent.join(wanted.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))


def _kept(counts: DataFrame, min_docs: int) -> DataFrame:
    """Rows of terms that at least ``min_docs`` documents of the language hold, with the term's count in the language."""
    term = Window.partitionBy("lang", "digest", "alt")
    return counts.withColumns({"__df": F.sum("docs").over(term), "lang_n": F.sum("n").over(term)}).filter(F.col("__df") >= min_docs).drop("__df", "docs")


def _counts(rows: DataFrame, alt: Column) -> DataFrame:
    return rows.groupBy("lang", "source", "digest", alt.alias("alt")).agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def shared_filter(shared: DataFrame) -> np.ndarray:
    """Which remainders of digests a shared digest has: a bitmap of fixed size, whatever their number."""
    bits = np.zeros(FILTER_BITS, bool)
    bits[[r[0] for r in shared.select(F.pmod("digest", F.lit(FILTER_BITS)).alias("b")).distinct().collect()]] = True
    return bits


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, bits: int = DIGEST_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, digest, alt, n, lang_n) of kept terms and the dictionary. alt tells terms of one digest apart, else empty.

    A term is in at most as many documents as its digest, so only kept digests can hold kept terms: those are looked up in
    the dictionary, and where two texts share one its counts are replaced by counts of its texts.
    """
    stretches = cut_lineage(stretch_counts(docs, bits))
    kept = cut_lineage(_kept(_counts(stretches, F.lit("")), min_docs))
    words = cut_lineage(dictionary(stretches, kept))
    shared = words.filter("low <> high").select("digest")
    if not shared.isEmpty():
        again = stretch_counts(docs, bits, shared_filter(shared)).join(shared, "digest", "left_semi")
        apart = _kept(_counts(again, F.col("term")), min_docs)
        whole = kept
        kept = cut_lineage(whole.join(shared, "digest", "left_anti").unionByName(apart.select(whole.columns)))
        discard(whole)
    discard(stretches)
    return kept, words


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)) without rounding, also where the product exceeds 64 bits."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.call_function("div", top, (total + terms).cast("decimal(19,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are at most SCALE + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, held, terms, lang_total, p0) of every group, also without terms: its count of kept terms, how
    many of them it holds, those of the language, and the share of a term that it does not hold."""
    groups = _groups(docs).select("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    first = F.row_number().over(Window.partitionBy("lang", "digest", "alt").orderBy("source")) == 1
    langs = kept.withColumn("__first", first).groupBy("lang").agg(F.sum(F.col("__first").cast("long")).alias("terms"), F.sum("n").alias("lang_total"))
    sized = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "held", "terms", "lang_total"])
    return cut_lineage(sized.withColumn("p0", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))))


def shared_sums(held: DataFrame) -> DataFrame:
    """(lang, source, item, v): over terms that both sources hold, what their real shares change against those of a term
    that one or both do not hold. One row per term goes in; a task adds up before it sends."""
    per_term = held.groupBy("lang", "digest", "alt").agg(F.collect_list(F.struct("source", "p", "p0")).alias("e")).filter("size(e) > 1").select("lang", "e")

    def run(batches):
        langs: dict[str, tuple[dict, np.ndarray]] = {}
        cells = 0

        def out():
            for lang, (names, sums) in langs.items():
                known = pa.array(list(names), pa.string())
                for i in range(len(known)):
                    v = sums[i, : len(known)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(v), pa.string()), known.take(pa.array([i] * len(v))), known, pa.array(v)], names=["lang", "source", "item", "v"]
                    ).filter(pa.array(np.arange(len(v)) != i))

        for batch in batches:
            lists = batch.column(1)
            at = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            sources, p, p0 = lists.flatten().flatten()
            sources, p, p0 = sources.to_pylist(), p.to_numpy(zero_copy_only=False), p0.to_numpy(zero_copy_only=False)
            for lang, s, e in zip(batch.column(0).to_pylist(), at[:-1], at[1:]):
                if lang not in langs:
                    langs[lang] = {}, np.zeros((64, 64), np.int64)
                    cells += 64 * 64
                names, sums = langs[lang]
                place = [names.setdefault(x, len(names)) for x in sources[s:e]]
                if len(names) > len(sums):
                    grown = np.zeros((len(names) * 3 // 2,) * 2, np.int64)
                    grown[: len(sums), : len(sums)] = sums
                    cells += grown.size - sums.size
                    langs[lang] = names, grown
                    sums = grown
                a, a0, q, q0 = p[s:e, None], p0[s:e, None], p[s:e], p0[s:e]
                sums[np.ix_(place, place)] += (a - q) ** 2 // q - (a - q0) ** 2 // q0 - (a0 - q) ** 2 // q + (a0 - q0) ** 2 // q0
                if cells > PAIR_CELLS:
                    yield from out()
                    langs.clear()
                    cells = 0
        yield from out()

    sent = per_term.mapInArrow(tidy(run), "lang string, source string, item string, v long")
    return sent.groupBy("lang", "source", "item").agg(F.sum("v").alias("v"))


def pair_rows(held: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each pair of sources of a language, over all kept terms.

    f(p, q) is added up as if no term were in both sources, from histograms of shares, and :func:`shared_sums` mends the rest.
    """
    shares = held.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    g = groups.select("lang", "source", "held", "terms", "p0")
    other = groups.select("lang", F.col("source").alias("item"), F.col("held").alias("item_held"), F.col("p0").alias("item_p0"))
    none = g.join(other, "lang").filter("source <> item").select(
        "lang", "source", "item", F.when(F.col("terms") > 0, (F.col("terms") - F.col("held") - F.col("item_held")) * gap(F.col("p0"), F.col("item_p0"))).otherwise(0).alias("v")
    )
    mine = shares.join(other, "lang").filter("source <> item").select("lang", "source", "item", (F.col("m") * gap(F.col("p"), F.col("item_p0"))).alias("v"))
    theirs = shares.withColumnsRenamed({"source": "item", "p": "q"}).join(g, "lang").filter("source <> item")
    theirs = theirs.select("lang", "source", "item", (F.col("m") * gap(F.col("p0"), F.col("q"))).alias("v"))
    both = none.unionByName(mine).unionByName(theirs).unionByName(shared_sums(held))
    return both.groupBy("lang", "source", "item").agg(F.sum("v").alias("value"))


def term_rows(held: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """(lang, source, item, value) of the terms that may be among the ``most`` of their group, with text.

    Parts of a group rank first by value alone, ties kept; only what is left is joined with its text, and ranked again.
    """
    salt = F.pmod("digest", F.lit(SALTS))
    high = held.filter("p > q").withColumns({"value": gap(F.col("p"), F.col("q")), "__salt": salt})
    part = Window.partitionBy("lang", "source", "__salt")
    some = high.withColumn("__r", F.rank().over(part.orderBy(F.desc("value")))).filter(F.col("__r") <= most)
    named = some.join(words.select("digest", "low"), "digest", "left").withColumn("item", F.when(F.col("alt") == "", F.col("low")).otherwise(F.col("alt")))
    few = named.withColumn("__r", F.row_number().over(part.orderBy(F.desc("value"), "item"))).filter(F.col("__r") <= most)
    return few.select("lang", "source", "item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, most: int = MOST_TERMS, bits: int = DIGEST_BITS) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of each source from the others of its language (part ``pair``),
    and the up to ``most`` terms that it has above the language's share (part ``term``).

    Nulls count as empty strings, so a null and an empty lang or source are one; rows with one doc_id are different
    documents. Groups without terms have pairs of value 0 where the language keeps no term. An empty table gives no rows.
    ``bits`` narrows the digests (to test shared ones); the rows do not depend on it.
    """
    kept, words = kept_terms(docs, min_docs, bits)
    groups = group_sizes(docs, kept)
    sizes = groups.select("lang", "source", "total", "terms", "lang_total", "p0")
    held = kept.join(sizes, ["lang", "source"]).withColumns(
        {"p": share(F.col("n"), F.col("total"), F.col("terms")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))}
    )
    held = cut_lineage(held.select("lang", "source", "digest", "alt", "p", "q", "p0"))
    pairs = pair_rows(held, groups).withColumn("part", F.lit("pair"))
    terms = term_rows(held, words, most).withColumn("part", F.lit("term"))
    ranked = pairs.unionByName(terms).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= most)).select("lang", "source", "part", "item", "value", "rank")
