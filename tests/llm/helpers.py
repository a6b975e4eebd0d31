"""Brute-force twins and small tables for the corpus operators."""

from __future__ import annotations

import xxhash
from pyspark.sql import Row

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece int, batch long"


def docs_frame(spark, rows):
    """Documents (doc_id, text) with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, None, None, None, 7, None) for i, t in rows], DOC_SCHEMA)


def spark_rows(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def words_of(text: str | None) -> list[str]:
    out, word = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    return out


def slow_simhash(text: str | None) -> int:
    w = words_of(text)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked) -> dict:
    """Smallest member reachable, by search over all pairs."""
    left, out = sorted(nodes), {}
    while left:
        group, queue = {left[0]}, [left[0]]
        while queue:
            a = queue.pop()
            new = [b for b in left if b not in group and linked(a, b)]
            group.update(new)
            queue += new
        out |= dict.fromkeys(group, min(group))
        left = [x for x in left if x not in group]
    return out


def as_dicts(df) -> list[dict]:
    return [r.asDict() if isinstance(r, Row) else r for r in df.collect()]
