"""Text measures and extraction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: Unicode whitespace inside a bracket expression. The (?U) flag of the patterns makes the class s the
# Unicode property, which matches faster than spelled-out ranges; the separators 1C-1F complete it.
WHITESPACE = r"\s\x1c-\x1f"


def word_count(text: Column) -> Column:
    """Whitespace-separated words; an empty or blank text has none."""
    return F.regexp_count(text, F.lit(f"(?U)[^{WHITESPACE}]+")).cast("long")


def text_measures(text: Column) -> dict[str, Column]:
    """Lengths, counts and character-class shares; null counts as empty text."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t).cast("long")
    words = word_count(t)
    by_len = F.greatest(n, F.lit(1)).cast("double")
    return {
        "len": n,
        "word_count": words,
        "sentence_count": F.regexp_count(t, F.lit("[.!?]+")).cast("long"),
        "avg_word_len": n / F.greatest(words, F.lit(1)).cast("double"),
        "uppercase_ratio": F.regexp_count(t, F.lit("[A-Z]")) / by_len,
        "digit_ratio": F.regexp_count(t, F.lit(r"\p{Nd}")) / by_len,
        "special_char_ratio": F.regexp_count(t, F.lit(f"(?U)[^a-zA-Z0-9{WHITESPACE}]")) / by_len,
    }


def approx_tokens(text: Column, factor: float = 1.3) -> Column:
    return word_count(F.coalesce(text, F.lit(""))) * F.lit(factor)


def json_objects(text: Column) -> Column:
    """Shortest brace-delimited pieces that parse as JSON; a missing last brace is forgiven."""

    def pieces(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(r"(?s)\{.*?\}"), 0)
        return F.filter(found, lambda s: F.try_parse_json(s).isNotNull())

    found = pieces(text)
    return F.when((F.size(found) > 0) | F.endswith(text, F.lit("}")), found).otherwise(
        pieces(F.concat(text, F.lit("}")))
    )


def code_blocks(text: Column) -> Column:
    """Bodies of fenced code blocks, an optional language tag left out."""
    return F.regexp_extract_all(text, F.lit(r"(?s)```(?:python)?\n*(.*?)\n*```"), 1)


def before_fence(text: Column) -> Column:
    """Text up to the first fence; empty when there is none."""
    return F.when(F.contains(text, F.lit("```")), F.trim(F.substring_index(text, "```", 1))).otherwise(F.lit(""))


def head_tail(text: Column, limit: int = 5100, keep: int = 2500) -> Column:
    """Long text shortened to its head and tail with a note of what is left out."""
    n = F.length(text)
    note = F.format_string("\n ... [%d characters truncated] ... \n", n - 2 * keep)
    return F.when(n > limit, F.concat(F.left(text, F.lit(keep)), note, F.right(text, F.lit(keep)))).otherwise(text)
