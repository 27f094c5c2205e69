"""Texts made comparable, and quotes as patterns that find their parts in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quote marks, dashes and spaces that count as one, and the least words of a quote and of a part.
SAME = {"‘": "'", "’": "'", "‛": "'", "′": "'", "“": '"', "”": '"', "‟": '"', "″": '"', "–": "-", "—": "-", "−": "-", "‐": "-", "‑": "-", "×": "x"}
QUOTE_WORDS, PART_WORDS = 5, 3
#: Marks that NFKC leaves as they are, also behind and before ASCII.
STABLE = "‘’‛′“”‟–—−‐×"


def composed(text: Column) -> Column:
    """A text in Unicode's NFKC form. Spark has none; texts of ASCII and common marks alone, which it leaves as they are, are passed by, the rest go in Arrow batches."""

    def nfkc(texts):
        return texts.str.normalize("NFKC")

    other = F.when(text.rlike(rf"[^\x00-\x7f{STABLE}]"), text)
    return F.coalesce(F.pandas_udf(nfkc, "string")(other), text)


def comparable(text: Column) -> Column:
    """One kind of quote mark and dash, no soft hyphens, one space, lower case; null is empty."""
    folded = F.translate(composed(F.coalesce(text, F.lit(""))), "".join(SAME) + "­", "".join(SAME.values()))
    return F.lower(F.regexp_replace(F.regexp_replace(folded, r"(?U)\s+", " "), "^ | $", ""))


def _bare(text: Column, marks: str) -> Column:
    return F.regexp_replace(text, rf"^[{marks}]+|[{marks}]+$", "")


def parts(quote: Column) -> Column:
    """Array of a comparable quote's parts: cut at an ellipsis, without quote marks and punctuation at either end."""
    pieces = F.split(_bare(quote, " \"'"), r"\s*\[?\s*(?:\.\.\.|…)\s*\]?\s*", -1)
    return F.filter(F.transform(pieces, lambda p: _bare(p, " \"'.,;:")), lambda p: p != "")


def long_enough(parts_: Column) -> Column:
    """Whether a quote has words enough in all, and in each part if it has several."""
    sizes = F.transform(parts_, lambda p: F.size(F.split(p, " ")))
    total = F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
    return (F.size(sizes) > 0) & (total >= QUOTE_WORDS) & ((F.size(sizes) == 1) | (F.array_min(sizes) >= PART_WORDS))


def pattern(parts_: Column) -> Column:
    """A pattern that finds all parts in order, each between word boundaries and not inside a longer number."""
    each = F.transform(parts_, lambda p: F.concat(F.lit(r"(?<![a-z0-9])(?<![0-9][.,])\Q"), p, F.lit(r"\E(?![a-z0-9])(?![.,][0-9])")))
    return F.array_join(each, r"[\s\S]*?")
