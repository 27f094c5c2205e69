"""Text functions as columns; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern, function words.
TOKEN = r"[A-Za-z0-9]+(?:[-.][A-Za-z0-9]+)*"
FUNCTION_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
DASHES = "‐‑‒–—"
#: What Unicode calls space separators.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order; null texts have none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def content_words(words: Column) -> Column:
    return F.filter(words, lambda w: (F.char_length(w) > 1) & ~w.isin(*FUNCTION_WORDS))


def squeeze(text: Column) -> Column:
    """White space runs become one space, dashes become '-'."""
    return F.trim(F.regexp_replace(F.translate(text, DASHES, "-" * len(DASHES)), r"[ \t\n\r\f]+", " "))


def padded_words(text: Column) -> Column:
    """Lower-cased words between single spaces, a space at both ends, for whole-word containment by instr."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def no_none(text: Column) -> Column:
    return F.when(F.lower(text).isin("none", "null"), "").otherwise(F.coalesce(text, F.lit("")))


def sentences(text: Column) -> Column:
    """Sentences: cut behind '.', '!' or '?' before white space, and at line feeds; trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"([.!?])[ \n]+", "$1\n"), "\n"), lambda s: F.btrim(s, F.lit(SPACES))), lambda s: s != "")


def informative(sents: Column, most: int, at_least: int = 3) -> Column:
    """Sentences of at least so many content words; more than ``most``: the first most - 1 and the last."""
    kept = F.filter(sents, lambda s: F.size(content_words(tokens(s))) >= at_least)
    return F.when(F.size(kept) <= 1, F.array().cast("array<string>")).when(F.size(kept) > most, F.concat(F.slice(kept, 1, most - 1), F.slice(kept, -1, 1))).otherwise(kept)


def number_list(text: Column) -> Column:
    """'3, 5, and 6' or '3 through 5' as the numbers meant, ascending and distinct."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d{1,6}(?: (?:through|to) \d{1,6})?)"), F.lit(1))

    def spread(p: Column) -> Column:
        ends = F.transform(F.regexp_extract_all(p, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
        low, high = F.element_at(ends, 1), F.element_at(ends, -1)
        return F.when(high >= low, F.sequence(low, F.greatest(low, high))).otherwise(F.array(low))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, spread))))


def authority(text: Column) -> Column:
    """The heading that a sentence's verb implies."""
    has = lambda words: F.lower(text).rlike(f"(^|[^a-z])({words})([^a-z]|$)")
    return F.when(has("shall|must"), "Standard").when(has("should"), "Guidance").when(has("may"), "Option").otherwise("Support")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")


def id63(key: Column) -> Column:
    """A stable 63-bit id: the first 8 bytes of sha1, shifted right by one."""
    high = F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(F.sha1(key), 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 31).bitwiseOR(F.shiftright(low, 1))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two arrays as sets; of two empty ones 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
