"""Quotes checked word for word against the evidence of their question, with the id put right where only one piece has them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quotes as Q
from ..functions.text import content_words


def verify(quotes: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question, quote_id, verified, id, why) of quotes (question, quote_id, quote, source).

    ``evidence``: (question, id, text, kind, image): kind is piece, page, or figure for figures and tables; image says that a
    picture was attached. verified is ``text`` if the quote is in the piece's words, or in those of exactly one other
    piece that is no figure, whose id is then given; ``image`` if it may be read from the attached picture, which nothing
    here can check; else ``no``, with the reason. A page's picture shows its words, so a quote made mostly of them is a
    misquote. Quotes meet the evidence of their own question only, under the named id first.
    """
    source = F.regexp_replace(F.trim(F.coalesce("source", F.lit(""))), r"^[\[\]]+|[\[\]]+$", "")
    asked = quotes.select("question", "quote_id", source.alias("source"), Q.comparable(F.col("quote")).alias("_q")).withColumn("_parts", Q.parts(F.col("_q")))
    asked = asked.select("question", "quote_id", "source", "_parts", Q.long_enough(F.col("_parts")).alias("_long"), Q.pattern(F.col("_parts")).alias("_pattern"))
    known = evidence.select("question", "id", Q.comparable(F.col("text")).alias("_text"), "kind", F.coalesce("image", F.lit(False)).alias("image"))
    words = lambda t: F.array_distinct(content_words(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0))))
    mine = words(F.array_join("_parts", " "))
    mostly = (F.size(mine) > 0) & (F.size(F.array_intersect(mine, words(F.col("_text")))) >= 0.5 * F.size(mine))
    whole = F.forall("_parts", lambda p: F.contains(F.col("_text"), p))
    asked, known = asked.alias("asked"), known.alias("known")
    met = asked.join(known, (F.col("asked.question") == F.col("known.question")) & F.col("_long"), "left")
    met = met.select("asked.question", "quote_id", "source", "_long", "id", "kind", "image", "_parts", "_pattern", "_text", (F.col("id") == F.col("source")).alias("named"))
    # a pattern is worked out where the text has all parts, words are compared on pictures of pages alone
    met = met.withColumn("held", F.when(whole, F.regexp_like("_text", "_pattern")).otherwise(F.lit(False)))
    met = met.withColumn("mostly", F.when(F.col("named") & F.col("image") & (F.col("kind") == "page"), mostly))
    named, other = F.col("named"), ~F.col("named") & (F.col("kind") != "figure") & F.col("held")
    found = met.groupBy("question", "quote_id", "source", "_long").agg(
        F.bool_or(named).alias("is_known"), F.bool_or(named & F.col("held")).alias("own"), F.count_if(other).alias("others"), F.min(F.when(other, F.col("id"))).alias("other"),
        F.bool_or(named & F.col("image")).alias("seen"), F.bool_or(F.col("mostly")).alias("misquoted"),
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    cases = (
        (~F.col("_long"), "no", F.col("source"), F.lit("quote too short")),
        (yes("own"), "text", F.col("source"), F.lit("")),
        (F.coalesce(F.col("others") == 1, F.lit(False)), "text", F.col("other"), F.concat(F.lit("found under "), "other", F.lit(", not "), F.when(F.col("source") == "", "(no id)").otherwise(F.col("source")))),
        (yes("seen") & yes("misquoted"), "no", F.col("source"), F.lit("the quote is not in this page's words")),
        (yes("seen"), "image", F.col("source"), F.lit("read from the attached image")),
        (~yes("is_known"), "no", F.col("source"), F.lit("this id is missing from the evidence")),
        (F.lit(True), "no", F.col("source"), F.lit("the quote is not in this piece")),
    )
    pick = lambda at: F.coalesce(*(F.when(c[0], F.lit(c[at]) if isinstance(c[at], str) else c[at]) for c in cases))
    return found.select("question", "quote_id", pick(1).alias("verified"), pick(2).alias("id"), pick(3).alias("why"))
