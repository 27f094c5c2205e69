"""Functions on provisions: how list items combine, model replies as verdicts, entries of contents. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that say how the items of a list combine, verdicts, factors to a common unit, marks of entries.
ANY = r"(?i)\b(?:either of|any of|any one of|one or more of|at least one of|one of the following)\b"
ALL = r"(?i)\b(?:all of|both of|each of|all the following|both the following)\b"
EXCEPTIONS = r"(?i)\bexcept\b[^.]*\bfollowing\b"
VERDICTS = ("TRUE", "FALSE", "UNKNOWN")
FENCE = r"(?im)^\s*```(?:json)?\s*|\s*```\s*$"
OBJECT = r"(?s)(\{.*\})"
FACTORS = {"ft": 1.0, "in": 1 / 12, "yd": 3.0, "mi": 5280.0}
ENTRY = r"\.{4,} *[0-9]+ *$"


def list_mode(lead: Column, first: Column, before_last: Column, n: Column) -> Column:
    """How the items that a lead introduces combine: by the lead's phrase, else by the word that ends an item.

    One item alone is never ALL, whatever the lead says.
    """
    ends = lambda item, word: F.coalesce(F.trim(item).rlike(rf"(?i)\b{word} *[.;,]? *$"), F.lit(False)) & (n > 1)
    return (
        F.when(lead.rlike(EXCEPTIONS), "EXCEPTION CASES")
        .when(lead.rlike(ANY) | ends(first, "or"), "ANY")
        .when((n > 1) & (lead.rlike(ALL) | ends(before_last, "and")), "ALL")
        .otherwise("NOT STATED")
    )


def _one_object(text: Column) -> Column:
    """Whether the brace that opens a text closes at its end; readers of JSON pass over what follows a first value."""
    braces = F.regexp_extract_all(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), F.lit(r"[{}]"), F.lit(0))
    step = lambda a, b: F.struct((a["depth"] + F.when(b == "{", 1).otherwise(-1)).alias("depth"), (a["closed"] + F.when((b == "}") & (a["depth"] == 1), 1).otherwise(0)).alias("closed"))
    return F.aggregate(braces, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed")), step, lambda a: (a["depth"] == 0) & (a["closed"] == 1))


def verdict(reply: Column, allowed: Column) -> list[Column]:
    """(status, confidence, kept, dropped) of a model's reply; one that can't be read is UNKNOWN, never FALSE.

    A code fence goes, and what stands around the object. ``allowed`` is the array of ids that may be cited (key
    evidence); confidence is held to 0 to 1, and 0 where there is none or the status is no word for one.
    """
    found = F.regexp_extract(F.regexp_replace(F.coalesce(reply, F.lit("")), FENCE, ""), OBJECT, 1)
    read = F.when(F.try_parse_json(found).isNotNull() & _one_object(found), F.from_json(found, "status string, confidence string, evidence array<string>"))
    status = F.upper(F.trim(read["status"]))
    known = F.coalesce(status.isin(*VERDICTS), F.lit(False))
    cites = F.when(known, F.filter(F.transform(read["evidence"], lambda c: F.trim(c)), lambda c: c != ""))
    cites = F.coalesce(cites, F.array().cast("array<string>"))
    confidence = F.coalesce(F.when(known, read["confidence"].try_cast("double")), F.lit(0.0))
    return [
        F.when(known, status).otherwise("UNKNOWN").alias("status"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"),
        F.array_join(F.filter(cites, lambda c: F.array_contains(allowed, c)), ",").alias("kept"),
        F.array_join(F.filter(cites, lambda c: ~F.array_contains(allowed, c)), ",").alias("dropped"),
    ]


def in_feet(value: Column, unit: Column) -> Column:
    """A length in feet; null for units that measure none."""
    return value * F.create_map(*(F.lit(x) for pair in FACTORS.items() for x in pair))[unit]


def compared(value: Column, op: Column, bound: Column) -> Column:
    """TRUE, FALSE, or UNKNOWN where a side is missing."""
    holds = F.when(op == ">=", value >= bound - 1e-9).when(op == "<=", value <= bound + 1e-9).when(op == ">", value > bound + 1e-9).when(op == "<", value < bound - 1e-9).when(op == "=", F.abs(value - bound) <= 1e-9)
    return F.when(holds.isNull(), "UNKNOWN").when(holds, "TRUE").otherwise("FALSE")


def is_entry(line: Column) -> Column:
    """Whether a line is an entry of a table of contents: dot leaders and a page number."""
    return line.rlike(ENTRY)
