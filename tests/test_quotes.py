"""Quotes against a plain search, part by part."""

import re
import unicodedata

from pyspark.sql import functions as F

from veriseam.functions import quotes as Q
from veriseam.operators import quotes

EVIDENCE = [
    ("q", "a", "The “taper length” shall be 1,250 feet — not less than that, where the speed is 45 mph.", "piece", False),
    ("q", "b", "A sign ﬁxed to a post should be 7 feet high. It may be lower in rural areas.", "piece", False),
    ("q", "c", "It may be lower in rural areas.", "piece", False),
    ("q", "Figure 1", "A plan of the work zone with signs and cones", "figure", True),
    ("q", "p1", "Page words about the temporary traffic control of long term work zones", "page", True),
    ("r", "a", "Something else entirely stands in this piece of evidence", "piece", False),
]
QUOTES = {
    "'taper length' shall be 1,250 feet - not less than that": "a",
    "the taper length\" shall be 1,250 feet": "a",
    "shall be 250 feet - not less than that": "a",
    "shall be 1,250 feet … where the speed is 45": "a",
    "where the speed is 45 ... shall be 1,250 feet": "a",
    "a sign fixed to a post should": "b",
    "A SIGN ﬁxed to a post should.": "[a]",
    "it may be lower in rural areas": "zz",
    "be lower in rural areas, indeed": "b",
    "sign fixed to a": "b",
    "sign fixed [...] to a post should": "b",
    "read from the picture of the plan": "Figure 1",
    "a plan of the work zone with signs": "a",
    "the temporary traffic control of work zones long": "p1",
    "entirely different phrase that no page prints": "p1",
    "a post should be 7 feet hig": "b",
    "": "a",
    None: None,
    "something else entirely stands in this": "",
}


def norm(s):
    s = unicodedata.normalize("NFKC", s or "").replace("­", "")
    return re.sub(r"\s+", " ", "".join(Q.SAME.get(c, c) for c in s)).strip().lower()


def by_search(quote, source):
    parts = [p for p in (x.strip(" \"'.,;:") for x in re.split(r"\s*\[?\s*(?:\.\.\.|…)\s*\]?\s*", norm(quote).strip(" \"'"))) if p]
    sid = (source or "").strip().strip("[]")
    if not parts or sum(len(p.split()) for p in parts) < 5 or len(parts) > 1 and min(len(p.split()) for p in parts) < 3:
        return "no", sid, "quote too short"

    def held(text):
        at = 0
        for p in parts:
            m = re.compile(rf"(?<![a-z0-9])(?<!\d[.,]){re.escape(p)}(?![a-z0-9])(?![.,]\d)").search(norm(text), at)
            if not m:
                return False
            at = m.end()
        return True

    rows = {i: (t, k, img) for q, i, t, k, img in EVIDENCE if q == "q"}
    if sid in rows and held(rows[sid][0]):
        return "text", sid, ""
    others = [i for i, (t, k, _) in rows.items() if i != sid and k != "figure" and held(t)]
    if len(others) == 1:
        return "text", others[0], f"found under {others[0]}, not {sid or '(no id)'}"
    if sid in rows and rows[sid][2]:
        return None
    return "no", sid, "the quote is not in this piece" if sid in rows else "this id is missing from the evidence"


def test_quotes_part_by_part(spark):
    df = spark.createDataFrame([("q", k, q, s) for k, (q, s) in enumerate(QUOTES.items())], "question string, quote_id int, quote string, source string")
    ev = spark.createDataFrame(EVIDENCE, "question string, id string, text string, kind string, image boolean")
    got = {r["quote_id"]: (r["verified"], r["id"], r["why"]) for r in quotes.verify(df, ev).collect()}
    for k, (q, s) in enumerate(QUOTES.items()):
        if (want := by_search(q, s)) is not None:
            assert got[k] == want, q
    by = {q: got[k] for k, q in enumerate(QUOTES)}
    assert by["read from the picture of the plan"][0] == "image"
    assert by["the temporary traffic control of work zones long"] == ("no", "p1", "the quote is not in this page's words")
    assert by["entirely different phrase that no page prints"][0] == "image"
    assert by["it may be lower in rural areas"][0] == "no"
    assert by["A SIGN ﬁxed to a post should."][1] == "b"


def test_comparable_texts(spark):
    texts = ["“A”—b  c­", "ﬁx ½ ″", None, "", " plain ", "Ünï 日本"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", Q.comparable(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in rows] == [norm(t) for t in texts]
