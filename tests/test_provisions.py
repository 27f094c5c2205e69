"""List modes, verdicts and comparisons on small cases, against what the rules say."""

from pyspark.sql import functions as F

from veriseam.functions import provisions as V
from veriseam.operators import facts


def test_list_modes(spark):
    rows = [
        ("Except in the following cases, any of", "a or", "b", 3, "EXCEPTION CASES"),
        ("Any of", "a", "b", 2, "ANY"),
        ("It is", "a, OR; ", "b", 2, "ANY"),
        ("It is", "a or", None, 1, "NOT STATED"),
        ("It is", "a", "b and", 2, "ALL"),
        ("All the following", "floor", "a", 2, "ALL"),
        ("All of", "a", None, 1, "NOT STATED"),
        ("Each of", "a and", "a and", 1, "NOT STATED"),
        ("Any of", "a", None, 1, "ANY"),
        ("It is", "floor", "sand", 2, "NOT STATED"),
        (None, None, None, 0, "NOT STATED"),
    ]
    df = spark.createDataFrame(rows, "lead string, first string, last string, n long, want string")
    got = df.select("want", V.list_mode(F.col("lead"), F.col("first"), F.col("last"), F.col("n")).alias("mode")).collect()
    assert all(r["want"] == r["mode"] for r in got)


def test_replies_that_cannot_be_read_are_unknown(spark):
    rows = [
        (0, '{"status": "true", "confidence": 7, "evidence": ["a", "x", " a ", ""]}'),
        (1, '{"status": "certainly", "confidence": -1}'),
        (2, "FALSE"),
        (3, None),
        (4, ""),
        (5, '```json\n{"status": "FALSE", "confidence": "0.5", "evidence": ["b"]}\n```'),
        (6, 'I looked at it. {"status": " unknown ", "evidence": null} That is all.'),
        (7, '{"status": "TRUE"} or {"status": "FALSE"}'),
        (8, '{"status": "NOT_APPLICABLE", "confidence": 1, "evidence": ["a"]}'),
        (9, '{"status": "TRUE", "confidence": "high", "evidence": ["a"]'),
        (10, '{"status": "TRUE", "confidence": "high", "evidence": ["a"]}'),
        (11, "[]"),
    ]
    df = spark.createDataFrame(rows, "id int, reply string")
    got = {r["id"]: tuple(r)[1:] for r in df.select("id", *V.verdict(F.col("reply"), F.array(F.lit("a"), F.lit("b")))).collect()}
    assert got == {0: ("TRUE", 1.0, "a,a", "x"), 5: ("FALSE", 0.5, "b", ""), 10: ("TRUE", 0.0, "a", ""), **{i: ("UNKNOWN", 0.0, "", "") for i in (1, 2, 3, 4, 6, 7, 8, 9, 11)}}


def test_facts_by_name_then_by_the_only_ending(spark):
    known = spark.createDataFrame(
        [(1, "width", 12.0, "in"), (1, "lane.width", 9.0, "ft"), (1, "lane.height", 2.0, "yd"), (1, "a.depth", 1.0, "ft"), (1, "b.depth", 1.0, "ft"), (2, "lane.width", 1.0, "lb"), (None, None, None, None)],
        "case int, name string, value double, unit string",
    )
    asked = spark.createDataFrame(
        [
            (1, 1, "width", "=", 1.0, "ft"),
            (2, 1, "lane.width", ">", 3.0, "yd"),
            (3, 1, "height", ">=", 72.0, "in"),
            (4, 1, "depth", ">", 0.0, "ft"),
            (5, 2, "width", "<", 2.0, "ft"),
            (6, 3, "width", "<", 2.0, "ft"),
            (7, 1, "width", "<", 2.0, "lb"),
            (8, None, None, None, None, None),
        ],
        "id int, case int, name string, op string, bound double, unit string",
    )
    got = {r["id"]: (r["resolved"], r["status"]) for r in facts.compare(asked, known).collect()}
    assert got == {1: (True, "TRUE"), 2: (True, "FALSE"), 3: (True, "TRUE"), 4: (False, "UNKNOWN"), 5: (False, "UNKNOWN"), 6: (False, "UNKNOWN"), 7: (True, "UNKNOWN"), 8: (False, "UNKNOWN")}
    assert facts.compare(asked, known.limit(0)).filter("status <> 'UNKNOWN'").isEmpty()
