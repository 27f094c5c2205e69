"""Functions on passages and merges against plain Python."""

import random
import re

from pyspark.sql import functions as F

from veriseam.functions import passages as P
from veriseam.operators import merges


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_stems(spark):
    words = ["sizes", "markings", "cities", "ties", "bus", "buses", "is", "glasses", "signs", "class", "series", "word"]

    def plain(w):
        for end, more in (("ies", "y"), ("es", ""), ("s", "")):
            if w.endswith(end) and len(w) - len(end) >= 4:
                return w[: -len(end)] + more
        return w

    assert column(spark, words, P.stem) == [plain(w) for w in words]


def test_codes_and_their_categories(spark):
    assert column(spark, ["STOP (R1-1) and W3-5aP, OM2-1; FHWA3 XR1-1", None, ""], P.codes) == [["R1-1", "W3-5aP", "OM2-1"], None, []]
    assert column(spark, ["OM2-1", "RM1", "R1", "M4", "EM7", "Q1"], P.category) == ["ObjectMarker", "RoadMarker", "Regulatory", "Marker", "Emergency", "Unknown"]
    assert column(spark, ["R3-1,2,3 signs", "R3-1 sign", "W2-10,11"], P.expand_series) == [["R3-1", "R3-2", "R3-3"], [], ["W2-10", "W2-11"]]


def test_measurements(spark):
    texts = ["W = 12 feet at 55 mph", "a 1,250.5 ft taper, 10 feet", "no number", "S=45, 3 miles per hour", "a 48-inch sign, 3 - METRES, -2 m", "900 veh/h, 12,000 AADT, 30% of, 40 %x, w = 3 ft", "W = 1,200-foot, L=30 percent"]
    assert [[tuple(x) for x in r] for r in column(spark, texts, P.named_values)] == [[("W", 12.0, "ft")], [], [], [("S", 45.0, None)], [], [], [("W", 1200.0, "ft"), ("L", 30.0, "%")]]
    assert [[tuple(x) for x in r] for r in column(spark, texts, P.loose_values)] == [[(55.0, "mph")], [(1250.5, "ft"), (10.0, "ft")], [], [(3.0, "mph")], [(48.0, "in"), (3.0, "m"), (-2.0, "m")], [(900.0, "vph"), (12000.0, "vpd"), (40.0, "%"), (3.0, "ft")], []]


def test_error_kinds(spark):
    messages = ["InvalidParameter: no backend server", "InternalError.InvalidParameter", "Arrearage", "429 Too Many Requests", "x", None]
    assert column(spark, messages, P.error_kind) == ["passing", "request", "account", "passing", "", ""]
    more = ["InternalError", "insufficient_quota", "OUT_OF_SERVICE", "limit_requests", "DataInspectionFailed", "RateLimit exceeded", "AllocationQuota.FreeTierOnly", "InternalError.Algo.InvalidParameter", "ResourceExhausted", "Unpurchased"]
    assert column(spark, more, P.error_kind) == ["passing", "passing", "account", "passing", "request", "passing", "account", "request", "passing", "account"]


def test_longest_spans(spark):
    rnd = random.Random(1)
    spans = [(rnd.randrange(5), a, a + rnd.randint(1, 9)) for a in (rnd.randrange(30) for _ in range(200))]
    got = {tuple(r) for r in merges.longest_spans(spark.createDataFrame(spans, "t int, start int, end int"), by="t").collect()}
    assert got == {s for s in spans if not any(o[0] == s[0] and o[1] <= s[1] and o[2] >= s[2] and o[2] - o[1] > s[2] - s[1] for o in spans)}


def test_bound_values(spark):
    wanted = spark.createDataFrame([(1, "W", "ft"), (1, "S", "mph"), (2, "W", "ft"), (3, "W", "ft")], "k int, var string, unit string")
    named = spark.createDataFrame([(1, "W", 12.0)], "k int, name string, value double")
    loose = spark.createDataFrame([(1, 9.0, "ft"), (1, 55.0, "mph"), (2, 1.0, "ft"), (2, 2.0, "ft")], "k int, value double, unit string")
    got = sorted(tuple(r) for r in merges.bound(wanted, named, loose, key="k").select("k", "var", "value", "how").collect())
    assert got == [(1, "S", 55.0, "unit"), (1, "W", 12.0, "name"), (2, "W", None, "missing"), (3, "W", None, "missing")]


def test_differences_and_unions(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "z"), (4, None, "z")], "k int, f string, g string")
    new = spark.createDataFrame([(1, "a", "y"), (2, "b", None), (5, "c", "z"), (4, "q", "p")], "k int, f string, g string")
    assert sorted(tuple(r) for r in merges.differences(old, new, key="k", fields=["f", "g"]).collect()) == [(1, "changed", "g"), (3, "lost", None), (4, "changed", "f"), (5, "gained", None)]
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q int, d string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "x", 2)], "q int, d string, rank int")
    assert sorted((r["place"], r["d"]) for r in merges.ordered_union([a, b], by="q", item="d").collect()) == [(1, "x"), (2, "y"), (3, "z")]


def test_prose(spark):
    lines = ["one two three four five six", "One Two three Four Five six", "a b c", ""]
    plain = lambda t: len(t.split()) >= 6 and sum(bool(re.match("[a-z]", w)) for w in t.split()) >= 3
    assert column(spark, lines, P.is_prose) == [plain(t) for t in lines]
