"""Rules in words against a recursive reading of them, and comparisons that claims state."""

import re

from veriseam.functions import rules as R
from veriseam.operators import rules

FACTS = [("a", "major_street_speed", 45.0, "mph"), ("a", "Lane width", 10.0, "ft"), ("a", "population", 8000.0, None), ("b", "speed", 30.0, "mph"), ("b", "left_width", 9.0, "ft"), ("b", "right_width", 12.0, "ft"), ("b", "radius", 100.0, "m"), ("c", "spacing", 2.0, "ft")]
TEXTS = [
    "the major-street speed exceeds 40 mph",
    "major-street speed exceeds 45 mph.",
    "speed limits of 25 mph or less",
    "a speed of 45 mph or higher",
    "Community less than 10,000 population or above 40 mph on major street",
    "a posted, statutory, or 85th-percentile speed of 45 mph or higher",
    "may be used on low-volume roadways or roadways with speeds of 25 mph or less",
    "30 mph or less, so a Turn sign should be used where speed is posted",
    "not speed exceeds 40 mph",
    "It is not the case that width under 9 feet and speed at least 30 mph",
    "speed at least 30 mph and not width over 11 ft",
    "not speed over 50 mph or not population at most 9,000",
    "speed over 20, or so and radius above 10 or distance below 5",
    "For word legend and fine symbol signs measuring less than 48 inches",
    "spacing >= 24 in",
    "spacing < 24 inches",
    "Lane_Width != 10 ft",
    "major_street_speed == 45",
    "radius is 100 feet",
    "Typical conditions are locations where the road is wet",
    "width exceeds , feet",
    "",
    "   ",
    "not",
    None,
    "speed no more than 45 mph and population a minimum of 8,000.",
    "speed of 45 mph or above 40 mph",
    "pixel spacing over 3 or 4 mm",
]


def read(text):
    """The tree of a rule by recursion."""
    text = (text or "").strip()
    if not text:
        return ("?",)
    body = re.sub(r"^\s*(it is not the case that|not)\s+", "", text, flags=re.I)
    if body != text:
        return ("not", whole(body))
    return whole(text)


def whole(text):
    masked = re.sub(R.OR_SUFFIX, lambda m: f"\0{m[1]}", text)
    parts = [p.strip().replace("\0", " or ") for p in re.split(r"(?i)\s+or\s+", masked) if p.strip()]
    if not re.search(R.LISTED_OR, text) and len(parts) > 1 and any(re.search(r"\d", p) for p in parts):
        return ("or", *map(read, parts))
    parts = [p.strip() for p in re.split(r"(?i)\s+and\s+", text) if p.strip()]
    if len(parts) > 1 and all(re.search(r"\d", p) for p in parts):
        return ("and", *map(read, parts))
    return leaf(text)


def leaf(text):
    clause = text.strip().rstrip(".")
    number = lambda s: float(s.replace(",", "")) if s.replace(",", "") else None
    unit = lambda s: R.CANON.get((s or "").lower())
    if m := re.match(R.EXPLICIT, clause):
        return ("=", re.sub("[^a-z0-9]+", "_", m[1].lower()).strip("_"), m[2], number(m[3]), unit(m[4]))
    for pattern, op, side in R.COMPARED:
        m = re.search(pattern, clause, re.I)
        if not m:
            continue
        before, after = clause[: m.start()], clause[m.end() :]
        for window, ahead in ((before, False), (after, True)) if side == "before" else ((after, True), (before, False)):
            hits = []
            for k, (name, rx) in enumerate(R.QUANTITIES):
                every = list(re.finditer(rx, window, re.I))
                if every:
                    hits.append((every[-1].start() if ahead else len(window) - every[-1].end(), k, name))
            if hits:
                bound = number(m[1])
                return ("?",) if bound is None else ("=", min(hits)[2], op, bound, unit(m[2]))
    return ("?",)


def decide(tree, case):
    if tree[0] == "?":
        return "UNKNOWN"
    if tree[0] == "not":
        return {"TRUE": "FALSE", "FALSE": "TRUE", "UNKNOWN": "UNKNOWN"}[decide(tree[1], case)]
    if tree[0] in ("or", "and"):
        got = {decide(t, case) for t in tree[1:]}
        first, last = ("TRUE", "FALSE") if tree[0] == "or" else ("FALSE", "TRUE")
        return first if first in got else "UNKNOWN" if "UNKNOWN" in got else last
    _, subject, op, bound, unit = tree
    facts = {re.sub("[^a-z0-9]+", "_", n.lower()): (v, u) for c, n, v, u in FACTS if c == case}
    near = [subject] if subject in facts else [k for k in facts if k.endswith("_" + subject) or subject.endswith("_" + k)]
    if len(near) != 1:
        return "UNKNOWN"
    value, has = facts[near[0]]
    if unit and has and unit != has:
        if (has, unit) not in R.CONVERTED:
            return "UNKNOWN"
        value *= R.CONVERTED[has, unit]
    return "TRUE" if {">": value > bound, ">=": value >= bound, "<": value < bound, "<=": value <= bound, "==": value == bound, "!=": value != bound}[op] else "FALSE"


def test_rules_by_recursion(spark):
    rows = [(f"{i}{c}", c, t) for i, t in enumerate(TEXTS) for c in "abc"]
    made = rules.evaluate(spark.createDataFrame(rows, "id string, case string, text string"), spark.createDataFrame(FACTS, "case string, name string, value double, unit string"))
    got = {r["id"]: r["status"] for r in made.collect()}
    want = {i: decide(read(t), c) for i, c, t in rows}
    assert got == want
    assert {"TRUE", "FALSE", "UNKNOWN"} == set(want.values())


def test_clauses_of_rules(spark):
    rows = {r["id"]: r for r in rules.parse(spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")).collect() if r["i"] == r["j"] == 0}
    assert (rows[0]["subject"], rows[0]["op"], rows[0]["bound"], rows[0]["unit"]) == ("major_street_speed", ">", 40.0, "mph")
    assert (rows[2]["kind"], rows[2]["op"]) == ("clause", "<=")
    assert rows[4]["kind"] == "or" and rows[4]["subject"] == "population" and rows[4]["bound"] == 10_000
    assert rows[5]["kind"] == "clause" and rows[5]["subject"] == "speed"
    assert rows[12]["kind"] == "and"
    assert rows[19]["subject"] is None and rows[24]["subject"] is None


STATED = [
    ("The panel flow of 1,250 units per hour is 1,000 units per hour or more.", "TRUE"),
    ("The 30-foot clear zone is 30 feet or more.", "TRUE"),
    ("A 30-foot zone is more than 12 yards wide", "FALSE"),
    ("The 30 second phase is at least 1 minute", "FALSE"),
    ("The 12 lanes are fewer than 3 lane", "FALSE"),
    ("The 30 feet are no less than 360 inches", "TRUE"),
    ("The 30 feet zone is not at least 20 feet", None),
    ("The 30 feet zone is 3 times the width or more", None),
    ("The 30 feet zone is at least 3 times the width", None),
    ("The 30 feet zone and the 40 feet arm are at least 20 feet", None),
    ("The 30 feet zone is at least 20 miles per hour", "FALSE"),
    ("The 30 feet zone is at least 20 seconds", None),
    ("The 30 feet zone is at least 1/2 feet", None),
    ("The 77 feet zone is at least 20 feet", None),
    ("Sign R1-1 of 30 inches is at most 36 inches", "TRUE"),
    ("The 30 is at least 20", None),
    ("The 30 feet zone is at least 20 feet and at most 40 feet", None),
    ("", None),
    (None, None),
]


def test_stated_comparisons(spark):
    given = [("q1", "a flow of 1,250 units, 30 feet, 12 lanes"), ("q2", None)]
    df = spark.createDataFrame([(k, claim, given) for k, (claim, _) in enumerate(STATED)], "k int, claim string, given array<struct<id:string,text:string>>")
    rows = {r["k"]: r for r in R.stated_comparison(df).collect()}
    assert [(STATED[k][0], rows[k]["status"]) for k in range(len(STATED))] == STATED
    assert all((r["confirmed_by"] == ["q1"]) == (r["status"] is not None) for r in rows.values())
    assert rows[1]["phrase"] == "30 feet or more" and rows[0]["bound"] == 1000
