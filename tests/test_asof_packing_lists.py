"""As-of joins, call packing and lists against plain loops."""

import bisect
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from veriseam.functions import lists
from veriseam.operators import asof, packing


def test_counts_are_carried_over_buckets(spark):
    rnd = random.Random(2)
    marks = [(k, rnd.randint(-90, 300) / 4) for k in range(4) for _ in range(40 * k)]
    asks = [(k, i, rnd.randint(-100, 310) / 4, rnd.random() < 0.5) for k in range(5) for i in range(30)]
    made = asof.counted(spark.createDataFrame(marks, "key int, at double"), spark.createDataFrame(asks, "key int, i int, at double, own boolean"), key="key", bucket=8.0)
    places = {k: sorted({p for q, p in marks if q == k}) for k in range(5)}
    assert {(r["key"], r["i"]): r["n"] for r in made.collect()} == {(k, i): (bisect.bisect_right if own else bisect.bisect_left)(places[k], at) for k, i, at, own in asks}


def test_spans_by_bisection(spark):
    rnd = random.Random(3)
    marks = [(k, float(p), f"c{rnd.randint(0, 9)}") for k in range(6) for p in sorted(rnd.sample(range(200), rnd.choice([0, 1, 5, 30])))]
    units = []
    for k in range(7):
        for i in range(12):
            low = rnd.choice([None, rnd.randint(-5, 210)])
            units.append((k, i, low, None if low is None else low + rnd.randint(0, 60), [f"c{rnd.randint(0, 12)}" for _ in range(rnd.randint(0, 4))]))
    made = asof.resolve_spans(spark.createDataFrame(units, "doc int, span int, low double, high double, explicit array<string>".replace("low double, high double", "low int, high int")), spark.createDataFrame(marks, "doc int, at double, chunk string"), key="doc")
    got = {(r["doc"], r["span"]): (r["chunks"], r["how"]) for r in made.collect()}
    want = {}
    for k, i, low, high, explicit in units:
        own = [(p, c) for d, p, c in marks if d == k]
        if low is None:
            want[k, i] = (list(dict.fromkeys(c for c in explicit if c in {x for _, x in own})), "explicit")
        else:
            first = max(0, bisect.bisect_right([p for p, _ in own], low) - 1)
            want[k, i] = (list(dict.fromkeys(c for p, c in own[first:] if p < high)), "span")
    assert got == want
    assert "NestedLoop" not in made._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in made._jdf.queryExecution().executedPlan().toString()


def test_owners_by_the_nearest_caption(spark):
    rnd = random.Random(4)
    captions = [(p, f"f{k}", float(rnd.choice([10, 50, 50, 90, 130, 133]) + rnd.choice([0, 0, 1]))) for p in range(8) for k in range(rnd.randint(0, 4))]
    items = [(p, i, rnd.uniform(0, 160)) for p in range(9) for i in range(15)]
    made = asof.owners(spark.createDataFrame(items, "page int, item int, at double"), spark.createDataFrame(captions, "page int, caption string, at double"), key="page", pad=5.0)
    want = set()
    for p, i, y in items:
        for q, own, at in captions:
            if p == q:
                above = [o for r, c, o in captions if r == p and c != own and o <= y]
                if not (above and max(above) > at) and y >= at - 5.0:
                    want.add((p, i, own))
    assert {tuple(r) for r in made.collect()} == want


def test_regions_of_captions(spark):
    rnd = random.Random(5)
    rows = []
    for page in range(30):
        for k in range(rnd.randint(1, 5)):
            top = rnd.choice([60.0, 62.0, 64.0, 200.0, 330.0, 331.0, 690.0])
            rows.append((page, f"c{k}", top, top + rnd.choice([10.0, 22.0]), rnd.choice([40.0, 220.0, 400.0]), rnd.random() < 0.2))
            if rnd.random() < 0.2:
                rows.append((page, f"c{k}", top + 40, top + 52, 40.0, True))
    got = {tuple(r)[:2]: tuple(r)[2:] for r in asof.regions(spark.createDataFrame(rows, "page int, caption string, top double, foot double, left double, inset boolean"), key="page", width=612.0, height=792.0).collect()}
    want = {}
    for page in range(30):
        best = {}
        for _, c, top, foot, left, inset in sorted((r for r in rows if r[0] == page), key=lambda r: (r[5], r[2])):
            best.setdefault(c, (top, foot, left, inset))
        for c, (top, foot, left, inset) in best.items():
            later = [t for t, *_ in best.values() if t > foot + 1.0]
            y0, y1 = foot + 2.0, min([792.0 - 40.0, *(t - 4.0 for t in later)])
            x0, x1 = max(36.0, left - 10.0) if inset else 36.0, 612.0 - 36.0
            row = [b for o, b in best.items() if o != c and abs(b[0] - top) < 6.0]
            if rights := [b[2] for b in row if b[2] > left]:
                x1 = min(x1, min(rights) - 8.0)
            if any(b[2] < left for b in row):
                x0 = max(x0, left - 10.0)
            if y1 - y0 >= 40.0 and x1 - x0 >= 80.0:
                want[page, c] = (x0, y0, x1, y1)
    assert got == want


def calls_by_loop(items, cap):
    order, by = [], {}
    seen = set()
    for _, item, section, decided, place in sorted(items):
        if item not in seen:
            seen.add(item)
            if section not in by:
                order.append(section)
            by.setdefault(section, []).append((item, decided, place))
    calls, now, waiting = [], [], []
    size = lambda call: sum(len(d) for _, d in call)
    for s in order:
        decide = [i for i, d, p in sorted(by[s], key=lambda x: (x[2], x[0])) if d]
        if not decide:
            (now if size(now) else waiting).append((s, []))
        elif len(decide) > cap:
            if size(now):
                calls.append(now)
            now = []
            step = math.ceil(len(decide) / math.ceil(len(decide) / cap))
            parts = [[(s, decide[k : k + step])] for k in range(0, len(decide), step)]
            parts[0] = waiting + parts[0]
            waiting = []
            calls += parts
        else:
            if size(now) and size(now) + len(decide) > cap:
                calls.append(now)
                now = []
            if not size(now):
                now, waiting = waiting, []
            now.append((s, decide))
    if size(now):
        calls.append(now)
    if waiting and calls:
        calls[-1] = calls[-1] + waiting
    return {(k, s, i, i in d) for k, call in enumerate(calls) for s, d in call for i, _, _ in by[s]}


def test_calls_are_those_of_the_loop(spark):
    rnd = random.Random(6)
    rows, want = [], set()
    for q in range(40):
        items, n = [], rnd.randint(1, 12)
        for s in range(n):
            for _ in range(rnd.choice([1, 2, 3, 5, 9, 14])):
                items.append((len(items), f"i{rnd.randint(0, 60)}", f"s{s}", rnd.random() < rnd.choice([0.0, 0.5, 0.9]), rnd.randint(0, 9)))
        first = {}
        for r in items:
            first.setdefault(r[1], r)
        rnd.shuffle(items)
        rows += [(q, *r) for r in items]
        want |= {(q, *x) for x in calls_by_loop(list(first.values()), 4)}
    made = packing.plan_calls(spark.createDataFrame(rows, "question int, rank int, item string, section string, decided boolean, place int"), cap=4)
    assert {tuple(r) for r in made.collect()} == want


LISTS = [
    ["Lead:", "A. one", "more", "B. two", "C. three"],
    ["1. one", "2.", "two", "4. nested", "3. three"],
    ["A. one", "1. nested", "2. nested", "B. two"],
    ["B. no", "C. list"],
    ["A. only"],
    ["1. a", "1. b", "2. c", "A. d"],
    ["Z. x"],
    [],
    ["01. a", "1. b", "02. c", "2. d", "1000. e", "A.x", "3.  "],
    [f"{k}. item" for k in range(1, 120)],
    [f"{chr(65 + k)}. item" for k in range(26)] + ["[. no"],
]


def by_loop(lines):
    starts, expected = [], None
    for i, t in enumerate(lines):
        m = re.match(lists.ITEM, t)
        if m and ((expected is None and m[1] in ("A", "1")) or m[1] == expected):
            starts.append((m[1], i))
            expected = chr(ord(m[1]) + 1) if m[1].isalpha() else str(int(m[1]) + 1)
    ends = [i for _, i in starts[1:]] + [len(lines)]
    return [(m, i, e) for (m, i), e in zip(starts, ends, strict=True)] if len(starts) > 1 else []


def test_lists_by_the_loop(spark):
    df = spark.createDataFrame(list(enumerate(LISTS)), "k int, lines array<string>").select("k", lists.list_items(F.col("lines")).alias("x"))
    got = {r["k"]: [tuple(x) for x in r["x"]] for r in df.collect()}
    assert got == {k: by_loop(x) for k, x in enumerate(LISTS)}


@pytest.mark.parametrize("n", [0, 1])
def test_nothing_to_pack(spark, n):
    rows = [(1, 1, "i", "s", False, 1)][:n]
    assert packing.plan_calls(spark.createDataFrame(rows, "question int, rank int, item string, section string, decided boolean, place int")).collect() == []
