"""Possible outcomes against all combinations, greedy pairs against a loop."""

import random
from itertools import product

from pyspark.sql import functions as F

from veriseam.functions import logic as L
from veriseam.operators import lattice, network, pairing

STATUSES = ["TRUE", "FALSE", "UNKNOWN", "NOT_APPLICABLE"]


def fold(order, got):
    got = [s for s in got if s != "NOT_APPLICABLE"]
    return next((s for s in order if s in got), "NOT_APPLICABLE")


def merge(kind, inputs):
    """inputs: [(part, status)]"""
    if kind == "conjunction":
        return fold(["FALSE", "UNKNOWN", "TRUE"], [s for _, s in inputs])
    if kind == "alternative":
        return fold(["TRUE", "UNKNOWN", "FALSE"], [s for _, s in inputs])
    base = next(s for p, s in inputs if p == "base")
    if base in ("TRUE", "NOT_APPLICABLE"):
        return base
    other = fold(["TRUE", "UNKNOWN", "FALSE"], [s for p, s in inputs if p == "exception"])
    return "TRUE" if other == "TRUE" else "UNKNOWN" if "UNKNOWN" in (base, other) else base


def possible(ops, requires, checks, op, seen=()):
    """The set of an op by recursion and all combinations of its inputs."""
    if op in seen or op not in ops:
        return None
    needs = [(p, w, possible(ops, requires, checks, n, (*seen, op))) for o, n, p, w in requires if o == op]
    if any(s is None for _, _, s in needs):
        return None
    out = set()
    own = checks.get(op, {"UNKNOWN"}) if ops[op] == "check" else {None}
    for combo in product(own, *(sorted(s) for _, _, s in needs)):
        mine, got = combo[0], combo[1:]
        rows = [(p, w, s) for (p, w, _), s in zip(needs, got, strict=True)]
        if not all(s in ("TRUE", "FALSE") if w == "RESOLVED" else s == (w or "TRUE") for p, w, s in rows if p == "guard"):
            out.add("NOT_APPLICABLE")
            continue
        inputs = [(p, s) for p, _, s in rows if p != "guard"]
        if ops[op] != "check":
            out.add(merge(ops[op], inputs))
        elif inputs and all(s == "NOT_APPLICABLE" for _, s in inputs):
            out.add("NOT_APPLICABLE")
        else:
            out.add("UNKNOWN" if any(s == "UNKNOWN" for _, s in inputs) else mine)
    return out


def networks(rnd, n, single=False):
    ops, requires, checks = [], [], []
    for net in range(n):
        names = []
        for k in range(rnd.randint(3, 5)):
            names.append(f"c{k}")
            ops.append((net, f"c{k}", "check"))
            some = [rnd.choice(STATUSES)] if single else rnd.sample(STATUSES, rnd.randint(1, 3))
            if rnd.random() < 0.95:
                checks.append((net, f"c{k}", some))
            if k and not single and rnd.random() < 0.3:
                requires.append((net, f"c{k}", rnd.choice(names[:-1]), "input", None))
        for k in range(rnd.randint(1, 4)):
            kind = rnd.choice(["conjunction", "alternative", "exception"])
            inputs = rnd.sample(names, rnd.randint(2, 3))
            ops.append((net, f"m{k}", kind))
            for i, x in enumerate(inputs):
                requires.append((net, f"m{k}", x, ("base" if i == 0 else "exception") if kind == "exception" else "input", None))
            if not single and rnd.random() < 0.3:
                requires.append((net, f"m{k}", rnd.choice(names), "guard", rnd.choice([None, "FALSE", "RESOLVED", "NOT_APPLICABLE"])))
            names.append(f"m{k}")
        if rnd.random() < 0.2:
            ops += [(net, "x", "conjunction"), (net, "y", "alternative"), (net, "z", "conjunction")]
            requires += [(net, "x", "y", "input", None), (net, "y", "x", "input", None), (net, "x", "c0", "input", None), (net, "z", "nowhere", "input", None)]
    return ops, requires, checks


def frames(spark, ops, requires, checks):
    return (
        spark.createDataFrame(ops, "net int, op string, merge string"),
        spark.createDataFrame(requires, "net int, op string, needs string, part string, want string"),
        spark.createDataFrame(checks, "net int, op string, possible array<string>"),
    )


def test_outcomes_are_those_of_all_combinations(spark):
    ops, requires, checks = networks(random.Random(7), 60)
    got = {(r["net"], r["op"]): set(r["s"]) for r in lattice.outcomes(*frames(spark, ops, requires, checks)).select("net", "op", lattice.statuses(F.col("mask")).alias("s")).collect()}
    assert len(got) == len(ops)
    for net in {o[0] for o in ops}:
        of, needs, own = {o: m for n, o, m in ops if n == net}, [r[1:] for r in requires if r[0] == net], {o: set(s) for n, o, s in checks if n == net}
        for op in of:
            assert got[net, op] == (possible(of, needs, own, op) or {"UNKNOWN"}), (net, op)


def test_single_outcomes_are_the_executor_s(spark):
    ops, requires, checks = networks(random.Random(8), 60, single=True)
    o, r, c = frames(spark, ops, requires, checks)
    by_wave = {(x["net"], x["op"]): (x["status"], x["wave"]) for x in network.execute(o, r, c.select("net", "op", F.col("possible")[0].alias("status"))).collect()}
    by_set = {(x["net"], x["op"]): (x["s"], x["wave"]) for x in lattice.outcomes(o, r, c).select("net", "op", lattice.settled(F.col("mask")).alias("s"), "wave").collect()}
    assert by_wave == by_set


def test_masks(spark):
    df = spark.createDataFrame([(["TRUE", "UNKNOWN"],), (["FALSE"],), ([],)], "p array<string>").withColumn("m", lattice.mask(F.col("p")))
    rows = df.select("m", lattice.statuses(F.col("m")), lattice.settled(F.col("m"))).collect()
    assert [tuple(r) for r in rows] == [(5, ["TRUE", "UNKNOWN"], L.UNKNOWN), (2, ["FALSE"], L.FALSE), (0, [], L.UNKNOWN)]


def test_pairs_are_those_of_the_loop(spark):
    rnd = random.Random(9)
    vocabulary = [f"w{k}" for k in range(12)]
    weight = {w: rnd.choice([0.5, 1.0, 2.0, 3.0]) for w in vocabulary[:9]}
    wanted = [(g, i, rnd.sample(vocabulary, rnd.randint(0, 5)), rnd.choice("AB")) for g in range(25) for i in range(rnd.randint(0, 7))]
    made = [(g, j, rnd.sample(vocabulary, rnd.randint(0, 5)), rnd.choice("AB")) for g in range(25) for j in range(rnd.randint(0, 7))]
    want = {}
    for g in range(25):
        used = set()
        for _, i, words, _ in (x for x in wanted if x[0] == g):
            best, top = None, 0.0
            for _, j, others, _ in (x for x in made if x[0] == g):
                whole = sum(weight.get(w, 1.0) for w in words)
                s = round(sum(weight.get(w, 1.0) for w in set(words) & set(others)) / whole, 9) if whole else 0.0
                if j not in used and s > top:
                    best, top = j, s
            if best is not None and top >= 0.25:
                used.add(best)
                want[g, i] = best
    w = spark.createDataFrame(wanted, "group int, wanted int, words array<string>, authority string")
    m = spark.createDataFrame(made, "group int, made int, words array<string>, authority string")
    pairs = pairing.greedy(pairing.scored(w, m, spark.createDataFrame(list(weight.items()), "word string, weight double")))
    assert {(r["group"], r["wanted"]): r["made"] for r in pairs.collect()} == want
    row = pairing.agreement(w, m, pairs).collect()[0]
    by_id = {(g, i): a for g, i, _, a in made}
    same = sum(a == by_id[g, want[g, i]] for g, i, _, a in wanted if (g, i) in want)
    assert tuple(row) == (len(want), len(made) - len(want), len(wanted) - len(want), same)


def test_a_chain_of_refusals(spark):
    """Each row loses its best to the one before."""
    pairs = [(0, i, j, 1.0 - 0.01 * j) for i in range(8) for j in range(8)]
    got = pairing.greedy(spark.createDataFrame(pairs, "group int, wanted int, made int, score double")).collect()
    assert {r["wanted"]: r["made"] for r in got} == {i: i for i in range(8)}
