"""Operators against plain Python, and the rules that queries don't reach."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from veriseam.functions import logic as L
from veriseam.functions import text as X
from veriseam.operators import bands, graph, metrics, network, rank, runs, verify
from veriseam.sources import tables

STATUSES = (L.TRUE, L.FALSE, L.UNKNOWN, L.NOT_APPLICABLE)


def test_merges_by_their_tables(spark):
    rows = [(i, s) for i, combo in enumerate(product(STATUSES, repeat=3)) for s in combo]
    got = spark.createDataFrame(rows, "g int, s string").groupBy("g").agg(L.conjunction(F.col("s")).alias("c"), L.alternative(F.col("s")).alias("a"), L.threshold(F.col("s"), 2).alias("t")).collect()
    for r in got:
        combo = [s for g, s in rows if g == r["g"]]
        some = [s for s in combo if s != L.NOT_APPLICABLE]
        assert r["c"] == (L.NOT_APPLICABLE if not some else L.FALSE if L.FALSE in some else L.UNKNOWN if L.UNKNOWN in some else L.TRUE)
        assert r["a"] == (L.NOT_APPLICABLE if not some else L.TRUE if L.TRUE in some else L.UNKNOWN if L.UNKNOWN in some else L.FALSE)
        n, u = combo.count(L.TRUE), combo.count(L.UNKNOWN)
        assert r["t"] == (L.TRUE if n >= 2 else L.UNKNOWN if n + u >= 2 else L.FALSE)


def test_guard_tries_all_worlds(spark):
    leaves = (*STATUSES, None)
    rows = list(product(leaves, repeat=3))
    got = spark.createDataFrame(rows, "a string, b string, c string").select("*", L.guard([F.col("a"), F.col("b"), F.col("c")], lambda x: x[0] & (x[1] | ~x[2])).alias("s")).collect()
    for r in got:
        worlds = product(*([v] if (v := {L.TRUE: True, L.FALSE: False, L.NOT_APPLICABLE: False}.get(r[k])) is not None else [True, False] for k in "abc"))
        truths = {a and (b or not c) for a, b, c in worlds}
        want = "OPEN" if truths == {True} else "CLOSED" if truths == {False} else "PENDING" if None in (r["a"], r["b"], r["c"]) else "UNDECIDED"
        assert r["s"] == want
    with pytest.raises(ValueError):
        L.guard([F.lit(None)] * 9, lambda x: x[0])


def evaluate(ops, needs, checks):
    """The statuses of a network by recursion."""
    merge = dict(ops)

    def status(op):
        if merge[op] == "check":
            return checks.get(op, L.UNKNOWN)
        mine = [(status(n), part) for o, n, part in needs if o == op]
        some = [s for s, _ in mine if s != L.NOT_APPLICABLE]
        if merge[op] == "conjunction":
            return L.NOT_APPLICABLE if not some else L.FALSE if L.FALSE in some else L.UNKNOWN if L.UNKNOWN in some else L.TRUE
        if merge[op] == "alternative":
            return L.NOT_APPLICABLE if not some else L.TRUE if L.TRUE in some else L.UNKNOWN if L.UNKNOWN in some else L.FALSE
        base = next(s for s, p in mine if p == "base")
        excepted = [s for s, p in mine if p == "exception"]
        if base in (L.NOT_APPLICABLE, L.TRUE):
            return base
        return L.TRUE if L.TRUE in excepted else L.UNKNOWN if L.UNKNOWN in (base, *excepted) else base

    return {op: status(op) for op in merge}


def test_networks_run_as_their_definition(spark):
    rnd = random.Random(1)
    ops, needs, checks, want = [], [], [], {}
    for net in range(25):
        mine, mine_needs, mine_checks = [], [], {}
        for i in range(rnd.randint(4, 9)):
            kind = "check" if i < 3 else rnd.choice(["conjunction", "alternative", "exception"])
            mine.append((f"o{i}", kind))
            if kind == "check":
                if rnd.random() < 0.8:
                    mine_checks[f"o{i}"] = rnd.choice(STATUSES)
            else:
                used = rnd.sample(range(i), rnd.randint(2, min(3, i)))
                mine_needs += [(f"o{i}", f"o{n}", ("base" if k == 0 else "exception") if kind == "exception" else "input") for k, n in enumerate(used)]
        want |= {(net, o): s for o, s in evaluate(mine, mine_needs, mine_checks).items()}
        ops += [(net, o, k, "Standard") for o, k in mine]
        needs += [(net, *n) for n in mine_needs]
        checks += [(net, o, s) for o, s in mine_checks.items()]
    o = spark.createDataFrame(ops, "net int, op string, merge string, authority string")
    n = spark.createDataFrame(needs, "net int, op string, needs string, part string")
    done = network.execute(o, n, spark.createDataFrame(checks, "net int, op string, status string")).collect()
    assert {(r["net"], r["op"]): r["status"] for r in done} == want
    assert network.problems(o, n).count() == 0


def test_unreachable_ops_stay_unknown(spark):
    ops = spark.createDataFrame([(1, "a", "conjunction", "Support"), (1, "b", "conjunction", "Standard")], "net int, op string, merge string, authority string")
    needs = spark.createDataFrame([(1, "a", "b", "input"), (1, "b", "a", "input"), (1, "b", "gone", "input")], "net int, op string, needs string, part string")
    done = network.execute(ops, needs, spark.createDataFrame([], "net int, op string, status string")).collect()
    assert {(r["op"], r["status"], r["wave"]) for r in done} == {("a", L.UNKNOWN, None), ("b", L.UNKNOWN, None)}
    assert {r["problem"] for r in network.problems(ops, needs).collect()} == {"needs what nothing produces", "merges fewer than two", "Support obliges to nothing"}


def test_take_turns(spark):
    rnd = random.Random(2)
    a, b, want = [], [], {}
    for q in range(12):
        xs, ys = rnd.sample(range(12), rnd.randint(0, 8)), rnd.sample(range(12), rnd.randint(0, 8))
        a += [(q, x, i + 1) for i, x in enumerate(xs)]
        b += [(q, y, i + 1) for i, y in enumerate(ys)]
        taken, left = [], [xs[:], ys[:]]
        for turn in range(6):
            for side in (turn % 2, 1 - turn % 2):
                left[side] = [x for x in left[side] if x not in taken]
                if left[side]:
                    taken.append(left[side].pop(0))
                    break
        want |= {(q, x): i + 1 for i, x in enumerate(taken)}
    ddl = "q int, item int, rank int"
    got = rank.take_turns(spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl), qid="q", item="item", want=6).collect()
    assert {(r["q"], r["item"]): r["rank"] for r in got} == want


def test_fusion_ties_and_empty_side(spark):
    ddl = "q int, item int, rank int"
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], ddl)
    two = spark.createDataFrame([(1, 20, 1), (1, 21, 2)], ddl)
    got = rank.rrf([one, two], qid="q", item="item", k=4).orderBy("rank").collect()
    assert [r["item"] for r in got] == [10, 20, 11, 21] and abs(got[0]["score"] - 1 / 61) < 1e-12
    assert [r["item"] for r in rank.rrf([one, two.limit(0)], qid="q", item="item", k=4).orderBy("rank").collect()] == [10, 11]


def test_bm25_counts_repeated_terms_and_breaks_ties_downwards(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c d"), (4, None)], "d int, t string")
    once = rank.bm25(docs, spark.createDataFrame([(1, "a")], "q int, t string"), did="d", dtext=F.col("t"), qid="q", qtext=F.col("t"), k=5).orderBy("rank").collect()
    twice = rank.bm25(docs, spark.createDataFrame([(1, "a a")], "q int, t string"), did="d", dtext=F.col("t"), qid="q", qtext=F.col("t"), k=5).orderBy("rank").collect()
    assert [r["d"] for r in once] == [2, 1] and abs(twice[0]["score"] - 2 * once[0]["score"]) < 1e-9


def test_closure_shares_its_budget(spark):
    edges = spark.createDataFrame([("s", "x", f"x{i}") for i in range(9)] + [("s", "y", f"y{i}") for i in range(2)] + [("y0", "y", "deep")], "src string, label string, dst string")
    starts = spark.createDataFrame([("s", "s")], "start string, node string")
    got = graph.closure(edges, starts, by="start", reach={"x": 1, "y": 2}, budget=6).collect()
    assert {r["node"] for r in got} == {"s", "x0", "x1", "x2", "x3", "y0", "y1"}
    wide = graph.closure(edges, starts, by="start", reach={"x": 1, "y": 2}, budget=50).collect()
    assert len(wide) == 13 and {r["depth"] for r in wide if r["node"] == "deep"} == {2}


def test_levels_refuse_cycles(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node int")
    with pytest.raises(ValueError):
        graph.levels(nodes, spark.createDataFrame([(1, 0), (2, 1), (1, 2), (3, 2)], "node int, needs int"), limit=8)


def test_bands_hold_what_they_print(spark):
    table = spark.createDataFrame([(1, 5.0, None, None, False, False, "n"), (2, None, 1.0, 3.0, True, False, "b"), (3, None, None, None, True, True, "none")], "row int, number double, lo double, hi double, lo_inc boolean, hi_inc boolean, label string")
    got = bands.band_lookup(spark.createDataFrame([(k, float(k)) for k in range(7)], "k int, v double"), table, key="k", value="v").collect()
    assert {r["k"]: r["label"] for r in got} == {0: None, 1: "b", 2: "b", 3: None, 4: None, 5: "n", 6: None}


def test_composites_give_the_published_scores(spark):
    one = spark.range(1)
    lit = lambda **k: {a: F.lit(b) for a, b in k.items()}
    r = metrics.composites(**lit(recall=0.866667, mrr=0.825556, ndcg=0.812573, precision=0.475556, routing=0.78, sufficiency=0.933333))
    g = metrics.generation_score(**lit(correctness=0.919667, completeness=0.901867, faithfulness=0.984, citation=0.945, visual=0.909444, unanswerable=0.696))
    s = metrics.reliability_score(**lit(success=0.966667, brier=0.169345, ece=0.1296))
    row = one.select(r.alias("r"), g.alias("g"), s.alias("s")).first()
    assert abs(row["r"] - 19.3464) < 1e-3 and abs(row["g"] - 55.1834) < 1e-3 and abs(row["s"] - 10.9032) < 1e-3


def test_upper_median_and_row_numbers(spark):
    rows = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "k int, v int")
    assert rows.filter("k < 4").agg(metrics.upper_median(F.col("k")).alias("m")).first()["m"] == 2
    assert all(r["pos"] == r["k"] for r in metrics.number_rows(rows, ["k"]).collect())


def test_text_functions(spark):
    row = spark.createDataFrame([("See 3, 5 through 7 and 12. It shall hold! “Yes” — no", " a–b \n c ")], "t string, d string").select(X.number_list(F.col("t")).alias("n"), X.authority(F.col("t")).alias("a"), X.squeeze(F.col("d")).alias("q"), X.sentences(F.col("t")).alias("s"), X.id63(F.lit("chunk")).alias("i")).first()
    assert row["n"] == [3, 5, 6, 7, 12] and row["a"] == "Standard" and row["q"] == "a-b c" and len(row["s"]) == 3
    import hashlib

    assert row["i"] == int.from_bytes(hashlib.sha1(b"chunk").digest()[:8], "big") >> 1


def test_similar_sets_and_citations(spark):
    rows = spark.createDataFrame([("s", 1, list("abcde")), ("s", 2, list("abcdf")), ("s", 3, list("abcdeg")), ("t", 4, list("abcde")), ("s", 5, list("edcba")), ("s", 6, [])], "by string, id int, ws array<string>")
    got = {(r["doc_a"], r["doc_b"]) for r in verify.similar_sets(rows, by="by", key="id", words="ws", least=0.8).collect()}
    assert got == {(1, 3)}
    cites = spark.createDataFrame([("A", "x", "1"), ("A", "y", "1"), ("A", "x", "?")], "s string, t string, o string")
    assert [r["known"] for r in verify.cited(cites, spark.createDataFrame([("A", "x", "1")], "s string, t string, o string"), on=["s", "t", "o"]).orderBy("t").collect()] == [True, False]


def test_sources(spark, tmp_path):
    from pyspark.sql import types as T

    path = tmp_path / "log.jsonl"
    path.write_text('{"id": 1, "a": "x"}\n\n{"id": 2, "other": 5}\n{"id": 3, "a"')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("a", T.StringType())])
    rows = tables.read_jsonl(spark, str(path), schema).cache()
    assert rows.filter("_corrupt is not null").count() == 1
    assert {r["id"]: r["a"] for r in tables.tolerant(rows).collect()} == {1: "x", 2: None}
    q = spark.createDataFrame([(1, "a"), (2, "b")], "question_id int, question string")
    assert tables.check_questions(q, id_col="question_id", gold=["sections"], expected=2) is q
    for bad in (dict(gold=["question"]), dict(gold=[], expected=3)):
        with pytest.raises(ValueError):
            tables.check_questions(q, id_col="question_id", **bad)
    old, new = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, n int, v string"), spark.createDataFrame([(2, 1, "c"), (2, 2, "d")], "k int, n int, v string")
    assert {r["k"]: r["v"] for r in tables.upsert(old, new, key="k", order="n").collect()} == {1: "a", 2: "d"}
    assert [r["k"] for r in tables.fetch(old, spark.createDataFrame([(2, 0), (9, 1), (1, 2), (2, 3)], "k int, pos int"), id_col="k").collect()] == [2, 1]
    cached = old.select("k", F.sha2("v", 256).alias("fingerprint"))
    assert tables.stale(old.withColumn("v", F.when(F.col("k") == 1, "new").otherwise(F.col("v"))), cached, key="k", text=F.col("v")).count() == 1
    for form in ("parquet", "csv", "json", "orc"):
        tables.write_rows(old, str(tmp_path / form), form=form)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2


def test_run_merge_prefers_valid_primary(spark):
    ddl = "k int, ok boolean, v int"
    got = runs.merge_runs(spark.createDataFrame([(1, True, 1), (2, False, 2), (3, False, 3)], ddl), spark.createDataFrame([(1, True, 10), (2, True, 20), (4, True, 40)], ddl), key="k", valid="ok", value="v").collect()
    assert {r["k"]: (r["v"], r["source"]) for r in got} == {1: (1, "primary"), 2: (20, "retry"), 3: (3, "primary"), 4: (40, "retry")}


def test_contains_wherever_an_item_stands(spark):
    docs = spark.createDataFrame([(1, "ab cd"), (2, "lone word here"), (3, "wordy"), (4, None), (5, ""), (6, "x ab cd y ab cd")], "d int, t string")
    items = spark.createDataFrame([("i", "b c"), ("j", "word"), ("k", ""), ("l", None), ("m", "word"), ("n", "."), ("o", "lone word here")], "q string, t string")
    got = metrics.contains_qrels(docs, items, did="d", dtext=F.col("t"), qid="q", qtext=F.col("t")).collect()
    assert sorted(tuple(r) for r in got) == [("i", 1), ("i", 6), ("j", 2), ("j", 3), ("m", 2), ("m", 3), ("o", 2)]
    assert metrics.contains_qrels(docs, items.limit(0), did="d", dtext=F.col("t"), qid="q", qtext=F.col("t")).count() == 0


def test_bm25_in_blocks(spark, monkeypatch):
    import random

    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choices(["the", "a-b", "x.1", "Word", "rare", "other"], [9, 3, 2, 2, 1, 1], k=n))
    docs = spark.createDataFrame([(i, text(rnd.randint(0, 9))) for i in range(600)] + [(1000, None)], "d long, t string").repartition(3)
    items = spark.createDataFrame([(str(i), text(3)) for i in range(9)] + [("none", ""), ("null", None)], "q string, t string")
    run = lambda: sorted((r["q"], r["rank"], r["d"], round(r["score"], 9)) for r in rank.bm25(docs, items, did="d", dtext=F.col("t"), qid="q", qtext=F.col("t"), k=7).collect())
    whole = run()
    assert {q for q, *_ in whole} == {str(i) for i in range(9)} and all(r <= 7 for _, r, *_ in whole)
    monkeypatch.setattr(rank, "QUERY_BLOCK", 2)
    assert run() == whole
