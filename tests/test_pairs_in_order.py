"""Pairs of rows that choose in order: one shuffle, nothing written to the checkpoint folder (F1 of round 4)."""

import random

import duckdb
import pytest

from veriseam.operators import pairing
from veriseam.plans import networks

FIELDS = ("part", "supplier", "flag")
ROW = "group int, row int, part int, supplier int, flag string, part_weight double, supplier_weight double, flag_weight double, made_part int, made_supplier int, made_flag string"


def loop(rows, floor):
    """(group, wanted) -> (made, score), row after row."""
    out, used = {}, set()
    for g, i, *x in sorted((r for r in rows if None not in r[:2]), key=lambda r: r[:2]):
        want, weight = x[:3], [w or 0.0 if word is not None else 0.0 for w, word in zip(x[3:6], x[:3], strict=True)]
        best, top = None, 0.0
        for h, j, *y in sorted((r for r in rows if r[0] == g and r[1] is not None), key=lambda r: r[1]):
            shared = sum(w for w, a, b in zip(weight, want, y[6:9], strict=True) if a is not None and a == b)
            score = round(shared / sum(weight), 9) if sum(weight) else 0.0
            if (h, j) not in used and score >= floor and score > top:
                best, top = j, score
        if best is not None:
            used.add((g, best))
            out[g, i] = best, top
    return out


@pytest.mark.parametrize(("at_once", "floor"), [(pairing.ROWS, 0.4), (16, 0.25), (16, 0.0)])
def test_pairs_in_order_are_those_of_the_loop(spark, at_once, floor):
    rnd = random.Random(102)
    word, flag = lambda n: rnd.choice([None, *range(n), *range(n)]), lambda: rnd.choice([None, "A", "N", "N", "R"])
    rows = []
    for g, n in [(None, 9), *((g, rnd.randint(1, 9)) for g in range(40)), (40, pairing.WIDE), (41, 3 * pairing.WIDE)]:
        for i in [None, *rnd.sample(range(1000), n - 1)]:
            p, s, f = word(5), word(4), flag()
            rows.append((g, i, p, s, f, rnd.choice([0.0, 0.5, 1.0]), 1.0, None if f is None else 2.0, word(5), word(4), flag()))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = pairing.in_order(spark.createDataFrame(rows, ROW), wants=[*FIELDS], weights=[f"{f}_weight" for f in FIELDS], has=[f"made_{f}" for f in FIELDS], floor=floor, of_wanted=("flag",), of_made=("made_flag",), at_once=at_once)
        assert df.columns == ["group", "wanted", "made", "score", "flag", "made_flag"]
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    want, flags = loop(rows, floor), {r[:2]: (r[4], r[10]) for r in rows}
    assert len(got) == len(want) and {(r["group"], r["wanted"]): (r["made"], r["score"]) for r in got} == want
    assert all(r["flag"] == flags[r["group"], r["wanted"]][0] and r["made_flag"] == flags[r["group"], r["made"]][1] for r in got)


def test_no_pairs(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, "A", 1.0, 1.0, 1.0, 2, 2, "B"), (None, 1, 1, 1, "A", 1.0, 1.0, 1.0, 1, 1, "A")], ROW)
    of = {"wants": [*FIELDS], "weights": [f"{f}_weight" for f in FIELDS], "has": [f"made_{f}" for f in FIELDS]}
    assert pairing.in_order(df, **of).collect() == [] and pairing.in_order(df.filter("group > 1"), **of).collect() == []


def test_lines_are_shuffled_once_and_nothing_is_kept(spark, monkeypatch):
    """Every round of asking wrote its pairs to the checkpoint folder and shuffled them again."""
    kept, cut = [], pairing.cut_lineage
    monkeypatch.setattr(pairing, "cut_lineage", lambda df: (kept.append(df), cut(df))[1])
    for query in (networks.q101_greedy_pairs, networks.q102_pairing_scores):
        df = query(spark, "/root/testdata/sf0.001")
        assert df.collect() and not kept
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        written = [line for line in plan.splitlines() if " Exchange " in line and "ReusedExchange" not in line and "l_orderkey" in line]
        assert len(written) == 1 and "group" not in "".join(line for line in plan.splitlines() if " Exchange " in line)


def test_odd_lines_are_paired_as_sql_does(spark, tmp_path):
    """A null word was given a weight and so made a score less; an order of many lines is among them."""
    rnd = random.Random(4)
    some = lambda n: rnd.choice([None, *(rnd.randint(-3, n) for _ in range(7))])
    rows = [(rnd.choice([None, *range(30), *([30] * 20)]), rnd.choice([None, *range(1, 100)]), some(60), some(60), rnd.choice([None, "A", "N", "R", ""])) for _ in range(600)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("q101_greedy_pairs", "q102_pairing_scores"):
        got = networks.QUERIES[name](spark, str(tmp_path))
        columns = ", ".join(f'"{c}"' for c in got.columns)
        want = db.sql(f"select {columns} from ({networks.SQL[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
