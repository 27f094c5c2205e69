"""Regions below captions: places that follow, read backwards in buckets."""

import bisect
import random

from pyspark.sql import functions as F

from veriseam.operators import asof
from veriseam.plans import layouts


def test_the_next_place_is_carried_over_buckets(spark):
    rnd = random.Random(26)
    rows = [(rnd.choice([0, 1, 2, 3, None]), i, rnd.choice([None, *(rnd.randint(-90, 400) / 4 for _ in range(9))]), rnd.choice([None, *(rnd.randint(-90, 400) / 4 for _ in range(9))])) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i int, top double, foot double")
    marks = {k: sorted({t for q, _, t, _ in rows if q == k and t is not None}) for k in range(4)}
    want = {i: next(iter(marks[k][bisect.bisect_right(marks[k], f + 1) :]), None) for k, i, _, f in rows if k is not None and f is not None}
    for bucket in (8.0, 4096.0):
        made = asof.followed(df, key="k", mark=F.col("top"), at=F.col("foot") + 1.0, bucket=bucket)
        assert made.columns == [*df.columns, "next"]
        got = made.collect()
        assert len(got) == len(want) and {r["i"]: r["next"] for r in got} == want
        stays = {r["i"] for r in asof.crowded(df, key="k", at="top", within=1.5, bucket=bucket).collect()}
        assert stays >= {i for k, i, t, _ in rows for q, j, u, _ in rows if k is not None and k == q and i != j and None not in (t, u) and abs(t - u) < 1.5}


def test_no_line_is_sorted_for_its_least_string_and_few_are_joined(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = layouts.q105_caption_regions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "min(l_returnflag" not in plan and plan.count("SortMergeJoin") == 2
