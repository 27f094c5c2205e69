"""Sections packed into calls: next fit, in order, as a fold over the sections of each question.

A call decides up to ``cap`` pieces. A section goes whole into the call at hand, or into the next where it doesn't fit;
one of more than ``cap`` pieces is split into calls of near-equal parts of its own, each of which shows all of it. A
section with nothing to decide goes along with the call it falls in, else with the next, else with the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _fold(sections: Column, cap: int) -> Column:
    """array<struct<section, first, parts, size>>: the calls (from 0) of each section; one that falls nowhere is left out."""
    given = "array<struct<section:string,first:int,parts:int,size:int>>"
    make = lambda s, first, parts=F.lit(1), size=F.lit(cap): F.struct(s.alias("section"), first.cast("int").alias("first"), parts.cast("int").alias("parts"), size.cast("int").alias("size"))
    keep = lambda a, **new: F.struct(*(new.get(k, a[k]).alias(k) for k in ("closed", "filled", "waiting", "out")))
    wait = lambda a, call: F.transform(a["waiting"], lambda s: make(s, call))
    none = F.expr("cast(array() as array<string>)")

    def step(a: Column, s: Column) -> Column:
        n, shut = s["n"], a["closed"] + F.when(a["filled"] > 0, 1).otherwise(0)
        size = F.ceil(n / F.ceil(n / cap))
        parts = F.ceil(n / size)
        split = keep(a, closed=(shut + parts).cast("int"), filled=F.lit(0), waiting=none, out=F.concat(a["out"], wait(a, shut), F.array(make(s["section"], shut, parts, size))))
        full = (a["filled"] > 0) & (a["filled"] + n > cap)
        call = F.when(full, shut).otherwise(a["closed"])
        empty = full | (a["filled"] == 0)
        whole = keep(a, closed=call, filled=F.when(empty, n).otherwise(a["filled"] + n), waiting=F.when(empty, none).otherwise(a["waiting"]), out=F.concat(a["out"], F.when(empty, wait(a, call)).otherwise(F.expr(f"cast(array() as {given})")), F.array(make(s["section"], call))))
        along = F.when(a["filled"] > 0, keep(a, out=F.concat(a["out"], F.array(make(s["section"], a["closed"]))))).otherwise(keep(a, waiting=F.concat(a["waiting"], F.array(s["section"]))))
        return F.when(n == 0, along).when(n > cap, split).otherwise(whole)

    start = F.struct(F.lit(0).alias("closed"), F.lit(0).alias("filled"), none.alias("waiting"), F.expr(f"cast(array() as {given})").alias("out"))
    calls = lambda a: a["closed"] + F.when(a["filled"] > 0, 1).otherwise(0)
    return F.aggregate(sections, start, step, lambda a: F.when(calls(a) > 0, F.concat(a["out"], wait(a, calls(a) - 1))).otherwise(a["out"]))


def plan_calls(items: DataFrame, *, cap: int = 16) -> DataFrame:
    """(question, call, section, item, decides): what each call shows, and what it decides of that.

    ``items``: (question, rank, item, section, decided, place): in retrieval order by rank, an item once; ``place`` is the order
    in which a section's items are read. A section's list is as long as what was retrieved of it.
    """
    once = items.groupBy("question", "item").agg(F.min(F.struct("rank", "section", "decided", "place")).alias("x")).select("question", "item", "x.*")
    sections = once.groupBy("question", "section").agg(F.min("rank").alias("rank"), F.count_if("decided").cast("int").alias("n"))
    folded = sections.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("rank", "section", "n"))).alias("sections"))
    placed = folded.select("question", F.inline(_fold(F.transform("sections", lambda s: F.struct(s["section"].alias("section"), s["n"].alias("n"))), cap)))
    order = F.row_number().over(Window.partitionBy("question", "section", "decided").orderBy("place", "item")) - 1
    shown = once.withColumn("_k", order).join(placed, ["question", "section"]).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part"))
    decides = F.col("decided") & ((F.col("parts") == 1) | (F.floor(F.col("_k") / F.col("size")) == F.col("_part")))
    return shown.select("question", (F.col("first") + F.col("_part")).alias("call"), "section", "item", decides.alias("decides"))
