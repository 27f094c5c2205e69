"""Obligation networks: all networks run at once, a wave at a time.

``ops``: (net, op, merge, authority) with merge one of check, conjunction, alternative, exception; ``requires``: (net,
op, needs, part), part being base or exception for exception merges and input otherwise. ``checks``: (net, op,
status) of the checks. An op runs when all it needs has a status; one that is never reached is UNKNOWN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import logic as L
from ..session import cut_lineage


def execute(ops: DataFrame, requires: DataFrame, checks: DataFrame, max_waves: int = 50, runs: tuple[str, ...] = ("status",)) -> DataFrame:
    """(net, op, status, wave) of every op; wave is null for ops that were never enabled.

    Several runs of the same networks go through the waves together: ``runs`` names the columns of ``checks`` with their
    statuses, and of the result. A run whose merges differ has them in column merge_<run> of ``ops``. A wave takes only
    what waiting ops need along to the next.
    """
    own = [c for c in ops.columns if c.startswith("merge_")]
    done = cut_lineage(ops.filter("merge = 'check'").select("net", "op").join(checks, ["net", "op"], "left").select("net", "op", *(F.coalesce(r, F.lit(L.UNKNOWN)).alias(r) for r in runs), F.lit(0).alias("wave")))
    merges = ops.filter("merge <> 'check'").select("net", "op", "merge", *own)
    # what is needed, with the op that needs it; statuses are filled in as they come to be known
    waiting = cut_lineage(merges.join(requires.select("net", "op", "needs", "part"), ["net", "op"]).select("*", *(F.lit(None).cast("string").alias(r) for r in runs)))
    enabled, new = [], done
    for wave in range(1, max_waves + 1):
        late = waiting.filter(F.col(runs[0]).isNull()).drop(*runs)
        known = waiting.filter(F.col(runs[0]).isNotNull())
        filled = late.join(new.select("net", F.col("op").alias("needs"), *runs), ["net", "needs"], "left").select(*waiting.columns)
        inputs = known.unionByName(filled)
        aggregates = [F.count_if(F.col(runs[0]).isNull()).alias("open")]
        status = {}
        for r in runs:
            part = lambda p, r=r: F.when(F.col("part") == p, F.col(r))
            aggregates += [L.conjunction(F.col(r)).alias(f"{r}_conjunction"), L.alternative(F.col(r)).alias(f"{r}_alternative"), F.max(part("base")).alias(f"{r}_base"), L.alternative(part("exception")).alias(f"{r}_exceptions")]
            kind = F.col(f"merge_{r}" if f"merge_{r}" in own else "merge")
            status[r] = F.when(kind == "conjunction", F.col(f"{r}_conjunction")).when(kind == "alternative", F.col(f"{r}_alternative")).otherwise(L.exception(F.col(f"{r}_base"), F.col(f"{r}_exceptions")))
        merged = inputs.groupBy("net", "op", "merge", *own).agg(*aggregates)
        new = cut_lineage(merged.filter("open = 0").select("net", "op", *(status[r].alias(r) for r in runs), F.lit(wave).alias("wave")))
        if new.isEmpty():
            break
        enabled.append(new)
        waiting = cut_lineage(inputs.join(new.select("net", "op"), ["net", "op"], "left_anti"))
        if waiting.isEmpty():
            break
    for part in enabled:
        done = done.unionByName(part)
    never = merges.select("net", "op").join(done.select("net", "op"), ["net", "op"], "left_anti")
    return done.unionByName(never.select("net", "op", *(F.lit(L.UNKNOWN).alias(r) for r in runs), F.lit(None).cast("int").alias("wave")))


def problems(ops: DataFrame, requires: DataFrame) -> DataFrame:
    """(net, op, problem): repeated ops, needs that nothing produces, merges without two inputs, Support as an obligation."""
    repeated = ops.groupBy("net", "op").count().filter("count > 1").select("net", "op", F.lit("repeated").alias("problem"))
    lost = requires.join(ops.select("net", F.col("op").alias("needs")), ["net", "needs"], "left_anti").select("net", "op", F.lit("needs what nothing produces").alias("problem"))
    inputs = requires.groupBy("net", "op").agg(F.count("*").alias("n"))
    few = ops.filter("merge <> 'check'").join(inputs, ["net", "op"], "left").filter("coalesce(n, 0) < 2").select("net", "op", F.lit("merges fewer than two").alias("problem"))
    weak = ops.filter("authority = 'Support'").select("net", "op", F.lit("Support obliges to nothing").alias("problem"))
    return repeated.unionByName(lost).unionByName(few).unionByName(weak)
