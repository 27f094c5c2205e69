"""Run logs: what is done, what is to be run again, merged runs, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resume_state(log: DataFrame, *, key: list[str], order: str, ok: Column) -> DataFrame:
    """Per key: attempts, last success (null without one), whether the last attempt failed, and whether to run it again."""
    rows = log.withColumn("_ok", ok)
    per = rows.groupBy(*key).agg(
        F.count("*").alias("n_attempts"),
        F.count_if("_ok").alias("n_ok"),
        F.max(F.when(F.col("_ok"), F.col(order))).alias("last_ok"),
        F.max_by("_ok", order).alias("_last"),
    )
    return per.select(*key, "n_attempts", "n_ok", "last_ok", (~F.col("_last")).alias("last_failed"), (F.col("n_ok") == 0).alias("run_again"))


def merge_runs(primary: DataFrame, retry: DataFrame, *, key: str, valid: str, value: str) -> DataFrame:
    """A valid primary row stays; an invalid or missing one is replaced by the retry."""
    p = primary.select(key, F.col(valid).alias("p_valid"), F.col(value).alias("p"))
    r = retry.select(key, F.col(valid).alias("r_valid"), F.col(value).alias("r"))
    both = p.join(r, key, "full_outer")
    keep = F.coalesce("p_valid", F.lit(False)) | F.col("r_valid").isNull()
    return both.select(key, F.when(keep, F.col("p")).otherwise(F.col("r")).alias(value), F.when(keep, "primary").otherwise("retry").alias("source"))


def compare_runs(before: DataFrame, after: DataFrame, *, key: str) -> DataFrame:
    """One row: how many cases pass before and after, gained and lost, and how many only one run has."""
    b, a = before.select(key, F.col("passed").alias("b")), after.select(key, F.col("passed").alias("a"))
    both = b.join(a, key, "full_outer")
    n = lambda c, name: F.count_if(c).alias(name)
    return both.agg(
        n(F.col("b"), "n_before"),
        n(F.col("a"), "n_after"),
        n(F.col("a") & ~F.col("b"), "n_gained"),
        n(F.col("b") & ~F.col("a"), "n_lost"),
        n(F.col("a").isNull() | F.col("b").isNull(), "n_unmatched"),
    )


def coverage(mentioned: DataFrame, extracted: DataFrame, *, by: str, key: str) -> DataFrame:
    """Per ``by``: mentioned and extracted keys, missing, extra and the share of mentioned ones that was extracted."""
    m = mentioned.select(by, key).distinct().withColumn("m", F.lit(True))
    e = extracted.select(by, key).distinct().withColumn("e", F.lit(True))
    both = m.join(e, [by, key], "full_outer")
    return both.groupBy(by).agg(
        F.count("m").alias("n_mentioned"),
        F.count("e").alias("n_extracted"),
        F.count_if(F.col("e").isNull()).alias("n_missing"),
        F.count_if(F.col("m").isNull()).alias("n_extra"),
        (F.count_if(F.col("m") & F.col("e")) / F.count("m")).alias("coverage"),
    )
