"""Joins and merges of ranked lists, spans, plans and evidence, and metrics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered_union(lists: list[DataFrame], *, by: str, item: str) -> DataFrame:
    """(by, item, place): items of all lists by their first mention, list after list, each by rank."""
    rows = None
    for i, ranked in enumerate(lists):
        part = ranked.select(by, item, F.struct(F.lit(i).alias("list"), F.col("rank").cast("long").alias("rank")).alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy(by, item).agg(F.min("at").alias("at"))
    return first.select(by, item, F.row_number().over(W.partitionBy(by).orderBy("at", item)).cast("long").alias("place"))


def most_common(rows: DataFrame, *, by: str, value: str, seen: str, n: int) -> DataFrame:
    """(by, value, n, place): the n commonest values of each group; of equally common ones the first seen leads."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"), F.min(seen).alias("first"))
    placed = counts.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(F.col("n").desc(), "first")).cast("long"))
    return placed.filter(F.col("place") <= n).select(by, value, "n", "place")


def longest_spans(spans: DataFrame, *, by: str) -> DataFrame:
    """Spans (by, start, end) that no longer span of the same text contains; equal ones are one."""
    own = spans.select(by, "start", "end").distinct()
    other = own.select(F.col(by).alias("_by"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    inside = (F.col(by) == F.col("_by")) & (F.col("_start") <= F.col("start")) & (F.col("_end") >= F.col("end")) & (F.col("_end") - F.col("_start") > F.col("end") - F.col("start"))
    return own.join(other, inside, "left_anti")


def differences(old: DataFrame, new: DataFrame, *, key: str, fields: list[str]) -> DataFrame:
    """(key, kind, field): what one version has that the other lacks, and the first field in which a row differs."""
    a = old.select(key, F.struct(*fields).alias("a"))
    b = new.select(key, F.struct(*fields).alias("b"))
    both = a.join(b, key, "full")
    field = F.lit(None).cast("string")
    for f in reversed(fields):
        field = F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f).otherwise(field)
    kind = F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "gained").when(field.isNotNull(), "changed")
    return both.select(key, kind.alias("kind"), F.when(kind == "changed", field).alias("field")).filter("kind is not null")


def merged_evidence(rows: DataFrame, *, by: list[str], status: str, confidence: str, evidence: str, order: str) -> DataFrame:
    """(by, confidence, evidence): a merge is as weak as its weakest input; evidence in order of first mention.

    The inputs that apply count, or all where none applies; a confidence of zero or null is no statement.
    """
    applies = F.col(status) != "NOT_APPLICABLE"
    some = rows.groupBy(*by).agg(F.max(applies).alias("_some"))
    used = rows.join(some, by).filter(applies | ~F.col("_some"))
    first = used.groupBy(*by, evidence).agg(F.min(order).alias("_at"), F.min(F.when(F.col(confidence) > 0, F.col(confidence))).alias("_c"))
    return first.groupBy(*by).agg(F.coalesce(F.min("_c"), F.lit(0.0)).alias("confidence"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", evidence))), lambda x: x[evidence]), ",").alias("evidence"))


def siblings(rows: DataFrame, *, key: str, parent: str, most: int = 24) -> DataFrame:
    """(key, sibling): rows of the same parent; parents of more than ``most`` rows have no siblings."""
    small = rows.groupBy(parent).agg(F.count("*").alias("_n")).filter(F.col("_n") <= most)
    held = rows.select(key, parent).join(small.select(parent), parent)
    return held.join(held.select(parent, F.col(key).alias("sibling")), parent).filter(F.col(key) != F.col("sibling")).select(key, "sibling")


def bound(wanted: DataFrame, named: DataFrame, loose: DataFrame, *, key: str) -> DataFrame:
    """(key, var, value, how) for wanted (key, var, unit): by name, else by the only loose value of the unit; else missing."""
    only = loose.groupBy(key, "unit").agg(F.count("*").alias("n"), F.first("value").alias("loose")).filter("n = 1").drop("n")
    by_name = named.groupBy(key, F.col("name").alias("var")).agg(F.max("value").alias("named"))
    both = wanted.join(by_name, [key, "var"], "left").join(only, [key, "unit"], "left")
    how = F.when(F.col("named").isNotNull(), "name").when(F.col("loose").isNotNull(), "unit").otherwise("missing")
    return both.select(key, "var", F.coalesce("named", "loose").alias("value"), how.alias("how"))


def precision_recall(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1 of summed counts; zero where nothing was found or wanted."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]
