"""Nearest and as-of joins on a line, without comparing every pair.

Places are numbered, not compared: a running count over marks and questions in one order says how many marks lie before
a question, and what lies between two places is a range of numbers, met by an equi-join. Running counts are kept in
buckets of BUCKET units and carried over from bucket to bucket, so that a key with most of the rows is many small
windows and one over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096.0
#: Rows that a task sorts, where the number of rows is known.
TASK_ROWS = 1_000_000


def counted(marks: DataFrame, asks: DataFrame, *, key: str, at: str = "at", bucket: float = BUCKET) -> DataFrame:
    """``asks`` (key, at, own) with n: how many of the distinct places of ``marks`` (key, at) are at or before ``at``.

    Where column own is false only places strictly before count.
    """
    places = marks.select(key, F.col(at).cast("double").alias("_at")).filter("_at is not null").distinct()
    rows = asks.withColumn("_at", F.col(at).cast("double")).withColumn("_kind", F.when(F.col("own"), 2).otherwise(0))
    both = rows.unionByName(places.withColumn("_kind", F.lit(1)), allowMissingColumns=True).withColumn("_b", F.floor(F.col("_at") / bucket))
    is_mark = F.when(F.col("_kind") == 1, 1).otherwise(0)
    ahead = both.groupBy(key, "_b").agg(F.sum(is_mark).alias("_n"))
    ahead = ahead.select(key, "_b", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    here = F.sum(is_mark).over(Window.partitionBy(key, "_b").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_here", here).filter("_kind <> 1").join(ahead, [key, "_b"])
    return out.select(*asks.columns, (F.col("_here") + F.col("_before")).alias("n"))


def numbered(marks: DataFrame, *, key: str, at: str = "at", bucket: float = BUCKET) -> DataFrame:
    """``marks`` with number: 1 for the first distinct place of its key, and so on."""
    own = marks.filter(F.col(at).isNotNull()).withColumn("own", F.lit(True))
    return counted(marks, own, key=key, at=at, bucket=bucket).withColumnRenamed("n", "number").drop("own")


def between(marks: DataFrame, spans: DataFrame, *, key: str, low: Column, high: Column, closed: bool, bucket: float = BUCKET) -> DataFrame:
    """Each of ``spans`` (key, span, ...) with the marks (key, at, ...) from the last at or before ``low`` up to ``high``.

    Marks at ``high`` belong to it if ``closed``. A span before all marks starts at the first.
    """
    asks = spans.select(key, "span", F.explode(F.array(F.struct(low.cast("double").alias("at"), F.lit(True).alias("own"), F.lit("low").alias("end")), F.struct(high.cast("double").alias("at"), F.lit(closed).alias("own"), F.lit("high").alias("end")))).alias("x")).select(key, "span", "x.*").filter("at is not null")
    ends = counted(marks, asks, key=key, bucket=bucket).groupBy(key, "span").agg(F.max(F.when(F.col("end") == "low", F.col("n"))).alias("lo"), F.max(F.when(F.col("end") == "high", F.col("n"))).alias("hi"))
    first = F.greatest(F.lit(1), F.col("lo"))
    held = ends.filter(F.col("hi") >= first).select(key, "span", F.explode(F.sequence(first, F.col("hi"))).alias("number"))
    return spans.join(held.join(numbered(marks, key=key, bucket=bucket), [key, "number"]), [key, "span"])


def resolve_spans(units: DataFrame, marks: DataFrame, *, key: str) -> DataFrame:
    """(key, span, chunks, how): the chunks that text units cover, each once in the order they are met.

    ``units``: (key, span, low, high, explicit), ``marks``: (key, at, chunk). A unit found in the text covers the chunk that
    it starts in and all whose mark lies inside (``span``); one without a place has the known chunks that it names itself
    (``explicit``). Units that cover nothing have an empty list.
    """
    placed = units.filter("low is not null").select(key, "span", "low", "high")
    met = between(marks, placed, key=key, low=F.col("low"), high=F.col("high"), closed=False).groupBy(key, "span", "chunk").agg(F.min("number").alias("number"))
    named = units.filter("low is null").select(key, "span", F.posexplode("explicit").alias("number", "chunk")).join(marks.select(key, "chunk").distinct(), [key, "chunk"]).groupBy(key, "span", "chunk").agg(F.min("number").alias("number"))
    lists = met.unionByName(named.select(met.columns)).groupBy(key, "span").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "chunk"))), lambda x: x["chunk"]).alias("chunks"))
    empty = F.array().cast(marks.select(F.array("chunk")).schema[0].dataType)
    return units.join(lists, [key, "span"], "left").select(key, "span", F.coalesce("chunks", empty).alias("chunks"), F.when(F.col("low").isNotNull(), "span").otherwise("explicit").alias("how"))


def owners(items: DataFrame, captions: DataFrame, *, key: str, pad: float) -> DataFrame:
    """(key, item, caption): items (key, item, at) with the captions (key, caption, at) that own them.

    A caption heads what follows: the nearest caption above owns an item (all of them, if several stand at one height),
    and so does one that begins at most ``pad`` below it.
    """
    spans = items.select(key, F.col("item").alias("span"), F.col("at").alias("y"))
    found = between(captions, spans, key=key, low=F.col("y"), high=F.col("y") + pad, closed=True)
    return found.filter(F.col("at") <= F.col("y") + pad).select(key, F.col("span").alias("item"), "caption")


def dealt(rows: DataFrame, n: int | None, *columns: str) -> DataFrame:
    """``rows`` dealt by ``columns``, so that about TASK_ROWS of ``n`` go to a task; left as they are if that isn't known."""
    if n is None:
        return rows
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS)), *columns)


def crowded(rows: DataFrame, *, key: str, at: str, within: float, bucket: float = BUCKET, n: int | None = None) -> DataFrame:
    """Those of ``rows`` that may have another row of their key less than ``within`` from ``at``.

    The neighbours in order decide; rows that near to the edge of a bucket all stay.
    """
    b = F.floor(F.col(at) / bucket)
    w = Window.partitionBy(key, "_b").orderBy(at)
    edge = (F.col(at) - F.col("_b") * bucket < within) | ((F.col("_b") + 1) * bucket - F.col(at) <= within)
    beside = lambda other: F.coalesce(F.abs(F.col(at) - other) < within, F.lit(False))
    placed = dealt(rows.filter(F.col(at).isNotNull()).withColumn("_b", b), n, key, "_b")
    return placed.withColumn("_near", edge | beside(F.lag(at).over(w)) | beside(F.lead(at).over(w))).filter("_near").select(*rows.columns)


def followed(rows: DataFrame, *, key: str, mark: Column, at: Column, bucket: float = BUCKET, n: int | None = None) -> DataFrame:
    """``rows`` with next: the first place ``mark`` of a row of the same key that lies strictly after their own ``at``.

    Places are read backwards, bucket by bucket; what follows a bucket is carried into it. Rows without a key or ``at``
    are left out.
    """
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != key]
    own = [F.col(f.name) for f in rows.schema if f.name != key]
    place = lambda of, kind, value, columns: F.struct(of.cast("double").alias("_at"), F.lit(kind).alias("_kind"), value.cast("double").alias("_mark"), *columns)
    both = rows.filter(F.col(key).isNotNull()).select(key, F.inline(F.array(place(mark, 1, mark, none), place(at, 0, F.lit(None), own)))).filter("_at is not null").withColumn("_b", F.floor(F.col("_at") / bucket))
    first = both.groupBy(key, "_b").agg(F.min("_mark").alias("_mark"))
    later = F.min("_mark").over(Window.partitionBy(key).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1))
    carried = first.withColumn("_mark", later).filter("_mark is not null").withColumn("_at", F.lit(float("inf"))).withColumn("_kind", F.lit(1))
    so_far = F.min("_mark").over(Window.partitionBy(key, "_b").orderBy(F.col("_at").desc(), "_kind").rowsBetween(Window.unboundedPreceding, 0))
    return dealt(both.unionByName(carried, allowMissingColumns=True), n and 2 * n, key, "_b").withColumn("next", so_far).filter("_kind = 0").select(*rows.columns, "next")


def regions(captions: DataFrame, *, key: str, width: float, height: float, below: float = 2.0, above: float = 4.0, bottom: float = 40.0, side: float = 36.0, least_height: float = 40.0, least_width: float = 80.0, row: float = 6.0, n: int | None = None) -> DataFrame:
    """(key, caption, x0, y0, x1, y1): what each caption heads, down to the next caption strictly below it.

    ``captions``: (key, caption, top, foot, left, inset); of a caption seen twice the one not inset, then the topmost,
    counts. Captions less than ``row`` apart in height share the width. Regions too small to hold anything are left out.
    ``n``: how many captions there are at most, if known; it steers the number of tasks alone.
    """
    best = captions.groupBy(key, "caption").agg(F.min(F.struct("inset", "top", "foot", "left")).alias("x")).select(key, "caption", "x.*")
    placed = followed(best, key=key, mark=F.col("top"), at=F.col("foot") + 1.0, n=n)
    # captions of one row: same or neighbouring strip of its height; most have no other so near
    rows = crowded(best, key=key, at="top", within=row, n=n)
    strip = F.floor(F.col("top") / row)
    near = rows.select(key, F.col("caption").alias("other"), F.col("top").alias("other_top"), F.col("left").alias("other_left"), F.explode(F.array(strip - 1, strip, strip + 1)).alias("strip"))
    beside = rows.select(key, "caption", "top", "left", strip.alias("strip")).join(near, [key, "strip"]).filter((F.col("caption") != F.col("other")) & (F.abs(F.col("top") - F.col("other_top")) < row))
    sides = beside.groupBy(key, "caption").agg(F.min(F.when(F.col("other_left") > F.col("left"), F.col("other_left"))).alias("right"), F.coalesce(F.bool_or(F.col("other_left") < F.col("left")), F.lit(False)).alias("has_left"))
    whole = dealt(placed, n, key, "caption").join(dealt(sides, n, key, "caption"), [key, "caption"], "left")
    own = F.col("left") - 10.0
    x0 = F.when(F.col("inset"), F.greatest(F.lit(side), own)).otherwise(F.lit(side))
    x0 = F.when(F.col("has_left"), F.greatest(x0, own)).otherwise(x0)
    x1 = F.least(F.lit(width - side), F.coalesce(F.col("right") - 8.0, F.lit(width - side)))
    y0, y1 = F.col("foot") + below, F.least(F.lit(height - bottom), F.coalesce(F.col("next") - above, F.lit(height - bottom)))
    return whole.select(key, "caption", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).filter((F.col("y1") - F.col("y0") >= least_height) & (F.col("x1") - F.col("x0") >= least_width))
