"""Lists in paragraphs: items whose markers run in sequence, found by one fold over the lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a line that starts an item, or holds its marker alone.
ITEM = r"^([A-Z]|[0-9]{1,3})\.(?:\s+(\S.*))?$"


def list_items(lines: Column) -> Column:
    """array<struct<marker, start, stop>> of the top-level list in an array of lines; empty if there are fewer than two items.

    The first marker is A or 1; every other has to be the one that follows, in letters or numbers. A marker of any other
    value is nested content and stays inside its item. Lines count from 0, stop is exclusive; the lead ends where the
    first item starts.
    """
    follow = lambda m: F.when(m.rlike("^[A-Z]$"), F.when(m != "Z", F.chr(F.ascii(m) + 1)).otherwise("[")).otherwise((m.cast("int") + 1).cast("string"))

    def step(a: Column, line: Column) -> Column:
        marker = F.regexp_extract(line, ITEM, 1)
        plain = F.when(marker.rlike("^0"), F.lit("")).otherwise(marker)
        fits = (plain != "") & F.coalesce(plain == a["next"], plain.isin("A", "1"))
        at = a["at"] + 1
        return F.when(fits, F.struct(at.alias("at"), follow(plain).alias("next"), F.concat(a["out"], F.array(F.struct(marker.alias("marker"), a["at"].alias("start")))).alias("out"))).otherwise(F.struct(at.alias("at"), a["next"].alias("next"), a["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("next"), F.expr("cast(array() as array<struct<marker:string,start:int>>)").alias("out"))

    def end(a: Column) -> Column:
        stop = lambda x, i: F.coalesce(F.get(a["out"], i + 1)["start"], a["at"])
        made = F.transform(a["out"], lambda x, i: F.struct(x["marker"].alias("marker"), x["start"].alias("start"), stop(x, i).alias("stop")))
        return F.when(F.size(a["out"]) > 1, made).otherwise(F.slice(made, 1, 0))

    return F.aggregate(lines, start, step, end)
