"""Printed tables: band lookup, interpolation, conditions by scope, facts against conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def in_band(value: Column) -> Column:
    """Whether a band (number, lo, hi, lo_inc, hi_inc) holds a value; a number matches itself alone, no bound nothing."""
    low = F.col("lo").isNull() | F.when(F.col("lo_inc"), value >= F.col("lo")).otherwise(value > F.col("lo"))
    high = F.col("hi").isNull() | F.when(F.col("hi_inc"), value <= F.col("hi")).otherwise(value < F.col("hi"))
    bounded = F.col("lo").isNotNull() | F.col("hi").isNotNull()
    return F.when(F.col("number").isNotNull(), value == F.col("number")).otherwise(bounded & low & high)


def band_lookup(rows: DataFrame, bands: DataFrame, *, key: str, value: str) -> DataFrame:
    """``rows`` with the columns of the first band (by its column ``row``) that holds their value; none: nulls.

    ``bands`` is a printed table of fixed size.
    """
    bands = F.broadcast(bands)
    names = [c for c in bands.columns if c not in ("lo", "hi", "lo_inc", "hi_inc", "number")]
    hit = rows.join(bands, in_band(F.col(value)), "left")
    first = hit.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy("row")))
    return first.filter("_k = 1").select(*rows.columns, *names)


def interpolate(rows: DataFrame, points: list[tuple[float, float]], *, value: str) -> DataFrame:
    """``rows`` with ``found`` and ``confidence``: exact 1.0, between two printed points 0.6, outside null and 0."""
    points = sorted(points)
    v = F.col(value)
    found, sure = F.lit(None).cast("double"), F.lit(0.0)
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        between = (v > x0) & (v < x1)
        found = F.when(between, y0 + (v - x0) * (y1 - y0) / (x1 - x0)).otherwise(found)
        sure = F.when(between, 0.6).otherwise(sure)
    for x, y in points:
        found, sure = F.when(v == x, F.lit(float(y))).otherwise(found), F.when(v == x, 1.0).otherwise(sure)
    return rows.withColumn("found", found).withColumn("confidence", sure)


def scoped(cells: DataFrame, notes: DataFrame, *, row: str, column: str) -> DataFrame:
    """(row, column, note, blocks): notes by their printed scope: table, column, row or cell. Each scope is an equi-join."""
    base = cells.select(row, column)
    n = F.broadcast(notes)  # footnotes of a printed table, of fixed size
    table = base.crossJoin(n.filter("scope = 'table'").select("note", "blocks"))
    by_column = base.join(n.filter("scope = 'column'").select(F.col("column").alias(column), "note", "blocks"), column)
    by_row = base.join(n.filter("scope = 'row'").select(F.col("row").alias(row), "note", "blocks"), row)
    by_cell = base.join(n.filter("scope = 'cell'").select(F.col("row").alias(row), F.col("column").alias(column), "note", "blocks"), [row, column])
    names = [row, column, "note", "blocks"]
    return table.select(*names).unionByName(by_column.select(*names)).unionByName(by_row.select(*names)).unionByName(by_cell.select(*names))


def compare(value: Column, op: Column, bound: Column) -> Column:
    return F.when(op == "=", value == bound).when(op == ">=", value >= bound).when(op == "<=", value <= bound).when(op == ">", value > bound).when(op == "<", value < bound)


def satisfied(facts: DataFrame, conditions: DataFrame) -> DataFrame:
    """Facts (kind, value, unit) against conditions (condition, kind, op, bound, unit): TRUE, FALSE, UNKNOWN or WRONG_UNIT."""
    c = F.broadcast(conditions.withColumnRenamed("unit", "wanted"))  # stated conditions, of fixed size
    met = facts.join(c, "kind")
    status = F.when(F.col("unit") != F.col("wanted"), "WRONG_UNIT").when(F.col("value").isNull(), "UNKNOWN").when(compare(F.col("value"), F.col("op"), F.col("bound")), "TRUE").otherwise("FALSE")
    return met.withColumn("status", status)
