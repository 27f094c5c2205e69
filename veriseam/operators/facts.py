"""Conditions against given facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.provisions import compared, in_feet


def compare(conditions: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, resolved, status) of conditions (id, case, name, op, bound, unit) against facts (case, name, value, unit).

    A condition's fact is the one of its name in its case; if none has it, the one whose name ends with it behind a
    dot; several are no answer. Facts are listed under each of their endings, so that both are one equi-join, and a
    fact's names combine before the shuffle. Without a fact, or with units that don't compare, the status is UNKNOWN.
    """
    endings = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.struct((i == 1).alias("whole"), F.array_join(F.slice("parts", i, F.size("parts")), ".").alias("name")))
    listed = facts.select("case", in_feet(F.col("value"), F.col("unit")).alias("value"), F.split("name", r"\.").alias("parts")).select("case", "value", F.inline(endings))
    found = listed.groupBy("case", "name").agg(
        F.count_if("whole").alias("exact"), F.count("*").alias("n"), F.min(F.when(F.col("whole"), F.col("value"))).alias("own"), F.min("value").alias("any")
    )
    value = F.when(F.col("exact") == 1, F.col("own")).when((F.col("exact") == 0) & (F.col("n") == 1), F.col("any"))
    joined = conditions.join(found, ["case", "name"], "left").withColumn("value", value)
    return joined.select("id", F.col("value").isNotNull().alias("resolved"), compared(F.col("value"), F.col("op"), in_feet(F.col("bound"), F.col("unit"))).alias("status"))
