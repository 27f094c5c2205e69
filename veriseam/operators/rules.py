"""Rules in words: parsed to clauses, decided under Kleene's logic against the facts of a case.

A rule is an ``or`` of ``and`` of clauses, or an ``and`` of ``or`` of clauses, each level perhaps negated: splitting at
"or" leaves no "or" to split at, and likewise "and", so two levels hold every rule and a tree is a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import logic as L
from ..functions import rules as R


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def _clauses(texts: DataFrame) -> DataFrame:
    """The clauses of stripped texts (_text), each of which comes once."""
    text = F.col("_text")
    top = texts.select("_text", R.denied(text).alias("denied"), R.parts(R.affirmed(text)).alias("top"))
    part = top.select("_text", F.col("top.kind").alias("kind"), "denied", F.posexplode("top.parts").alias("i", "text"))
    again = F.col("kind") != "clause"
    part = part.select("_text", "kind", "denied", "i", (again & R.denied(F.col("text"))).alias("inner_denied"), F.when(again, R.affirmed(F.col("text"))).otherwise(F.col("text")).alias("text"))
    inner = part.withColumn("inner", F.when(again, R.parts(F.col("text"))).otherwise(F.struct(F.lit("clause").alias("kind"), F.array("text").alias("parts"))))
    clause = inner.select("_text", "kind", "denied", "i", F.col("inner.kind").alias("inner"), "inner_denied", F.posexplode("inner.parts").alias("j", "text"))
    again = F.col("inner") != "clause"
    clause = clause.select("_text", "kind", "denied", "i", "inner", "inner_denied", "j", (again & R.denied(F.col("text"))).alias("clause_denied"), F.when(again, R.affirmed(F.col("text"))).otherwise(F.col("text")).alias("clause"))
    return clause.withColumn("found", R.comparison(F.col("clause"))).select("*", "found.subject", "found.op", "found.bound", "found.unit").drop("found")


def parse(rules: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """A row for each clause of each rule: (id, kind, denied, i, inner, inner_denied, j, clause_denied, clause, subject, op, bound, unit).

    kind is how the rule's parts combine, inner how those of part i do (or, and, clause); a clause that is no comparison
    has null for subject, op and bound, and stays, as dropping it would change what the rule says. A null or empty rule is
    one such clause. Each distinct text is read once.
    """
    of = rules.select(F.col(id_col).alias("id"), _stripped(F.col(text_col)).alias("_text"))
    return of.join(_clauses(of.select("_text").distinct()), "_text").drop("_text")


def _endings(name: Column) -> Column:
    """Array of what stands behind each underscore of a name."""
    words = F.split(name, "_")
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(2), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), "_"))).otherwise(F.array().cast("array<string>"))


def resolve(clauses: DataFrame, facts: DataFrame) -> DataFrame:
    """``clauses`` (case, subject, ...) with value, fact_unit of the fact (case, name, value, unit) that each is about.

    That is the fact of the subject's name, else the only one whose name ends with the subject behind an underscore, or
    the other way round; two such facts are no answer. Of facts of one name the last counts (by ``at``, if there is one).
    """
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim("name")), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    order = F.struct("at", "value", "unit") if "at" in facts.columns else F.struct("value", "unit")
    one = facts.groupBy("case", name.alias("name")).agg(F.max_by(F.struct("value", "unit"), order).alias("fact"))
    asked = clauses.select("case", "subject").filter("subject is not null").distinct()
    whole = asked.select("case", "subject", F.col("subject").alias("name"), F.lit(True).alias("exact"))
    shorter = asked.select("case", "subject", F.explode(_endings(F.col("subject"))).alias("name"), F.lit(False).alias("exact"))
    direct = whole.unionByName(shorter).join(one, ["case", "name"])
    longer = one.select("case", "fact", "name", F.explode(_endings(F.col("name"))).alias("subject")).join(asked, ["case", "subject"]).select("case", "subject", "name", F.lit(False).alias("exact"), "fact")
    found = direct.select("case", "subject", "name", "exact", "fact").unionByName(longer).groupBy("case", "subject").agg(F.max_by("fact", F.col("exact").cast("int")).alias("fact"), F.max("exact").alias("exact"), F.count("*").alias("n"))
    known = found.select("case", "subject", F.when(F.col("exact") | (F.col("n") == 1), F.col("fact")).alias("fact"))
    return clauses.join(known, ["case", "subject"], "left").select(*clauses.columns, F.col("fact.value").alias("value"), F.col("fact.unit").alias("fact_unit"))


def clause_status(value: Column, fact_unit: Column, op: Column, bound: Column, unit: Column) -> Column:
    """TRUE or FALSE, UNKNOWN without a fact or with units that don't convert exactly."""
    converted = F.lit(None).cast("double")
    for (a, b), factor in R.CONVERTED.items():
        converted = F.when((fact_unit == a) & (unit == b), value * factor).otherwise(converted)
    same = unit.isNull() | fact_unit.isNull() | (unit == fact_unit)
    held = R.holds(F.when(same, value).otherwise(converted), op, bound)
    return F.when(held.isNull(), L.UNKNOWN).when(held, L.TRUE).otherwise(L.FALSE)


def evaluate(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, case, status) of rules (id, case, text) against the facts of their cases; a missing fact is UNKNOWN.

    Each distinct text is read once, and decided once for each case that has it.
    """
    of = rules.select("id", "case", _stripped(F.col("text")).alias("_text"))
    asked = of.select("case", "_text").distinct()
    clauses = resolve(asked.join(_clauses(of.select("_text").distinct()), "_text"), facts)
    signed = lambda no, status: F.when(no, L.negation(status)).otherwise(status)
    status = clause_status(F.col("value"), F.col("fact_unit"), F.col("op"), F.col("bound"), F.col("unit"))
    clauses = clauses.withColumn("status", signed(F.col("clause_denied"), status))
    inner = clauses.groupBy("_text", "case", "kind", "denied", "i", "inner", "inner_denied").agg(L.alternative(F.col("status")).alias("any"), L.conjunction(F.col("status")).alias("all"))
    inner = inner.withColumn("status", signed(F.col("inner_denied"), F.when(F.col("inner") == "or", F.col("any")).otherwise(F.col("all"))))
    top = inner.groupBy("_text", "case", "kind", "denied").agg(L.alternative(F.col("status")).alias("any"), L.conjunction(F.col("status")).alias("all"))
    top = top.select("_text", F.col("case").alias("_case"), signed(F.col("denied"), F.when(F.col("kind") == "or", F.col("any")).otherwise(F.col("all"))).alias("status"))
    return of.join(top, (of["_text"] == top["_text"]) & of["case"].eqNullSafe(top["_case"])).select("id", "case", "status")
