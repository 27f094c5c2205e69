"""Readers and writers. Schemas are given, never inferred; what can't be parsed is kept aside, not dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line; missing keys are null, unknown ones ignored, unreadable lines are in ``_corrupt``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)


def tolerant(rows: DataFrame) -> DataFrame:
    """Rows that could be read."""
    return rows.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def check_questions(questions: DataFrame, *, id_col: str, gold: list[str], expected: int | None = None) -> DataFrame:
    """``questions`` if they are fit to run: unique ids, the stated count, no gold column among them; else an error."""
    leaked = sorted(set(gold) & set(questions.columns))
    if leaked:
        raise ValueError(f"gold columns in the questions: {', '.join(leaked)}")
    n, ids = questions.agg(F.count("*"), F.count_distinct(id_col)).first()
    if n != ids:
        raise ValueError(f"{n - ids} question ids repeat or are null")
    if expected is not None and n != expected:
        raise ValueError(f"{n} questions, {expected} expected")
    return questions


def fetch(rows: DataFrame, ids: DataFrame, *, id_col: str) -> DataFrame:
    """Payload rows for a list of ids: each id once, in the order of its first mention (column pos), unknown ones left out."""
    first = ids.groupBy(id_col).agg(F.min("pos").alias("pos"))
    return rows.join(first, id_col).orderBy("pos")


def upsert(old: DataFrame, new: DataFrame, *, key: str, order: str) -> DataFrame:
    """The last row written for each key."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c not in ("_n", key)]
    last = both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("_n", order)).alias("_x"))
    return last.select(key, *(F.col(f"_x.{c}").alias(c) for c in columns))


def stale(rows: DataFrame, cached: DataFrame, *, key: str, text: Column) -> DataFrame:
    """Rows whose text differs from what a cache (key, fingerprint) was made of, or that it lacks."""
    return rows.withColumn("fingerprint", F.sha2(text, 256)).join(cached.select(key, "fingerprint"), [key, "fingerprint"], "left_anti")


def write_rows(rows: DataFrame, path: str, *, form: str = "parquet", append: bool = False) -> None:
    """A table in one of Spark's formats (parquet, json, csv, orc), committed as a whole."""
    writer = rows.write.mode("append" if append else "overwrite")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)
