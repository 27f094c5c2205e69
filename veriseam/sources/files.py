"""Scans and sinks of a run's files: checksums, question items, folders of row files, graphs, table grids, reading logs.

All are plain Spark readers with given schemas; what can't be read is kept aside or left out as each says, and never
ends a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import number_rows


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of every file under a path or pattern; each file is read by one task."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def check_sum(spark: SparkSession, path: str, expected: str) -> None:
    """An error unless ``path`` is one file with the stated SHA-256."""
    found = [r["sha256"] for r in checksums(spark, path).limit(2).collect()]
    if found != [expected]:
        raise ValueError(f"{path}: SHA-256 {', '.join(found) or 'of no file'}, {expected} expected")


def _in_order(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): the non-empty lines of text files, numbered from 0 in the order of files and lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    place = F.struct("_path", "_block", "_id")
    first = lines.select("_path").distinct().orderBy("_path").collect()  # the files of a question set
    file = F.array_position(F.array(*(F.lit(r[0]) for r in first)), F.col("_path")) if first else F.lit(0)
    # ids grow with the place in a file; one number for both orders them
    rows = lines.filter(F.trim("value") != "").select("value", (file * F.lit(1 << 52).cast("decimal(38,0)") + F.col("_id")).cast("decimal(38,0)").alias("at"), place.alias("place"))
    return number_rows(rows.select("value", "at"), ["at"]).select("pos", "value")


QA_FIELDS = "qa_id string, question_id string, question string, question_type string, primary_modality string, expected_refusal boolean, answerable boolean, gold_answer string, references array<string>, gold_figures array<string>, figures array<string>"


def read_items(spark: SparkSession, path: str, *, limit: int | None = None, ids: list[str] | None = None) -> DataFrame:
    """Question items of JSON lines: (pos, qa_id, question, question_type, expected_refusal, gold_answer, references, gold_figures, raw).

    An item without an id is named by its place (qa_0001 is the first). Refusal is what the item says, else that it says
    it can't be answered. ``ids`` keeps those, then ``limit`` the first of the rest. Lines that are no object are left out.
    """
    read = F.from_json("value", QA_FIELDS)
    rows = _in_order(spark, path).withColumn("r", read).filter(F.trim("value").startswith("{") & F.col("r.question").isNotNull())
    some = lambda c: F.when(F.size(F.col(c)) > 0, F.col(c))
    none = F.array().cast("array<string>")
    named = lambda c: F.when(F.col(c) != "", F.col(c))
    items = rows.select(
        "pos",
        F.coalesce(named("r.qa_id"), named("r.question_id"), F.format_string("qa_%04d", F.col("pos") + 1)).alias("qa_id"),
        "r.question",
        F.coalesce(named("r.question_type"), named("r.primary_modality")).alias("question_type"),
        F.coalesce("r.expected_refusal", F.col("r.answerable") == F.lit(False), F.lit(False)).alias("expected_refusal"),
        "r.gold_answer",
        F.coalesce("r.references", none).alias("references"),
        F.coalesce(some("r.gold_figures"), some("r.figures"), none).alias("gold_figures"),
        F.col("value").alias("raw"),
    )
    if ids:
        items = items.join(F.broadcast(spark.createDataFrame([(i,) for i in sorted(set(ids))], "qa_id string")), "qa_id", "left_semi").select(items.columns)
    return items if limit is None else items.orderBy("pos").limit(limit)


def read_row_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One row for each file ``folder/*/*.json`` that holds a JSON object, with its path; other files are left out."""
    files = spark.read.option("ignoreCorruptFiles", True).text(f"{folder}/*/*.json", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    good = files.filter(F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{"))
    return good.select("path", F.from_json("value", schema).alias("r")).select("path", "r.*")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as two Parquet tables, edges by relation, so that a reader prunes to the relations it follows."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


CELL = "text string, number double, unit string, minimum double, maximum double, min_inclusive boolean, max_inclusive boolean, formula string, missing string, footnotes array<string>"
GRID = f"table_id string, title string, columns array<string>, rows array<array<struct<{CELL.replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean').replace(' array<string>', ':array<string>')}>>>, footnotes array<struct<marker:string,text:string,applies_to:string>>"


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """Table grids of JSON lines; what a cell doesn't state has its default."""
    grids = spark.read.schema(GRID).json(path).filter("table_id is not null")
    yes, none = F.lit(True), F.array().cast("array<string>")
    full = lambda c: c.withField("min_inclusive", F.coalesce(c["min_inclusive"], yes)).withField("max_inclusive", F.coalesce(c["max_inclusive"], yes)).withField("footnotes", F.coalesce(c["footnotes"], none))
    return grids.withColumn("rows", F.transform("rows", lambda row: F.transform(row, full)))


def cells(grids: DataFrame) -> DataFrame:
    """(table_id, row, column, header, ...): a row for each cell, with its column's header."""
    each = grids.select("table_id", "columns", F.posexplode("rows").alias("row", "_r")).select("table_id", "columns", "row", F.posexplode("_r").alias("column", "cell"))
    return each.select("table_id", "row", "column", F.get("columns", F.col("column")).alias("header"), "cell.*")


def write_grids(grids: DataFrame, path: str) -> None:
    """Grids as JSON lines, without what a cell leaves at its default."""
    trimmed = lambda c: c.withField("min_inclusive", F.when(~c["min_inclusive"], False)).withField("max_inclusive", F.when(~c["max_inclusive"], False)).withField("footnotes", F.when(F.size(c["footnotes"]) > 0, c["footnotes"]))
    grids.withColumn("rows", F.transform("rows", lambda row: F.transform(row, trimmed))).write.mode("overwrite").option("ignoreNullFields", True).json(path)


# Ids in headings, ranges of them, marks of findings, and bullets.
LOG_ID = r"\b([0-9]+[A-Z]?-[0-9]+[a-z]?)\b"
LOG_RANGE = r"([0-9]+[A-Z]?)-([0-9]+)\s*(?:to|through|–)\s*(?:[0-9]+[A-Z]?-)?([0-9]+)"
LOG_BULLET = r"(?ms)^- (.+?)(?=\n- |\n\n|\Z)"
LOG_MARK = r"\*\*(FIND|CHECK|DATA|OPEN)"


def reading_log(text: Column) -> Column:
    """array<struct<head, ids, marks, body, bullets>> of a log in Markdown: entries under ``###`` headings of figures or tables.

    A heading may be plural, a range (``Figures 6P-2 to 6P-7`` names six) or wrapped onto a second line before ``(PDF``.
    """
    blocks = F.slice(F.split(text, "\n### ", -1), 2, 1 << 20)

    def entry(block: Column) -> Column:
        lines = F.split(block, "\n", -1)
        second = F.get(lines, F.lit(1))
        wrapped = ~lines[0].contains("(PDF") & F.coalesce(second.contains("(PDF") & (F.char_length(second) < 160), F.lit(False))
        head = F.trim(F.when(wrapped, F.concat(F.rtrim(lines[0]), F.lit(" "), F.trim(second))).otherwise(lines[0]))
        rest = F.slice(lines, F.when(wrapped, 3).otherwise(2), F.size(lines))
        body = F.regexp_replace(F.array_join(rest, "\n"), r"^\s+|\s+$", "")
        low, high = (F.regexp_extract(head, LOG_RANGE, k).try_cast("int") for k in (2, 3))
        spread = F.when((high >= low) & (high - low < 40), F.transform(F.sequence(low, F.greatest(low, high)), lambda n: F.concat(F.regexp_extract(head, LOG_RANGE, 1), F.lit("-"), n.cast("string"))))
        ids = F.concat(F.regexp_extract_all(head, F.lit(LOG_ID), F.lit(1)), F.coalesce(spread, F.array().cast("array<string>")))
        bullets = F.transform(F.regexp_extract_all(body, F.lit(LOG_BULLET), F.lit(1)), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
        marks = F.array_distinct(F.regexp_extract_all(body, F.lit(LOG_MARK), F.lit(1)))
        return F.struct(head.alias("head"), F.array_sort(F.array_distinct(ids)).alias("ids"), marks.alias("marks"), body.alias("body"), bullets.alias("bullets"))

    return F.filter(F.transform(blocks, entry), lambda e: e["head"].rlike(r"^(?:Figures?|Tables?)\b"))


def read_reading_log(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, head, ids, marks, body, bullets): the entries of the logs under a path, in their order."""
    logs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return logs.select("path", F.posexplode(reading_log(F.col("value"))).alias("n", "e")).select("path", "n", "e.*")
