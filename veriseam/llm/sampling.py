"""Bounded samples of labelled rows, for classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str) -> Column:
    """True for rows that nothing may be learned from: crc32 of the id as text is divisible by 5; null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, label: str, per_label: int, id_col: str = "doc_id", text_col: str = "text", most_labels: int = 200, most_rows: int = 16_384, longest: int = 100_000) -> list[tuple[object, str, object]]:
    """(label, text, id) of at most ``per_label`` training rows for each value of ``label``, by hash of the id.

    The hash range is cut into ``per_label`` slots and each takes the row of its smallest hash, so the sample is stable,
    spread over all rows, combined before the shuffle, and only ids are aggregated; texts are fetched for the chosen
    ids alone. Bounds: ``most_rows`` rows in all (many labels get fewer slots each, 8 at least), texts of at most
    ``longest`` code points (longer ones are no examples), one row for each chosen id, the smallest of its texts. More
    than ``most_labels`` values of the label are an error.
    """
    rows = labels.filter(~held_out(id_col) & F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    n = rows.select("label").distinct().count()
    if n > most_labels:
        raise ValueError(f"{n} values of {label}; at most {most_labels} are supported")
    if not n:
        return []
    slots = min(per_label, max(8, most_rows // n))
    short = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.char_length("text") <= longest)
    if docs is not labels:
        rows = rows.join(short.select("id").distinct(), "id", "left_semi")
    else:
        rows = docs.filter(~held_out(id_col) & F.col(label).isNotNull() & (F.char_length(F.coalesce(F.col(text_col), F.lit(""))) <= longest)).select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    h = F.xxhash64("id")
    chosen = rows.groupBy("label", F.pmod(h, F.lit(slots)).alias("slot")).agg(F.min(F.struct(h.alias("h"), "id")).alias("x")).select("label", "x.id").distinct()
    found = short.join(F.broadcast(chosen), "id").groupBy("label", "id").agg(F.min("text").alias("text"))
    return sorted(((r["label"], r["text"], r["id"]) for r in found.collect()), key=repr)
