"""Text verification: near-duplicate sets, statements with offsets, quotes, citations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, map_arrow


#: Words are counted in so many places, of which the driver sees one row each.
PLACES = 1 << 18
#: Sets of at most so many words have sketches of 1, 2 and 4 longs; larger ones of 8.
SKETCHED = (96, 192, 384)


def _head_words(counts: np.ndarray, least: float):
    """(word, set, n, k, sketch) of sets (set, words as hashes): the words at the head of each, rare ones first, and a sketch.

    A sketch has a bit for the parity of the words of each place, so two sets differ in at least as many words as their
    sketches in bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                words = part.column(1).flatten().to_numpy()
                n = np.asarray(pc.list_value_length(part.column(1)), dtype=np.int64)
                row = np.repeat(np.arange(len(n)), n)
                first = np.cumsum(n) - n
                by = np.lexsort((words, counts[words & (PLACES - 1)], row))
                k = 1 + n // 128
                head = n - np.ceil(least * n - 1e-9).astype(np.int64) + k
                kept = by[(np.arange(len(by)) - first[row]) < head[row]]
                longs = 1 << np.searchsorted(SKETCHED, n)
                place = (words >> 20) & (64 * longs[row] - 1)
                bits = np.bincount(row * 512 + place, minlength=len(n) * 512).astype(np.uint8) & 1
                sketch = np.packbits(bits.reshape(len(n), 512), axis=1, bitorder="little").view(np.int64)
                of = row[kept]
                sizes = longs[of]
                flat = sketch[np.repeat(of, sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], type=pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(words[kept]), pa.array(part.column(0).to_numpy()[of]), pa.array(n[of].astype(np.int32)), pa.array(k[of].astype(np.int32)), lists], names=["word", "set", "n", "k", "sketch"])

    return run


def _apart(a: Column, b: Column) -> Column:
    """In how many bits two sketches differ, the longer one folded to the length of the other."""
    fold = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda p, q: p.bitwiseXOR(q))).otherwise(x)
    return F.aggregate(F.zip_with(fold(a, b), fold(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)


def similar_sets(rows: DataFrame, *, by: str, key: str, words: str, least: float) -> DataFrame:
    """(by, doc_a, doc_b, likeness): pairs of distinct sets of one group whose Jaccard likeness is at least ``least``.

    Equal sets collapse to their smallest key first. Two sets of that likeness share k words among the first
    n - ceil(least * n) + k of each, whatever order all sets keep; words counted rarely come first. Those are joined, as
    hashes, with the lengths that can match and sketches that differ in no more bits than such sets may in words, and
    pairs that share k of them are compared in full. Sets travel whole only for those.
    """
    sets = rows.filter((F.size(words) > 0) & F.col(by).isNotNull()).groupBy(by, F.array_sort(words).alias("ws")).agg(F.min(key).alias("id"))
    sets = cut_lineage(sets.withColumn("set", F.monotonically_increasing_id()))
    hashed = sets.select("set", F.transform("ws", lambda w: F.xxhash64(F.col(by), w)).alias("hs"))
    counted = hashed.select(F.explode("hs").alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(PLACES - 1)).cast("int").alias("at")).agg(F.count("*").alias("n")).toArrow()  # at most PLACES rows
    counts = np.zeros(PLACES, dtype=np.int64)
    counts[counted.column("at").to_numpy()] = counted.column("n").to_numpy()
    keys = map_arrow(hashed, _head_words(counts, least), "word long, set long, n int, k int, sketch array<long>")
    a, b = keys.alias("a"), keys.alias("b")
    fits = (F.col("a.set") < F.col("b.set")) & (F.col("a.n") >= least * F.col("b.n") - 1e-9) & (F.col("b.n") >= least * F.col("a.n") - 1e-9)
    differ = (1 - least) / (1 + least) * (F.col("a.n") + F.col("b.n")) + 1e-6
    met = a.join(b.hint("merge"), (F.col("a.word") == F.col("b.word")) & fits & (_apart(F.col("a.sketch"), F.col("b.sketch")) <= differ))
    pairs = met.groupBy(F.col("a.set").alias("set_a"), F.col("b.set").alias("set_b")).agg(F.count("*").alias("shared"), F.min(F.least("a.k", "b.k")).alias("k")).filter("shared >= k").select("set_a", "set_b")
    side = lambda n: sets.select(F.col(by).alias(f"by_{n}"), F.col("id").alias(f"id_{n}"), F.col("set").alias(f"set_{n}"), F.col("ws").alias(f"ws_{n}"))
    both = pairs.join(side("a"), "set_a").join(side("b"), "set_b").filter("by_a = by_b")
    shared = F.size(F.array_intersect("ws_a", "ws_b"))
    likeness = shared / (F.size("ws_a") + F.size("ws_b") - shared)
    return both.select(F.col("by_a").alias(by), F.least("id_a", "id_b").alias("doc_a"), F.greatest("id_a", "id_b").alias("doc_b"), likeness.alias("likeness")).filter(F.col("likeness") >= least)


def statements(rows: DataFrame, *, by: str, order: str, text: str, heading: Column) -> DataFrame:
    """Non-empty lines, numbered within ``by``, with their place in the text and the last line for which ``heading`` holds."""
    lines = rows.withColumn("_heading", heading).withColumn("_lines", F.split(F.coalesce(text, F.lit("")), "\n"))
    start = F.aggregate(F.slice("_lines", F.lit(1), F.col("line")), F.lit(0), lambda s, x: s + F.char_length(x) + 1)
    each = lines.select(by, order, "_heading", "_lines", F.posexplode("_lines").alias("line", "_s")).withColumn("start", start)
    each = each.filter(F.trim("_s") != "").withColumn("end", F.col("start") + F.char_length("_s"))
    w = W.partitionBy(by).orderBy(order, "line")
    head = F.last(F.when(F.col("_heading"), F.col("_s")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return each.select(by, order, "line", "start", "end", F.row_number().over(w).alias("n"), head.alias("heading"))


def cited(citations: DataFrame, evidence: DataFrame, *, on: list[str]) -> DataFrame:
    """Citations with whether all parts of their key are those of one piece of evidence; unknown ordinals ('?') are skipped."""
    sure = citations.filter(F.col(on[-1]) != "?")
    return sure.join(evidence.select(*on).distinct().withColumn("known", F.lit(True)), on, "left").fillna(False, ["known"])
