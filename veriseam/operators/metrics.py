"""Evaluation: ranking metrics in both of their definitions, calibration, paired bootstrap, composites."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, map_arrow, spread


#: Items whose texts one pass over the documents looks for.
ITEM_BLOCK = 20_000
#: Rows whose values go to the tasks of a bootstrap whole, and draws that one task makes.
MOST_SHIPPED, DRAWS_A_TASK = 2_000_000, 4_000_000


def contains_qrels(docs: DataFrame, items: DataFrame, *, did: str, dtext: Column, qid: str, qtext: Column) -> DataFrame:
    """(qid, did): documents that hold an item's text verbatim, wherever it starts or ends, once each.

    The items are a stated set: one automaton holds the texts of a block of them, and a pass over the documents finds
    all at once, so that no text is shuffled. Null and empty texts hold nothing and stand nowhere.
    """
    stated = items.select(qid, qtext.alias("text")).filter("text <> ''").distinct()
    blocks = max(1, -(-stated.count() // ITEM_BLOCK))
    ddl = f"`{qid}` {items.schema[qid].dataType.simpleString()}, `{did}` {docs.schema[did].dataType.simpleString()}"
    out = None
    for block in range(blocks):
        held = (stated if blocks == 1 else stated.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)).toArrow()
        keys: dict[str, list] = {}
        for key, text in zip(held.column(0).to_pylist(), held.column(1).to_pylist(), strict=True):
            keys.setdefault(text, []).append(key)

        def run(batches: Iterator[pa.RecordBatch], keys=keys, kind=held.schema.field(0).type) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            matcher = ahocorasick.Automaton()
            for text in keys:
                matcher.add_word(text, text)
            matcher.make_automaton()
            for batch in batches:
                rows, found = [], []
                for i, text in enumerate(batch.column(1)):
                    for own in {x for _, x in matcher.iter(text.as_py())} if len(keys) else ():
                        rows += [i] * len(keys[own])
                        found += keys[own]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(found, type=kind), batch.column(0).take(pa.array(rows))], names=[qid, did])

        part = map_arrow(spread(docs.select(did, dtext.alias("text")).filter("text <> ''")), run, ddl)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def at_rank(ranked: DataFrame, qrels: DataFrame, questions: DataFrame, *, qid: str, item: str, k: int) -> DataFrame:
    """Per question: n_relevant, hit, set recall, MRR and nDCG at k against the ideal of all relevant; null without any."""
    n = qrels.groupBy(qid).agg(F.count("*").alias("n_relevant"))
    hits = ranked.filter(F.col("rank") <= k).join(qrels, [qid, item], "left_semi").groupBy(qid).agg(F.count("*").alias("n_hit"), F.min("rank").alias("first_rank"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    rows = questions.select(qid).join(n, qid, "left").join(hits, qid, "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    known = lambda c: F.when(F.col("n_relevant") > 0, F.coalesce(c, F.lit(0.0)))
    return rows.select(
        qid,
        F.coalesce("n_relevant", F.lit(0)).cast("long").alias("n_relevant"),
        known(F.when(F.col("n_hit") > 0, 1.0)).alias("hit_at_k"),
        known(F.col("n_hit") / F.col("n_relevant")).alias("recall_set_at_k"),
        known(1 / F.col("first_rank")).alias("mrr_at_k"),
        known(F.col("dcg") / ideal).alias("ndcg_at_k"),
    )


def hit_style(ranked: DataFrame, qrels: DataFrame, questions: DataFrame, *, qid: str, item: str, hit_k: int = 5, k: int = 6) -> DataFrame:
    """Per question: hit within ``hit_k``, nDCG against the relevant that were retrieved, precision among those returned."""
    judged = ranked.filter(F.col("rank") <= k).join(qrels.withColumn("rel", F.lit(1.0)), [qid, item], "left").fillna(0.0, ["rel"])
    sums = judged.groupBy(qid).agg(F.max(F.when(F.col("rank") <= hit_k, F.col("rel")).otherwise(0.0)).alias("hit"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum("rel").alias("n"), F.avg("rel").alias("precision"))
    ideal = F.when(F.col("n") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n").cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)))
    has = qrels.select(qid).distinct().withColumn("any", F.lit(True))
    rows = questions.select(qid).join(has, qid, "left").join(sums, qid, "left")
    known = lambda c: F.when(F.col("any"), F.coalesce(c, F.lit(0.0)))
    return rows.select(qid, known(F.col("hit")).alias("hit_at_5"), known(F.col("dcg") / ideal).alias("ndcg_retrieved_at_6"), known(F.col("precision")).alias("context_precision_at_6"))


def calibration(rows: DataFrame, *, confidence: Column, outcome: Column, bins: int = 10) -> DataFrame:
    """One row: n, Brier score, expected calibration error over equal-width bins."""
    r = rows.select(confidence.alias("p"), outcome.cast("double").alias("y")).filter("p is not null and y is not null")
    per = r.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg("y").alias("acc"), F.sum((F.col("p") - F.col("y")) ** 2).alias("se"))
    return per.agg(F.sum("n").cast("long").alias("n"), (F.sum("se") / F.sum("n")).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def draw(key: Column, n: Column) -> Column:
    """A hash-seeded draw from 0 to n - 1, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("bigint") % n


def bootstrap(deltas: DataFrame, *, value: str, order: list[str], replicates: int) -> DataFrame:
    """One row: mean and the percentile interval (95 %) of the mean under resampling of rows with replacement.

    Draws are hashes of (replicate, place), so the result is the same anywhere. They are spread over tasks by their own
    number, not by where the few rows lie, and look their value up: a draw has 24 bits, so at most 2^24 rows are ever
    drawn. Up to MOST_SHIPPED of them go to the tasks whole, beyond that draws and rows meet by a shuffle.
    """
    placed = cut_lineage(number_rows(deltas, order).select("pos", value).filter(F.col("pos") < 1 << 24))
    mean = deltas.agg(F.count("*").cast("long").alias("n"), F.avg(value).alias("mean"))
    n = deltas.count()
    spark = deltas.sparkSession
    slices = max(spark.sparkContext.defaultParallelism, -(-n * replicates // DRAWS_A_TASK))
    places = spark.range(0, n * replicates, 1, slices).select(F.expr(f"id div {max(n, 1)}").alias("rep"), (F.col("id") % max(n, 1)).alias("at"))
    drawn = places.select("rep", draw(F.concat_ws(":", "rep", "at"), F.lit(n)).alias("pos"))
    means = drawn.join(F.broadcast(placed) if n <= MOST_SHIPPED else placed, "pos").groupBy("rep").agg(F.avg(value).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high")).crossJoin(mean)


def number_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with pos: 0, 1, 2, ... in ``order``, without a window over all rows.

    Rows are hashed into buckets of the first order column's quantile, numbered in each, and offset by the counts of
    those before; only one count a bucket is gathered.
    """
    first = order[0]
    cuts = rows.agg(F.percentile_approx(first, [i / 64 for i in range(1, 64)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col(first))) if cuts else F.lit(0)
    r = rows.withColumn("_b", bucket)
    counts = sorted(tuple(x) for x in r.groupBy("_b").count().collect())
    before, total = {}, 0
    for b, c in counts:
        before[b] = total
        total += c
    offset = F.create_map(*(F.lit(x) for b in before.items() for x in b))[F.col("_b")] if before else F.lit(0)
    return r.withColumn("pos", (F.row_number().over(W.partitionBy("_b").orderBy(*order)) - 1 + offset).cast("long")).drop("_b")


def upper_median(values: Column) -> Column:
    """The element at place n // 2 (from 0) of the sorted values; no interpolation."""
    ordered = F.array_sort(F.collect_list(values))
    return F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


# Weights of the composite scores.
def composites(*, recall: Column, mrr: Column, ndcg: Column, precision: Column, routing: Column, sufficiency: Column) -> Column:
    """The retrieval score out of 25."""
    return 10 * recall + 5 * (mrr + ndcg) / 2 + 5 * precision + 3 * routing + 2 * sufficiency


def generation_score(*, correctness: Column, completeness: Column, faithfulness: Column, citation: Column, visual: Column, unanswerable: Column) -> Column:
    """The generation score out of 60."""
    return 22 * correctness + 10 * completeness + 12 * faithfulness + 6 * citation + 7 * visual + 3 * unanswerable


def reliability_score(*, success: Column, brier: Column, ece: Column) -> Column:
    """The reliability score out of 12."""
    return 6 * success + 6 * (1 - (brier + ece) / 2)
