"""Greedy pairing of wanted and made rows, group by group.

In order, each wanted row takes the best made row that is still free and scores ``floor`` or more; of equal scores the
first. Earlier rows come before later ones everywhere, so this is what deferred acceptance comes to: each row asks for
its best, each made row keeps the earliest that asks, and who is refused asks for the next. A round is two groupings of
the scored pairs; a pair is out as soon as an earlier row holds its made row for good or for now, since a holder only
gives way to a still earlier one. ``in_order`` is for rows whose words stand in a few fields: no pair of them is made
but those that are taken, and rows travel once, dealt by group.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, map_arrow

#: Rows that are paired at once; groups of at most WIDE rows go through numpy together, larger ones alone.
ROWS = 1 << 16
WIDE = 64


def scored(wanted: DataFrame, made: DataFrame, weights: DataFrame, *, floor: float = 0.25) -> DataFrame:
    """(group, wanted, made, score): the weighted share of a wanted row's words that a made row has, where ``floor`` or more.

    ``wanted`` and ``made``: (group, wanted or made, words) with an array of distinct words; ``weights``: (word, weight),
    1 for words without one. Rows meet under common words only.
    """
    words = wanted.select("group", "wanted", F.explode("words").alias("word")).join(weights, "word", "left").select("group", "wanted", "word", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    whole = words.groupBy("group", "wanted").agg(F.sum("weight").alias("whole"))
    shared = words.join(made.select("group", "made", F.explode("words").alias("word")), ["group", "word"]).groupBy("group", "wanted", "made").agg(F.sum("weight").alias("shared"))
    score = F.round(F.col("shared") / F.col("whole"), 9)
    return shared.join(whole, ["group", "wanted"]).select("group", "wanted", "made", score.alias("score")).filter((F.col("score") >= floor) & (F.col("score") > 0))


def greedy(pairs: DataFrame) -> DataFrame:
    """(group, wanted, made, score): the pairs (group, wanted, made, score) that are made when rows choose in order."""
    left, out = pairs, None
    while True:
        left = cut_lineage(left)
        best = left.groupBy("group", "wanted").agg(F.min(F.struct((-F.col("score")).alias("score"), "made")).alias("x")).select("group", "wanted", F.col("x.made").alias("made"))
        held = cut_lineage(best.groupBy("group", "made").agg(F.min("wanted").alias("holder"), F.count("*").alias("askers")))
        busy = held.filter("askers > 1").select("group").distinct()
        # where no row was asked twice all have theirs, and the group is done
        made = cut_lineage(held.join(busy, "group", "left_anti").select("group", F.col("holder").alias("wanted"), "made").join(left, ["group", "wanted", "made"]).select("group", "wanted", "made", "score"))
        out = made if out is None else out.unionByName(made)
        judged = left.join(busy, "group", "left_semi").join(held, ["group", "made"], "left")
        if busy.isEmpty():
            return out
        left = judged.filter(F.col("holder").isNull() | (F.col("wanted") <= F.col("holder"))).select("group", "wanted", "made", "score")


def _scores(shared: np.ndarray, whole: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(whole > 0, np.floor(shared / whole * 1e9 + 0.5) / 1e9, 0.0)


def _narrow(at: np.ndarray, want: list, weight: list, have: list, whole: np.ndarray, floor: float) -> tuple:
    """Pairs of groups of equal size, a row of ``at`` each, by their first rows, then their second, and so on."""
    free, out = np.ones(at.shape, bool), []
    held = [h[at] for h in have]
    every = np.arange(len(at))
    for i in range(at.shape[1]):
        asks = at[:, i]
        shared = np.zeros(at.shape)
        for w, x, h in zip(want, weight, held, strict=True):
            shared += np.where(w[asks][:, None] == h, x[asks][:, None], 0.0)
        score = _scores(shared, whole[asks][:, None])
        score[~free | (score < floor)] = 0.0
        best = score.argmax(axis=1)  # the first of equal scores
        got = np.flatnonzero(score[every, best] > 0)
        free[got, best[got]] = False
        out.append((asks[got], at[got, best[got]], score[got, best[got]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _wide(lo: int, hi: int, want: list, weight: list, have: list, whole: np.ndarray, floor: float) -> tuple:
    """Pairs of one large group: for each choice of fields, made rows by their words there, the first free one in front.

    Of the rows that share the best choice with an asking row, the first free one is what it takes, so a row looks at one
    made row a choice and not at all of them.
    """
    fields = range(len(want))
    choices = [c for n in range(1, len(want) + 1) for c in combinations(fields, n)]
    made = [defaultdict(lambda: array("q")) for _ in choices]
    for c, rows in zip(choices, made, strict=True):
        backwards = zip(*(have[k][lo:hi][::-1].tolist() for k in c), strict=True)
        for j, words in zip(range(hi - lo - 1, -1, -1), backwards, strict=True):
            rows[words].append(j)
    scores = [_scores(sum((weight[k][lo:hi] for k in c), np.zeros(hi - lo)), whole[lo:hi]) for c in choices]
    taken, asks, gets, found = bytearray(hi - lo), array("q"), array("q"), array("d")
    for i, words in enumerate(zip(*(w[lo:hi].tolist() for w in want), strict=True)):
        top, first = 0.0, -1
        for c, held, score in zip(choices, made, scores, strict=True):
            s = score[i]
            if s <= 0 or s < floor or s < top:
                continue
            rows = held.get(tuple(words[k] for k in c))
            while rows and taken[rows[-1]]:
                rows.pop()
            if rows and (s > top or rows[-1] < first):
                top, first = s, rows[-1]
        if first >= 0:
            taken[first] = 1
            asks.append(lo + i)
            gets.append(lo + first)
            found.append(top)
    return np.array(asks, np.int64), np.array(gets, np.int64), np.array(found, float)


def _taken(rows: pa.Table, wants: list[str], weights: list[str], has: list[str], floor: float) -> tuple:
    """(row that asks, row it takes, score), as places in ``rows``, which are whole groups in order."""
    n, known = rows.num_rows, rows["row"].is_valid().to_numpy()
    want, have, weight = [], [], []
    for w, x, h in zip(wants, weights, has, strict=True):
        words = pa.chunked_array([*rows[w].chunks, *rows[h].chunks]).combine_chunks().dictionary_encode()
        code = words.indices.fill_null(-1).to_numpy()
        want.append(np.where(known, code[:n], -1))
        have.append(np.where(known & (code[n:] >= 0), code[n:], -2))
        weight.append(np.where(want[-1] >= 0, rows[x].fill_null(0.0).to_numpy(), 0.0))
    whole = sum(weight, np.zeros(n))
    starts = np.flatnonzero(rows["place"].to_numpy() == 1)
    sizes = np.diff(np.append(starts, n))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for size in np.unique(sizes).tolist():
        of = starts[sizes == size]
        if size <= WIDE:
            found.append(_narrow(of[:, None] + np.arange(size), want, weight, have, whole, floor))
        else:
            found += [_wide(lo, lo + size, want, weight, have, whole, floor) for lo in of.tolist()]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def in_order(rows: DataFrame, *, wants: list[str], weights: list[str], has: list[str], floor: float = 0.25, of_wanted: tuple[str, ...] = (), of_made: tuple[str, ...] = (), at_once: int = ROWS) -> DataFrame:
    """(group, wanted, made, score): the pairs that are made when the rows (group, row) of each group choose in order.

    Every row is wanted and made: ``wants`` names the fields with its words as one that is wanted, ``weights`` their
    weights, and ``has`` the fields with its words as one that was made; words meet in the same field alone, and null is
    no word. A score is as in ``scored``. Columns ``of_wanted`` and ``of_made`` come along from either side of a pair.

    Rows are read in order of their groups; about ``at_once`` are kept, or the group at hand if it is larger, whose time
    grows with its rows. Spark deals them by group, unless they are already; rows without a group or a number take no part.
    """
    names = ["group", "row", *dict.fromkeys([*wants, *weights, *has, *of_wanted, *of_made])]
    placed = rows.select(*names, F.row_number().over(W.partitionBy("group").orderBy("row")).alias("place"))
    kind = {f.name: f.dataType for f in rows.schema}
    taken = [("group", 0, "group"), ("wanted", 0, "row"), ("made", 1, "row"), *((c, 0, c) for c in of_wanted), *((c, 1, c) for c in of_made)]

    def chosen(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        *sides, score = _taken(table, wants, weights, has, floor)
        columns = {name: table[c].take(pa.array(sides[side])) for name, side, c in taken}
        yield from pa.table({**columns, "score": score}).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            batch = batch.filter(batch.column("group").is_valid())
            starts = np.flatnonzero(batch.column("place").to_numpy() == 1)
            if n + batch.num_rows >= at_once and len(starts):
                at = int(starts[-1])
                if n + at:
                    yield from chosen([*held, batch.slice(0, at)])
                held, n = [batch.slice(at)], batch.num_rows - at
            elif batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if held:
            yield from chosen(held)

    made = T.StructType([*(T.StructField(name, kind[c]) for name, _, c in taken), T.StructField("score", T.DoubleType())])
    return map_arrow(placed, run, made).select("group", "wanted", "made", "score", *of_wanted, *of_made)


def agreement(wanted: DataFrame, made: DataFrame, pairs: DataFrame, by: str | None = None) -> DataFrame:
    """(tp, fp, fn, same): pairs, made and wanted rows without one, and pairs whose ``authority`` agrees; for each ``by`` or in all.

    ``wanted`` and ``made`` have group, their id, authority, and ``by`` if given.
    """
    keys = [by] if by else []
    both = pairs.join(wanted.select("group", "wanted", F.col("authority").alias("_w"), *keys), ["group", "wanted"]).join(made.select("group", "made", F.col("authority").alias("_m")), ["group", "made"])
    rows = both.select(*keys, F.lit(1).alias("tp"), F.lit(0).alias("w"), F.lit(0).alias("m"), F.coalesce((F.col("_w") == F.col("_m")).cast("int"), F.lit(0)).alias("same"))
    for side, w, m in ((wanted, 1, 0), (made, 0, 1)):
        rows = rows.unionByName(side.select(*keys, F.lit(0).alias("tp"), F.lit(w).alias("w"), F.lit(m).alias("m"), F.lit(0).alias("same")))
    return tally(rows, *keys)


def tally(rows: DataFrame, *keys: str) -> DataFrame:
    """(tp, fp, fn, same) of summed counts: pairs (tp), wanted (w) and made (m) rows, and pairs that agree (same)."""
    return rows.groupBy(*keys).agg(F.sum("tp").alias("tp"), (F.sum("m") - F.sum("tp")).alias("fp"), (F.sum("w") - F.sum("tp")).alias("fn"), F.sum("same").alias("same"))
