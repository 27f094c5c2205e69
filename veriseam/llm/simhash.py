"""SimHash near-duplicates: fingerprints, and links of few differing bits by the generalised pigeonhole principle.

A fingerprint has 64 bits; bit i is 1 if it is set in over half of the XXH64 values (seed 42) of a text's word shingles.
Fingerprints of at most ``distance`` differing bits are found so:

1. Equal fingerprints collapse to one; from here on only distinct fingerprints matter.
2. On a sample of them (SAMPLE rows by hash; it steers cost, never the result) bits that go together are grouped into
   the same of m partitions, greedily by correlation.
3. With thresholds t_1..t_m that add up to ``distance`` - m + 1, two fingerprints within the distance differ in at
   most t_i bits in some partition i (general pigeonhole; -1 leaves a partition out). Dynamic programming takes the
   thresholds with the least estimated cost: rows to probe with, and candidate pairs by the sample's distances. m from
   1 to ``distance`` + 1 compete.
4. A fingerprint is probed under every value of partition i with t_i of its bits masked. Fingerprints under a common
   key are verified against each other in numpy, by a search that takes out of play what it has reached: a group in
   which all are linked costs one pass, and only links that join something new are written, fewer than members.
5. Connected components of these links.

Null and empty texts have fingerprint zero, as texts without words; they are linked like all others. Repeated rows are
exact copies. Null ids take part and come last among the smallest: a component's id is null only if all its ids are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard_join
from .common import cut_lineage, map_arrow, map_rows
from .components import connected

BITS = 64
#: Distinct fingerprints from which correlations and candidate counts are estimated.
SAMPLE = 20_000
#: How many of its nearest under a key a fingerprint is linked to in the first round.
NEAR = 3
#: Rows to drop (an id and a digest of 16 bytes each) that are broadcast; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 250_000
#: Seconds for a probe row and a candidate pair; only their ratio matters.
ROW_COST, PAIR_COST = 1e-6, 5e-9


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of a text as an unsigned integer; A-Z are lower-cased, words end at ASCII white space."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(parts), 42)]
    else:
        hashes = list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)), repeat(42)))
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.array(hashes[at : at + 65536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(``id_col``, fp): the fingerprint of every whole text as a signed 64-bit integer."""

    def start() -> Callable:
        def step(keys, texts):
            made = [fingerprint(t, words) for t in texts]
            return [keys, [f - (1 << 64) if f >> 63 else f for f in made]]

        return step

    return map_rows(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), [id_col, text_col], start, pa.schema([(id_col, pa.int64()), ("fp", pa.int64())]), f"`{id_col}` long, fp long")


def _correlated(bits: np.ndarray, m: int) -> list[list[int]]:
    """Bit positions in m groups of about equal size; each group grows by the bit that goes best with it."""
    centred = bits - bits.mean(axis=0)
    scale = np.sqrt((centred**2).sum(axis=0))
    scale[scale == 0] = 1
    together = np.abs((centred / scale).T @ (centred / scale))
    left, groups = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: together[b, group].sum())
            left.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def allocate(sample: np.ndarray, rows: int, distance: int) -> tuple[list[list[int]], list[int]]:
    """Partitions of bits and a threshold for each, of the least estimated cost for ``rows`` distinct fingerprints."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1) if len(sample) else np.zeros((1, BITS), dtype=np.uint8)
    rows = max(rows, 1)  # else nothing would cost anything, and a threshold over all bits be chosen
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, len(bits), 200_000) for _ in range(2))
    a, b = a[a != b], b[a != b]
    best = (float("inf"), [], [])
    for m in range(1, distance + 2):
        groups = _correlated(bits, m)
        total = distance - m + 1
        cost = []  # of partition i with threshold t - 1
        for g in groups:
            apart = (bits[:, g][a] != bits[:, g][b]).sum(axis=1)
            share = [((apart <= t).sum() + 0.5) / (len(apart) + 1) for t in range(total + m)]
            # where the sample has no such pair, what independent bits would give bounds it from below
            share = [max(s if s * (len(apart) + 1) > 1 else 0, sum(_choose(len(g), j) for j in range(t + 1)) / 2 ** len(g)) for t, s in enumerate(share)]
            cost.append([0.0] + [rows * _choose(len(g), t) * ROW_COST + rows * rows / 2 * share[t] * PAIR_COST for t in range(total + m)])
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by sum of thresholds + 1 so far
        for c in cost:
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (x, ts) in reach.items():
                for t1 in range(min(len(c), total + m - s + 1)):
                    if s + t1 not in new or x + c[t1] < new[s + t1][0]:
                        new[s + t1] = (x + c[t1], [*ts, t1 - 1])
            reach = new
        x, ts = reach[total + m]
        if x < best[0]:
            best = (x, groups, ts)
    return best[1], best[2]


def _masks(groups: list[list[int]], thresholds: list[int]) -> list[int]:
    """For each probe key the bits that it keeps, as a signed integer; bit position 0 is the highest."""
    out = []
    for g, t in zip(groups, thresholds, strict=True):
        if t < 0:
            continue
        whole = sum(1 << (63 - p) for p in g)
        for masked in combinations(g, min(t, len(g))):
            keep = whole & ~sum(1 << (63 - p) for p in masked)
            out.append(keep - (1 << 64) if keep >> 63 else keep)
    return out


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def spanning_links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join all of ``fps`` (distinct, unsigned) which are connected by at most ``distance`` bits."""
    out = []
    left = fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _popcount(left ^ x) <= distance
            if near.any():
                found, left = left[near], left[~near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
    return out


def nearest_links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Of the links of ``fps`` those of a shortest spanning forest, and for each member those to its NEAR nearest.

    For links that are verified by something else: what is alike is near, so if a link is refused, others remain. The
    number of links grows as that of the members, though all pairs are looked at, a block of rows at a time.
    """
    fps = np.sort(fps)
    rows = max(1, 2_000_000 // len(fps))
    linked = np.zeros(len(fps), dtype=bool)
    for at in range(0, len(fps), rows):
        near = _popcount(fps[at : at + rows, None] ^ fps[None, at:]) <= distance
        near[np.arange(len(near)), np.arange(len(near))] = False
        linked[at : at + rows] |= near.any(axis=1)
        linked[at:] |= near.any(axis=0)
    fps = fps[linked]
    if len(fps) < 2:
        return []
    out = set()
    rows = max(1, 2_000_000 // len(fps))
    for at in range(0, len(fps), rows):
        apart = _popcount(fps[at : at + rows, None] ^ fps[None, :]).astype(np.int16)
        apart[np.arange(len(apart)), at + np.arange(len(apart))] = BITS + 1
        order = np.argsort(apart, axis=1, kind="stable")[:, :NEAR]
        for i, js in enumerate(order):
            out |= {(int(fps[at + i]), int(fps[j])) for j in js if apart[i, j] <= distance}
    x, left = fps[0], fps[1:]
    best, of = np.full(len(left), BITS + 1, dtype=np.int16), np.zeros(len(left), dtype=np.uint64)
    while len(left):
        apart = _popcount(left ^ x).astype(np.int16)
        closer = apart < best
        best[closer], of[closer] = apart[closer], x
        i = int(best.argmin())
        x = left[i]
        if best[i] <= distance:
            out.add((int(of[i]), int(x)))
        left, best, of = np.delete(left, i), np.delete(best, i), np.delete(of, i)
    return list(out)


def links(distinct: DataFrame, distance: int = 3, *, join: Callable[[np.ndarray, int], list[tuple[int, int]]] = spanning_links) -> DataFrame:
    """(a, b): links among the distinct values of column fp that span their connected components.

    ``join`` finds the links of the fingerprints under one key.
    """
    spark = distinct.sparkSession
    rows = distinct.count()
    if rows < 2:
        return spark.createDataFrame([], "a long, b long")
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    groups, thresholds = allocate(sample, rows, distance)
    masks = _masks(groups, thresholds)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows * len(masks) // 2_000_000)
    probes = distinct.select(F.explode(F.array(*(F.lit(k).cast("short") for k in range(len(masks))))).alias("mask"), "fp")
    key = F.col("fp").bitwiseAND(F.element_at(F.array(*(F.lit(m).cast("long") for m in masks)), F.col("mask") + 1))  # made again after the shuffle
    dealt = probes.repartition(n, "mask", key).select("mask", key.alias("key"), "fp").sortWithinPartitions("mask", "key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        of = None

        def flush() -> list[tuple[int, int]]:
            return join(np.unique(np.concatenate(held)), distance) if held and sum(map(len, held)) > 1 else []

        for batch in batches:
            if not batch.num_rows:
                continue
            mask, key = (np.asarray(batch.column(i)).astype(np.int64) for i in range(2))
            fp = np.asarray(batch.column(2)).view(np.uint64)
            starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            ends = np.r_[starts[1:], len(key)]
            found: list[tuple[int, int]] = []
            if (int(mask[0]), int(key[0])) == of:
                held.append(fp[: ends[0]])
            else:
                found += flush()
                held, of = [fp[: ends[0]]], (int(mask[0]), int(key[0]))
            if len(starts) > 1:
                found += flush()
                sizes = (ends - starts)[1:-1]
                two = starts[1:-1][sizes == 2]  # most groups are pairs
                near = _popcount(fp[two] ^ fp[two + 1]) <= distance
                found += [(int(x), int(y)) for x, y in zip(fp[two][near], fp[two + 1][near], strict=True)]
                for s, e in zip(starts[1:-1][sizes > 2], ends[1:-1][sizes > 2], strict=True):
                    found += join(fp[s:e], distance)
                held, of = [fp[starts[-1] :]], (int(mask[starts[-1]]), int(key[starts[-1]]))
            if found:
                yield _pairs(found)
        if last := flush() if held else []:
            yield _pairs(last)

    return map_arrow(dealt, verify, "a long, b long").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, dtype=np.uint64).view(np.int64).reshape(-1, 2)
    both.sort(axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """(``id_col``, fp, component_id): each row of ``docs`` with the smallest id it reaches over links."""
    prints = cut_lineage(fingerprints(docs, id_col=id_col, text_col=text_col, words=words))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = connected(links(distinct.select("fp"), distance))
    labelled = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of = labelled.join(ids, "root").select("fp", "component_id")
    return prints.join(of, "fp").select(id_col, "fp", "component_id")


def _mark(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def fingerprint_labels(nodes: DataFrame, distance: int) -> DataFrame:
    """(node, one, two): the least node met under any of the bands, or where none is that of a like fingerprint; and the
    least under half of the bands.

    Fingerprints join in small groups what is nearest. Texts that share a passage, and no more, are many and hardly near;
    by bands they come to few groups, and what asks for the passage meets those and not each text.
    """
    first = cut_lineage(nodes.groupBy(F.col("also").alias("fp")).agg(F.min("node").alias("node"), F.count("*").alias("n")))
    near = cut_lineage(links(first.select("fp"), distance, join=nearest_links))
    ends = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = ends.join(first.select(F.col("fp").alias("b"), "node"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("node").alias("near"))
    of = first.join(best, "fp", "left").filter("near is not null or n > 1").select("fp", F.least("node", "near").alias("one"))
    bands = jaccard_join.band_labels(nodes).select("node", F.least("one", "two").alias("met"), "two")
    return nodes.select("node", F.col("also").alias("fp")).join(of, "fp", "left").join(bands, "node", "left").select("node", F.coalesce("met", "one").alias("one"), "two")


def grouped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = 12, words: int = 5, least: float = 0.8) -> DataFrame:
    """(id, mark, root, group_id) of every row with an id: that, its text's digest, its group, the smallest id in the group.

    A link is a pair whose sets of shingles of ``words`` words have a Jaccard likeness of ``least`` or more; all such
    pairs count. Min-hash bands and, for what meets none, fingerprints of at most ``distance`` differing bits, found by
    the general pigeonhole, deal texts to groups in which sets are compared; that joins most of what is alike, and might
    miss pairs. What can still be alike
    across groups is found exactly by shared rare shingles and bounds (see ``jaccard_join``). Texts without words are
    alike. Rows are told apart by id and digest, never by an id alone, which rows may share.
    """

    def signed(text: str) -> int:
        f = fingerprint(text)
        return f - (1 << 64) if f >> 63 else f

    rows = docs.filter(F.col(id_col).cast("long").isNotNull())
    found = jaccard_join.join(rows, id_col=id_col, text_col=text_col, words=words, least=least, labels=lambda nodes: fingerprint_labels(nodes, distance), also=signed)
    found = cut_lineage(found.select("id", "mark", F.coalesce("root", F.lit(-1)).alias("root")))
    return found.join(found.groupBy("root").agg(F.min("id").alias("group_id")), "root").select("id", "mark", "root", "group_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(``id_col``, group_id) of every row with an id: the smallest id that it reaches over links of ``grouped``."""
    return grouped(docs, id_col=id_col, text_col=text_col, **how).select(F.col("id").alias(id_col), "group_id")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: of the smallest id, then of the smallest digest.

    Rows are told apart by id and text together, so rows that share an id and not a text are judged each by its own
    text. Rows that repeat an id and a text become one. Rows without an id stay as they are.
    """
    rows = cut_lineage(grouped(docs, id_col=id_col, text_col=text_col, **how).groupBy("root", "id", "mark").agg(F.count("*").alias("n")))
    kept = rows.groupBy("root").agg(F.min(F.struct("id", "mark")).alias("x"))
    stays = (F.col("id") == F.col("x.id")) & (F.col("mark") == F.col("x.mark"))
    key, mark = _free(docs, "_id"), _free(docs, "_mark")
    gone = cut_lineage(rows.join(kept, "root").select(F.col("id").alias(key), F.col("mark").alias(mark), stays.alias("stays"), "n").filter("not stays or n > 1"))
    own = (F.col(key) == docs[id_col].cast("long")) & (F.col(mark) == _mark(text_col))
    n, repeated = gone.agg(F.count("*"), F.count_if("stays")).first()
    small = F.broadcast if n <= BROADCAST_ROWS else lambda df: df
    once = docs.join(small(gone.select(key, mark)), own, "left_anti").select(*docs.columns)
    if not repeated:
        return once
    several = docs.join(small(gone.filter("stays").select(key, mark)), own, "left_semi").withColumn(mark, _mark(text_col))
    return once.unionByName(several.dropDuplicates([id_col, mark]).select(*docs.columns))


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has."""
    while name in docs.columns:
        name += "_"
    return name
