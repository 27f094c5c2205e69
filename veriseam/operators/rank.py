"""Ranking: lexical, sparse and vector search, fusion, re-scoring and cuts. Everything is batched over a query id.

Ranked lists are rows (query, item, rank, score); ranks start at 1, every order has a total tie rule.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import TOKEN, tokens
from ..session import map_arrow, spread

#: Queries that one pass over the stored rows answers.
QUERY_BLOCK = 4096
#: Scores of vectors that one call makes.
CELLS = 1 << 19
_TOKEN = re.compile(TOKEN.encode())


def top(rows: DataFrame, by: list[str], order: list[Column], k: int, *, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def query_terms(queries: DataFrame, qid: str, text: Column) -> DataFrame:
    """(qid, term, qtf); a repeated term counts each time."""
    return queries.select(qid, F.explode(tokens(text)).alias("term")).groupBy(qid, "term").agg(F.count("*").alias("qtf"))


def bm25(docs: DataFrame, queries: DataFrame, *, did: str, dtext: Column, qid: str, qtext: Column, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, did, score, rank): the k best documents of each query; ties by id descending, zero scores dropped.

    The queries are a stated set: their terms go to the executors, in blocks of QUERY_BLOCK queries with a pass over the
    documents each, after one pass that counts document frequencies and lengths over all documents. A batch of documents
    is scored against a block at once; a task passes on only what is at or above the k-th best score it has seen for a
    query, so what is shuffled grows with tasks, not with documents, and no pair of a common word leaves the scan.
    """
    stored = spread(docs.select(did, F.coalesce(dtext, F.lit("")).alias("text")))
    qt = query_terms(queries, qid, qtext).toArrow()
    vocabulary = _vocabulary(qt)
    n, avgdl, df = _document_frequencies(stored.select("text"), vocabulary)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    weights = qt.column("qtf").to_numpy() * idf[[vocabulary[t.encode()] for t in qt.column("term").to_pylist()]] if qt.num_rows else np.empty(0)

    def values(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc, term, tf, dl = _counted(texts, vocabulary)
        return doc, term, tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / avgdl)) if len(doc) else tf

    return top(_best_scored(stored, queries, qt, vocabulary, weights, values, did=did, qid=qid, k=k), [qid], [F.round("score", 9).desc(), F.col(did).desc()], k)


def _vocabulary(qt: pa.Table) -> dict[bytes, int]:
    return {t: i for i, t in enumerate(sorted({t.encode() for t in qt.column("term").to_pylist()}))}


def _best_scored(stored: DataFrame, queries: DataFrame, qt: pa.Table, vocabulary: dict[bytes, int], weights: np.ndarray, values: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], *, did: str, qid: str, k: int) -> DataFrame:
    """(qid, did, score): all that can be among the k best of a query, by sums of query weight times document value.

    ``qt`` has the terms of the queries, ``weights`` one for each of its rows; ``values`` gives (document, term, value)
    of the vocabulary's terms in some texts.
    """
    terms = [t.encode() for t in qt.column("term").to_pylist()]
    keys, ids = qt.column(qid).to_pylist(), list(dict.fromkeys(qt.column(qid).to_pylist()))
    place = {q: i for i, q in enumerate(ids)}
    ddl = f"`{qid}` {queries.schema[qid].dataType.simpleString()}, `{did}` {stored.schema[did].dataType.simpleString()}, score double"
    out = None
    for at in range(0, len(ids), QUERY_BLOCK):
        block = range(at, min(len(ids), at + QUERY_BLOCK))
        own = [i for i, q in enumerate(keys) if place[q] in block]
        term, query = np.array([vocabulary[terms[i]] for i in own]), np.array([place[keys[i]] - at for i in own])
        order = np.argsort(term, kind="stable")
        term, query, weight = term[order], query[order], weights[own][order]
        starts = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        names = qt.schema.field(qid).type, ids[at : at + QUERY_BLOCK]

        def run(batches: Iterator[pa.RecordBatch], query=query, weight=weight, starts=starts, names=names) -> Iterator[pa.RecordBatch]:
            size = len(names[1])
            best = np.zeros((size, k))  # the scores of the k best so far
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    rows = part.num_rows
                    doc, t, value = values(part.column(1).to_pylist())
                    size_of = starts[t + 1] - starts[t]
                    at_ = np.arange(size_of.sum()) + np.repeat(starts[t] - np.cumsum(size_of) + size_of, size_of)
                    cell = query[at_] * rows + np.repeat(doc, size_of)
                    scores = np.bincount(cell, weight[at_] * np.repeat(value, size_of), minlength=size * rows).reshape(size, rows)
                    rounded = np.round(scores, 9)
                    best = np.partition(np.concatenate([best, rounded], axis=1), rows, axis=1)[:, rows:]
                    q, d = np.nonzero((scores > 0) & (rounded >= best.min(axis=1)[:, None]))
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array([names[1][i] for i in q], type=names[0]), part.column(0).take(pa.array(d)), pa.array(scores[q, d])], names=[qid, did, "score"])

        part = map_arrow(stored, run, ddl)
        out = part if out is None else out.unionByName(part)
    return stored.sparkSession.createDataFrame([], ddl) if out is None else out


def _counted(texts: list[str], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of the vocabulary's terms, and the number of tokens of every text."""
    size, term, count, length = [], [], [], []
    for text in texts:
        words = _TOKEN.findall(text.encode("utf-8", "surrogatepass").lower())  # bytes.lower changes A-Z only
        length.append(len(words))
        found = Counter(filter(vocabulary.__contains__, words))
        size.append(len(found))
        term += map(vocabulary.__getitem__, found)
        count += found.values()
    doc = np.repeat(np.arange(len(size)), size) if size else np.empty(0, dtype=np.int64)
    return doc, np.array(term, dtype=np.int64), np.array(count, dtype=np.float64), np.array(length, dtype=np.float64)


def _document_frequencies(texts: DataFrame, vocabulary: dict[bytes, int]) -> tuple[float, float, np.ndarray]:
    """The number of texts, their mean length in tokens, and in how many each term of the vocabulary stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary) + 2, dtype=np.int64)  # the last two: texts, tokens
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                _, term, _, length = _counted(batch.slice(lo, 256).column(0).to_pylist(), vocabulary)
                df[:-2] += np.bincount(term, minlength=len(vocabulary))
                df[-2:] += len(length), int(length.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "n"])

    df = np.zeros(len(vocabulary) + 2, dtype=np.int64)
    counts = map_arrow(texts, run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
    return float(df[-2]), max(float(df[-1]), 1.0) / max(float(df[-2]), 1.0), df[:-2]


def sparse_weights(rows: DataFrame, key: str, text: Column, stretch: int = 64) -> DataFrame:
    """(key, term, w): each token weighs 1 / (1 + stretch of the text it is in); the largest weight of a term counts."""
    each = rows.select(key, F.posexplode(tokens(text)).alias("pos", "term"))
    return each.groupBy(key, "term").agg(F.max(1 / (1 + F.floor(F.col("pos") / stretch))).alias("w"))


def sparse_dot(docs: DataFrame, queries: DataFrame, *, did: str, dtext: Column, qid: str, qtext: Column, k: int) -> DataFrame:
    """(qid, did, score, rank) by the dot product of sparse weights over shared terms; ties by id.

    Like ``bm25`` one pass over the documents for each block of queries: no pair of a common word leaves the scan.
    """
    stored = spread(docs.select(did, F.coalesce(dtext, F.lit("")).alias("text")))
    qt = sparse_weights(queries, qid, qtext).toArrow()
    vocabulary = _vocabulary(qt)
    scored = _best_scored(stored, queries, qt, vocabulary, qt.column("w").to_numpy(), lambda texts: _placed(texts, vocabulary), did=did, qid=qid, k=k)
    return top(scored, [qid], [F.round("score", 9).desc(), F.col(did).asc()], k)


def _placed(texts: list[str], vocabulary: dict[bytes, int], stretch: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, weight) of the vocabulary's terms, by the stretch of the text that each first stands in."""
    size, term, first = [], [], []
    for text in texts:
        words = _TOKEN.findall(text.encode("utf-8", "surrogatepass").lower())
        found = {w: i for w, i in zip(reversed(words), range(len(words) - 1, -1, -1), strict=True) if w in vocabulary}
        size.append(len(found))
        term += map(vocabulary.__getitem__, found)
        first += found.values()
    doc = np.repeat(np.arange(len(size)), size) if size else np.empty(0, dtype=np.int64)
    return doc, np.array(term, dtype=np.int64), 1 / (1 + np.array(first, dtype=np.int64) // stretch)


def search_vectors(vectors: DataFrame, queries: DataFrame, *, key: str, vector: str, k: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(query, item, score, rank): for every query vector the k stored ones of the highest score; ties by item.

    Query vectors go to the executors in blocks of QUERY_BLOCK, a pass over the stored vectors each; as many stored
    vectors as make CELLS scores are scored against a block by one numpy call, and a task passes on its k best a query.
    ``score`` gets a block (q, d) and some stored vectors (n, d) and returns (q, n).
    """
    q = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    stored = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    out = None
    for block in range(blocks):
        rows = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)).orderBy("id").collect()
        if not rows:
            continue
        ids, block_vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

        def run(batches: Iterator[pa.RecordBatch], ids=ids, block_vectors=block_vectors) -> Iterator[pa.RecordBatch]:
            size, least = len(ids), np.full(len(ids), -np.inf)  # the k-th best score of each query so far
            kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]

            def cut() -> None:
                query, item, s = (np.concatenate(x) for x in zip(*kept, strict=True))
                order = np.lexsort((item, -s, query))
                query, item, s = query[order], item[order], s[order]
                at = np.arange(len(query)) - np.searchsorted(query, query)
                least[query[at == k - 1]] = s[at == k - 1]
                kept[:] = [(query[at < k], item[at < k], s[at < k])]

            for batch in batches:
                items = np.asarray(batch.column(0))
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(items), -1) if len(items) else None
                step = max(1, CELLS // size)
                for lo in range(0, len(items), step):
                    s = np.round(score(block_vectors, flat[lo : lo + step]), 9)
                    query, row = np.nonzero(~(s < least[:, None]))
                    kept.append((query, items[lo + row], s[query, row]))
                    if sum(len(x[0]) for x in kept) > 2 * size * k + CELLS // 4:
                        cut()
            cut()
            query, item, s = kept[0]
            if len(query):
                yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(item), pa.array(s)], names=["query", "item", "score"])

        part = map_arrow(stored, run, "query long, item long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = stored.sparkSession.createDataFrame([], "query long, item long, score double")
    return top(out, ["query"], [F.col("score").desc(), F.col("item").asc()], k)


def rrf(lists: list[DataFrame], *, qid: str, item: str, k: int, constant: int = 60, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists; ties go to the earlier list, then the better rank in it."""
    all_ = None
    for i, ranked in enumerate(lists):
        w = (weights or [1.0] * len(lists))[i]
        part = ranked.select(qid, item, (F.lit(float(w)) / (constant + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("list"), F.col("rank").alias("at")).alias("first"))
        all_ = part if all_ is None else all_.unionByName(part)
    fused = all_.groupBy(qid, item).agg(F.sum("part").alias("score"), F.min("first").alias("first"))
    return top(fused, [qid], [F.round("score", 12).desc(), F.col("first").asc()], k).drop("first")


def tfidf_sections(docs: DataFrame, queries: DataFrame, *, section: str, dtext: Column, qid: str, qtext: Column, k: int, min_df: int = 2) -> DataFrame:
    """(qid, section, score, rank): cosine of TF-IDF vectors of whole sections and queries; sublinear tf, smooth idf."""
    tf = docs.filter(F.col(section).isNotNull()).select(section, F.explode(tokens(dtext)).alias("term")).groupBy(section, "term").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count_distinct(section).cast("double").alias("n"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    d = tf.join(idf, "term").select(section, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    dn = d.groupBy(section).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = query_terms(queries, qid, qtext).join(idf, "term").select(qid, "term", ((1 + F.log("qtf")) * F.col("idf")).alias("qw"))
    qn = q.groupBy(qid).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dot = d.join(q, "term").groupBy(qid, section).agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    scored = dot.join(dn, section).join(qn, qid).select(qid, section, (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))
    return top(scored, [qid], [F.round("score", 9).desc(), F.col(section).asc()], k)


def reserve_slots(main: DataFrame, extra: DataFrame, *, qid: str, item: str, k: int, slots: int) -> DataFrame:
    """k places of which at least min(slots, k // 2, what extra has) go to items of ``extra`` that ``main`` lacks.

    Whichever side is short is filled from the other.
    """
    fresh = extra.join(main.select(qid, item), [qid, item], "left_anti").withColumn("side", F.lit(1))
    fresh = fresh.withColumn("place", F.row_number().over(W.partitionBy(qid).orderBy("rank", item)))
    old = main.withColumn("side", F.lit(0)).withColumn("place", F.row_number().over(W.partitionBy(qid).orderBy("rank", item)))
    both = old.select(qid, item, "side", "place").unionByName(fresh.select(qid, item, "side", "place"))
    n = lambda side: F.count_if(F.col("side") == side).over(W.partitionBy(qid))
    reserved = F.least(F.lit(min(slots, k // 2)), n(1))
    share0 = F.least(n(0), F.lit(k) - reserved)
    limit = F.when(F.col("side") == 0, share0).otherwise(F.least(n(1), F.lit(k) - share0))
    kept = both.withColumn("limit", limit).filter("place <= limit")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy(qid).orderBy("side", "place"))).select(qid, item, "side", "rank")


def round_robin(rows: DataFrame, *, by: list[str], group: str, order: list[Column], group_order: list[Column], room: int) -> DataFrame:
    """``room`` rows for each ``by``: the first of every group in turn, then the second, and so on."""
    deep = rows.withColumn("depth", F.row_number().over(W.partitionBy(*by, group).orderBy(*order)))
    # a group can't fill more than the room, so the deep ends of hot groups go before rows of a ``by`` meet
    return top(deep.filter(F.col("depth") <= room), by, [F.col("depth"), *group_order], room, rank="turn")


def take_turns(first: DataFrame, second: DataFrame, *, qid: str, item: str, want: int) -> DataFrame:
    """Two rankings in turns, the first begins; taken items are skipped, an exhausted list yields its turns.

    An item's turn in the merged order follows from both ranks alone: the list that reaches it first takes it.
    """
    cut = lambda r, side: r.filter(F.col("rank") <= 2 * want).select(qid, F.struct("rank", F.lit(side).alias("side"), F.col(item).alias("item")).alias("x"))
    lists = cut(first, 0).unionByName(cut(second, 1)).groupBy(qid).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    item_type = first.schema[item].dataType.simpleString()
    one = lambda side: F.transform(F.filter("xs", lambda x: x["side"] == side), lambda x: x["item"])
    state = lists.select(qid, one(0).alias("a"), one(1).alias("b"))
    rest = lambda xs, taken: F.filter(xs, lambda x: ~F.array_contains(taken, x))

    def step(acc: Column, turn: Column) -> Column:
        mine, other = F.when(turn % 2 == 0, F.col("a")).otherwise(F.col("b")), F.when(turn % 2 == 0, F.col("b")).otherwise(F.col("a"))
        left, right = rest(mine, acc), rest(other, acc)
        return F.when(F.size(left) > 0, F.concat(acc, F.slice(left, 1, 1))).when(F.size(right) > 0, F.concat(acc, F.slice(right, 1, 1))).otherwise(acc)

    taken = F.aggregate(F.sequence(F.lit(0), F.lit(want - 1)), F.expr(f"cast(array() as array<{item_type}>)"), step)
    return state.select(qid, F.posexplode(taken).alias("pos", item)).select(qid, item, (F.col("pos") + 1).alias("rank"))
