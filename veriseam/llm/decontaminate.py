"""Benchmark decontamination: a BM25 index of test items, asked by every passage of every document.

Items are the indexed documents, sorted into shards of like length and in each into blocks of BLOCK; a term's postings
are runs, one for each block that has it, of which the largest weight is known, and so is that of the whole list. A
passage is a window of words, twice as long as the longest item and half overlapping, so every place of an item lies
whole in one. All items whose BM25 score for a passage reaches THRESHOLD of the score of the item for itself are
retrieved; weights are divided by each item's threshold, so the bar is 1 for all.

The search is block-max WAND, for a batch of windows at a time. Of a window's terms the longest lists are set aside
while their list maxima add up to less than ASIDE of the bar. The cursors of the others go over their blocks; a block is
a pivot if the block maxima of the cursors that stop there, and what the lists set aside can add, reach the bar. Lists
set aside are sought in pivots only (or walked, where that is less work than seeking them in each); of these, the ones
whose block maxima still reach the bar are scored in full. So the lists of common words, which grow with the number of
items, are rarely walked, and most blocks never scored.

What is retrieved is verified on the words: of the item's question (its first two thirds) and answer (the rest) at
least OVERLAP of the five-word shingles each must stand in the passage; a part of fewer words is one shingle.

Letters are lower-cased; words are runs of a-z, 0-9 and all characters beyond ASCII. Null or empty texts hold nothing,
items of null or empty text match nothing; of items that repeat, each id counts, a null id too. The items are a stated
query set: they are held in chunks of CHUNK items, each asked in a pass of its own, with statistics over all items; the
driver holds the words of one chunk and the document counts of the items' words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_rows

WORDS, OVERLAP, THRESHOLD = 5, 0.5, 0.5
K1, B = 1.2, 0.75
BLOCK, CHUNK = 8, 32_768
#: Share of the bar that lists set aside may add up to, and the largest ratio of the bars in a shard.
ASIDE, RATIO = 0.25, 1.5
#: Stops of cursors, and windows times blocks, that a step of the search holds at a time.
ROOM, CELLS = 500_000, 2_000_000
_NOT_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_NOT_WORD).split()


def _shingles(words: list[bytes]) -> set[bytes]:
    n = min(WORDS, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of several ranges, one after the other."""
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _parts(ends: np.ndarray, room: int) -> Iterator[tuple[int, int]]:
    """Ranges of groups whose running totals are ``ends``, each within ``room`` or a single group."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + room, side="right")))
        yield lo, hi
        lo = hi


class Shard:
    """BM25 postings of items from ``base`` on; (item, term, weight) by item."""

    def __init__(self, base: int, item: np.ndarray, term: np.ndarray, weight: np.ndarray, n_items: int, n_terms: int):
        self.base, self.blocks = base, -(-n_items // BLOCK)
        by = np.lexsort((item, term))
        term, self.item, self.weight = term[by], item[by].astype(np.int32), weight[by].astype(np.float32)
        run = term * self.blocks + self.item // BLOCK
        self.starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        self.ends = np.r_[self.starts[1:], len(run)]
        self.runs = run[self.starts]  # term * blocks + block, ascending
        self.block = (self.runs % self.blocks).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, self.starts)
        self.first = np.searchsorted(self.runs // self.blocks, np.arange(n_terms + 1))
        self.list_most = np.zeros(n_terms, dtype=np.float32)
        has = self.first[1:] > self.first[:-1]
        self.list_most[has] = np.maximum.reduceat(self.most, self.first[:-1][has])

    def retrieve(self, window: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(window, item, score in bars) of all items at the bar; ``window`` ascends, the terms of one are distinct."""
        has = self.first[term + 1] > self.first[term]
        window, term = window[has], term[has]
        if not len(term):
            return
        starts = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        sizes = np.diff(np.r_[starts, len(term)])
        names, own = window[starts], np.repeat(np.arange(len(starts)), sizes)
        length, most = self.first[term + 1] - self.first[term], self.list_most[term].astype(np.float64)
        able = np.bincount(own, most, minlength=len(starts)) >= 1 - 1e-4  # windows whose lists can reach the bar at all
        by = np.lexsort((-length, own))
        total = np.cumsum(most[by])
        upto = total - np.repeat(total[starts] - most[by][starts], sizes)  # of a window's lists, the longest first
        aside = np.zeros(len(term), dtype=bool)
        aside[by] = upto < ASIDE
        rest = np.bincount(own[aside], most[aside], minlength=len(starts))  # what lists set aside can add
        walked = np.flatnonzero(~aside & able[own])
        if not len(walked):
            return
        w, t, n = own[walked], term[walked], length[walked]
        change = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        stops = np.cumsum(np.maximum(np.add.reduceat(n, change), ROOM * self.blocks // CELLS))
        ends = np.r_[starts[1:], len(term)]
        for lo, hi in _parts(stops, ROOM):
            s, e = change[lo], change[hi] if hi < len(change) else len(w)
            windows = w[change[lo:hi]]
            runs = _ranges(self.first[t[s:e]], self.first[t[s:e] + 1])
            cell = np.repeat(np.searchsorted(windows, w[s:e]) * self.blocks, n[s:e]) + self.block[runs]
            bound = np.bincount(cell, self.most[runs], minlength=len(windows) * self.blocks).reshape(len(windows), -1)
            pivot = np.flatnonzero((bound + rest[windows][:, None] >= 1 - 1e-4).ravel())
            of, block = windows[pivot // self.blocks], pivot % self.blocks
            # a window with many pivots has all its lists walked once more, the others' lists are sought in each pivot
            pivots, whole = np.bincount(of, minlength=len(starts)), np.add.reduceat(length, starts)
            walk = pivots * sizes > whole
            for seek in (True, False):
                mine = walk[of] != seek
                part_of, part_block = of[mine], block[mine]
                cost = np.cumsum(sizes[part_of] if seek else (whole / np.maximum(pivots, 1))[part_of])
                for a, b in _parts(cost, ROOM):
                    found = self._sought if seek else self._walked
                    pair, run = found(part_of[a:b], part_block[a:b], starts, ends, term)
                    for i, k, score in self._scored(pair, run, part_of[a:b], part_block[a:b]):
                        yield int(names[i]), k, score

    def _sought(self, of: np.ndarray, block: np.ndarray, starts: np.ndarray, ends: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pivot, run) for each term of a pivot's window that has a run in its block, by search."""
        pair = np.repeat(np.arange(len(of)), ends[of] - starts[of])
        want = term[_ranges(starts[of], ends[of])] * self.blocks + block[pair]
        run = np.minimum(np.searchsorted(self.runs, want), len(self.runs) - 1)
        there = self.runs[run] == want
        return pair[there], run[there]

    def _walked(self, of: np.ndarray, block: np.ndarray, starts: np.ndarray, ends: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by a walk over all lists of the pivots' windows."""
        windows = np.unique(of)
        place = np.full((len(windows), self.blocks), -1, dtype=np.int32)
        place[np.searchsorted(windows, of), block] = np.arange(len(of))
        t = term[_ranges(starts[windows], ends[windows])]
        n = self.first[t + 1] - self.first[t]
        run = _ranges(self.first[t], self.first[t + 1])
        pair = place[np.repeat(np.repeat(np.arange(len(windows)), ends[windows] - starts[windows]), n), self.block[run]]
        return pair[pair >= 0], run[pair >= 0]

    def _scored(self, pair: np.ndarray, run: np.ndarray, of: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(window, item, score) at the bar in pivots whose block maxima reach it by all terms."""
        able = np.bincount(pair, self.most[run], minlength=len(of)) >= 1 - 1e-4
        pair, run = pair[able[pair]], run[able[pair]]
        postings = _ranges(self.starts[run], self.ends[run])
        slot = np.repeat(pair.astype(np.int64) * BLOCK, self.ends[run] - self.starts[run]) + self.item[postings] % BLOCK
        score = np.bincount(slot, self.weight[postings], minlength=len(of) * BLOCK)
        for k in np.flatnonzero(score >= 1 - 1e-4):
            yield of[k // BLOCK], self.base + int(block[k // BLOCK]) * BLOCK + int(k % BLOCK), float(score[k])


class Index:
    """BM25 index of one chunk of items."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], df: dict[bytes, int], n_items: int, mean: float, longest: int):
        items = sorted(items, key=lambda x: (x[1], x[0] is not None, x[0] or 0))
        weights = [{w: np.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(ws) / mean)) for w, c in Counter(ws).items()} for _, ws in items]
        bars = [THRESHOLD * sum(weight.values()) for weight in weights]
        lowest = max(min(bars), 1e-9)
        shard = [int(np.log(max(bar, 1e-9) / lowest) / np.log(RATIO)) for bar in bars]
        order = sorted(range(len(items)), key=lambda i: shard[i])
        self.ids = [items[i][0] for i in order]
        self.items = [b" ".join(items[i][1]) for i in order]
        self.step = max(32, longest)
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.shards, base = [], 0
        for _, group in groupby(order, key=lambda i: shard[i]):
            held = list(group)
            postings = [(k, self.vocabulary[w], x / bars[i]) for k, i in enumerate(held) for w, x in weights[i].items()]
            item, term, weight = (np.array(c, dtype=d) for c, d in zip(zip(*postings, strict=True), (np.int64, np.int64, np.float64), strict=True))
            self.shards.append(Shard(base, item, term, weight, len(held), len(self.vocabulary)))
            base += len(held)
        self.cached: dict[int, tuple[set[bytes], set[bytes]]] = {}

    def parts(self, k: int) -> tuple[set[bytes], set[bytes]]:
        """Shingles of an item's question and answer."""
        if k not in self.cached:
            if len(self.cached) > 4096:
                self.cached.clear()
            ws = self.items[k].split()
            cut = -(-2 * len(ws) // 3)
            self.cached[k] = _shingles(ws[:cut]), _shingles(ws[cut:])
        return self.cached[k]

    def search(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float]]]:
        """For each text the items (by place) that it holds: score, question overlap, answer overlap."""
        out: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
        get, step = self.vocabulary.get, self.step
        all_words = [words_of(t) for t in texts]
        terms = [np.fromiter((get(w, -1) for w in ws), dtype=np.int64, count=len(ws)) for ws in all_words]
        # The distinct known terms of each window: a word in the h-th stretch of ``step`` words is in windows h - 1 and h.
        sizes = np.array([len(t) for t in terms])
        windows = np.maximum(1, -(-sizes // step) - 1)
        first = np.cumsum(np.r_[0, windows])
        every = np.concatenate(terms) if terms else np.empty(0, dtype=np.int64)
        doc = np.repeat(np.arange(len(terms)), sizes)
        stretch = (np.arange(len(every)) - np.repeat(np.cumsum(np.r_[0, sizes[:-1]]), sizes)) // step
        known = every >= 0
        doc, stretch, every = doc[known], stretch[known], every[known]
        width = len(self.vocabulary)
        both = []
        for w in (stretch - 1, stretch):
            is_window = (w >= 0) & (w < windows[doc])
            both.append((first[doc] + w)[is_window] * width + every[is_window])
        keys = np.concatenate(both)
        keys.sort()
        keys = keys[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])] if len(keys) else keys
        if not len(keys):
            return out
        window, term = keys // width, keys % width
        last, by_size = -1, {}
        for i, k, score in (hit for shard in self.shards for hit in shard.retrieve(window, term)):
            if i != last:
                last, by_size = i, {}
                d = int(np.searchsorted(first, i, side="right")) - 1
                j = i - int(first[d])
                ws = all_words[d][j * step : (j + 2) * step]
            overlaps = []
            for shingles in self.parts(k):
                size = next(iter(shingles)).count(b" ") + 1 if shingles else 0
                if size and size not in by_size:
                    by_size[size] = {b" ".join(ws[x : x + size]) for x in range(len(ws) - size + 1)}
                overlaps.append(len(shingles & by_size[size]) / len(shingles) if size else 1.0)
            if min(overlaps) >= OVERLAP:
                out[d][k] = max(out[d].get(k, (0.0, 0.0, 0.0)), (min(1.0, score * THRESHOLD), *overlaps))
        return out


def indexes(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The index of all items, CHUNK or so at a time; the driver reads the items twice, and holds one chunk in memory."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    n = rows.count()
    df: Counter[bytes] = Counter()
    full = total = longest = 0
    for r in rows.toLocalIterator():
        ws = words_of(r["text"])
        df.update(set(ws))
        full, total, longest = full + bool(ws), total + len(ws), max(longest, len(ws))
    chunks = max(1, -(-n // CHUNK))
    of = F.pmod(F.xxhash64("id", "text"), F.lit(chunks))
    for c in range(chunks):
        part = [(r["id"], words_of(r["text"])) for r in (rows if chunks == 1 else rows.filter(of == c)).collect()]
        if part := [p for p in part if p[1]]:
            yield Index(part, df, full, total / full, longest)


def find(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item that it holds: ``id_col``, ``item_col``, score, question_overlap, answer_overlap."""
    schema = pa.schema([(id_col, pa.int64()), (item_col, pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    ddl = f"`{id_col}` long, `{item_col}` long, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    made = None
    for index in indexes(items, id_col=item_col, text_col=item_text_col):

        def start(index=index):
            def step(keys, texts):
                hits = [(key, index.ids[k], *x) for key, found in zip(keys, index.search(texts), strict=True) for k, x in sorted(found.items())]
                return [list(c) for c in zip(*hits, strict=True)] if hits else [[]] * len(schema)

            return step

        part = map_rows(rows, [id_col, text_col], start, schema, ddl)
        made = part if made is None else made.unionByName(part)
    return made if made is not None else docs.sparkSession.createDataFrame([], ddl)


def remove(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item."""
    for index in indexes(items, id_col=item_col, text_col=item_text_col):
        docs = keep_rows(docs, text_col, lambda index=index: lambda texts: [not found for found in index.search(texts)])
    return docs
