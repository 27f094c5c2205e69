"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

At most PER_CLASS training documents of each label are examples (see ``sampling``). Terms are all words (runs of
letters, lower-cased) of all examples; a vector holds (1 + log count) * idf * (1 + G) for each, where G is the
log-likelihood ratio of the term's document counts in toxic and other examples (supervised term weighting), which is
small for words that say nothing. Examples are an inverted index in blocks: for each term and block the largest weight
is known, blocks are visited by their upper bounds, a few at a time, and those that can't reach the k-th best cosine are
passed over, which leaves the k nearest exact.

Votes of the k nearest are weighted by the square of the cosine and by how many labelled rows each example stands for,
with a prior of PRIOR votes by the share of toxic labels; that makes the score an estimate of the share of toxic rows
among rows like this one. The ids of the nearest examples are the evidence.

Null and empty texts and those without a known word get the prior; without labels every score is 0. Repeated rows stay,
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_rows
from .sampling import held_out, labelled_sample

PER_CLASS = 2048
NEAREST, BLOCK, PRIOR = 15, 64, 0.25
#: Terms of at least this share of the examples are kept as rows of a matrix, not as postings.
COMMON = 1 / 24
_WORD = re.compile(r"[^\W\d_]+")


def counted(text: str | None) -> Counter[str]:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def log_likelihood_ratio(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Dunning's G of terms that stand in a of n_a and b of n_b documents."""

    def part(k: np.ndarray, n: int, p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / (n * p)), 0.0) + np.where(n - k > 0, (n - k) * np.log((n - k) / (n * (1 - p))), 0.0)

    if not n_a or not n_b:
        return np.zeros(len(a))
    p = (a + b) / (n_a + n_b)
    return 2 * np.maximum(0.0, part(a, n_a, p) + part(b, n_b, p))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of several ranges, one after the other."""
    sizes = ends - starts
    return np.arange(sizes.sum(), dtype=np.int32) + np.repeat((starts - np.cumsum(sizes) + sizes).astype(np.int32), sizes)


class Model:
    def __init__(self, sample: list[tuple], totals: dict[int, int]):
        """sample: (toxic, text, id); totals: labelled training rows of each class."""
        toxic = np.array([int(s[0]) for s in sample], dtype=np.int64)
        n = [int((toxic == 0).sum()), int((toxic == 1).sum())]
        self.share = [totals.get(c, 0) / max(n[c], 1) for c in (0, 1)]
        self.prior = totals.get(1, 0) / max(1, sum(totals.values()))
        place: dict[str, int] = {}
        terms, times, of = [], [], []
        for r, (_, text, _) in enumerate(sample):
            found = counted(text)
            terms += [place.setdefault(w, len(place)) for w in found]
            times += found.values()
            of += [r] * len(found)
        self.terms = list(place)
        term, row = np.array(terms, dtype=np.int64), np.array(of, dtype=np.int64)
        df = [np.bincount(term[toxic[row] == c], minlength=len(place)) for c in (0, 1)]
        self.weight = (np.log((1 + len(sample)) / (1 + df[0] + df[1])) + 1) * (1 + log_likelihood_ratio(df[1], df[0], n[1], n[0]))
        value = (1 + np.log(np.array(times, dtype=np.float64))) * self.weight[term]
        value /= np.sqrt(np.bincount(row, value**2, minlength=len(sample)))[row]
        # like examples share blocks: they are ordered by the term that weighs most in them
        heaviest = np.zeros(len(sample), dtype=np.int64)
        by = np.lexsort((value, row))
        heaviest[row[by]] = term[by]
        has = np.zeros(len(sample), dtype=bool)
        has[row] = True
        order = np.lexsort((np.arange(len(sample)), heaviest, ~has))[: int(has.sum())]
        rank = np.zeros(len(sample), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.y, self.ids = toxic[order], [sample[i][2] for i in order]
        self.blocks = -(-len(order) // BLOCK)
        # common terms: a matrix by term and example, whose dot product is made in one go and bounds a block exactly
        often = np.flatnonzero(df[0] + df[1] >= max(1, COMMON * len(order)))
        self.common = np.full(len(place), -1, dtype=np.int32)
        self.common[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), self.blocks * BLOCK))
        of, at = self.common[term], rank[row]
        self.matrix[of[of >= 0], at[of >= 0]] = value[of >= 0]
        # postings of the others by term and example
        rare = np.flatnonzero(of < 0)
        by = rare[np.lexsort((at[rare], term[rare]))]
        self.rows, self.values, self.postings = at[by].astype(np.int32), value[by], np.bincount(term[by], minlength=len(place)).astype(np.int32)
        self._runs()

    def _runs(self) -> None:
        """Runs of postings of one term and block, each with its largest value."""
        term = np.repeat(np.arange(len(self.postings)), self.postings)
        run = term * max(1, self.blocks) + self.rows // BLOCK
        self.run_starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]).astype(np.int32) if len(run) else np.empty(0, dtype=np.int32)
        self.run_ends = np.r_[self.run_starts[1:], np.int32(len(run))] if len(run) else self.run_starts
        self.run_block = (run[self.run_starts] % max(1, self.blocks)).astype(np.int32)
        self.run_most = np.maximum.reduceat(self.values, self.run_starts) if len(run) else self.values
        self.term_starts = np.searchsorted(term[self.run_starts], np.arange(len(self.postings) + 1))

    def __getstate__(self) -> dict:
        """What the rest follows from: a worker holds the pickled model beside the model."""
        state = {k: v for k, v in vars(self).items() if not k.startswith("run_") and k != "term_starts"}
        at = np.flatnonzero(self.matrix)
        return state | {"matrix": (self.matrix.shape, at.astype(np.int32) if self.matrix.size < 1 << 31 else at, self.matrix.ravel()[at])}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        shape, at, values = state["matrix"]
        self.matrix = np.zeros(shape)
        self.matrix.ravel()[at] = values
        self._runs()

    def vector(self, counts: dict[str, int], place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and their values, of unit length."""
        known = [(place[w], c) for w, c in counts.items() if w in place]
        at = np.array([k for k, _ in known], dtype=np.int64)
        v = (1 + np.log(np.array([c for _, c in known], dtype=np.float64))) * self.weight[at]
        return at, v / max(float(np.sqrt((v**2).sum())), 1e-300)

    def nearest(self, at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the NEAREST examples, best first, ties by row; exact."""
        common = self.common[at]
        heavy, heavy_v = common[common >= 0], v[common >= 0]
        at, v = at[common < 0], v[common < 0]
        first, last = self.term_starts[at], self.term_starts[at + 1]
        runs, weight = _ranges(first, last), np.repeat(v, last - first)
        block = self.run_block[runs]
        dense = heavy_v @ self.matrix[heavy] if len(heavy) else np.zeros(self.blocks * BLOCK)
        bound = np.bincount(block, weight * self.run_most[runs], minlength=self.blocks) + dense.reshape(-1, BLOCK).max(axis=1, initial=0.0)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rows, cosines, least, done, step = np.empty(0, dtype=np.int64), np.empty(0), 0.0, 0, 2
        while done < len(order) and bound[order[done]] >= least - 1e-9:
            part = order[done : done + step]
            part = part[bound[part] >= least - 1e-9]
            chosen = np.zeros(self.blocks, dtype=bool)
            chosen[part] = True
            done, step = done + step, step * 2
            of = chosen[block]
            starts, ends = self.run_starts[runs[of]], self.run_ends[runs[of]]
            places = _ranges(starts, ends)
            dots = np.bincount(self.rows[places], self.values[places] * np.repeat(weight[of], ends - starts), minlength=self.blocks * BLOCK).astype(np.float64, copy=False)
            dots.reshape(-1, BLOCK)[part] += dense.reshape(-1, BLOCK)[part]
            hit = np.flatnonzero(dots)
            rows, cosines = np.r_[rows, hit], np.r_[cosines, dots[hit]]
            best = np.lexsort((rows, -cosines))[:NEAREST]
            rows, cosines = rows[best], cosines[best]
            least = cosines[-1] if len(cosines) == NEAREST else 0.0
        return rows, cosines

    def score(self, counts: dict[str, int], place: dict[str, int]) -> tuple[float, str]:
        at, v = self.vector(counts, place)
        if not len(at):
            return float(self.prior), ""
        rows, cosines = self.nearest(at, v)
        y = self.y[rows]
        w = cosines**2 * np.where(y == 1, self.share[1], self.share[0])
        prior = PRIOR * max(self.share)
        return float(min(1.0, max(0.0, ((w * y).sum() + prior * self.prior) / (w.sum() + prior)))), ",".join(str(self.ids[r]) for r in rows[:3])

    def scorer(self):
        """A function from a whole text to its score and evidence."""
        place = {w: i for i, w in enumerate(self.terms)}
        return lambda text: self.score(counted(text), place)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias(label_col))
    totals = {r[0]: r[1] for r in known.filter(~held_out(id_col)).groupBy(label_col).count().collect()}
    return Model(labelled_sample(docs, known, label=label_col, per_label=PER_CLASS, id_col=id_col, text_col=text_col), totals)


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(``id_col``, held_out, score, predicted, evidence) for every row."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)

    def start():
        scorer = model.scorer()

        def step(keys, out, texts):
            made = [scorer(t) for t in texts]
            return [keys, out, [m[0] for m in made], [int(m[0] >= 0.5) for m in made], [m[1] for m in made]]

        return step

    schema = pa.schema([(id_col, pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("evidence", pa.string())])
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), held_out(id_col).alias("held_out"), text_col)
    return map_rows(rows, [id_col, "held_out", text_col], start, schema, f"`{id_col}` long, held_out boolean, score double, predicted int, evidence string")


def remove(docs: DataFrame, labelled: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", at: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score ``at`` or more; examples come from ``labelled``."""
    model = fit(labelled, labels, id_col=id_col, text_col=text_col, label_col=label_col)

    def start():
        scorer = model.scorer()
        return lambda texts: [scorer(t)[0] < at for t in texts]

    return keep_rows(docs, text_col, start)
