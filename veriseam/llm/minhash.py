"""Document fingerprints by MinHash: universal hash permutations over word shingles in vectorised numpy.

A-Z are lower-cased and words end at ASCII white space. Shingles are five words; a text of fewer words is one shingle,
a text without words has none, and its components are all the largest value. Each permutation is ``(a*x + b) >> 32``
over 32-bit shingle values (multiply-add-shift, strongly universal); a signature holds the least value of each.

A fingerprint is a signature's low 16 bits in hexadecimal. Two agree in a component by chance once in 65,536 times;
``likeness`` takes that into account and estimates the Jaccard likeness of the shingle sets.

Null texts count as empty. Repeated rows give repeated results, other columns are ignored, an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

PERMUTATIONS, WORDS = 128, 5
REMEMBERED = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hash values of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        value = xxhash.xxh64_intdigest(word, 7)
        if len(word) <= 64:
            self[word] = value
        return value


@functools.lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


@functools.lru_cache(maxsize=4)
def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """32-bit values of the shingles of a text, repeats included, as uint64."""
    return wide_shingles(text, words) >> np.uint64(32)


def wide_shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """64-bit values of the shingles of a text, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_words().__getitem__, parts), dtype=np.uint64, count=len(parts))
    n = max(1, len(h) - words + 1)
    x = np.zeros(n, dtype=np.uint64)
    for i in range(min(words, len(h))):
        x = x * _MIX + h[i : i + n]
    x ^= x >> np.uint64(29)
    return x * _MIX


def signatures(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> np.ndarray:
    """A row of ``permutations`` 32-bit components for each set of shingle values."""
    out = np.full((len(sets), permutations), 0xFFFFFFFF, dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
    x = np.concatenate([sets[i] for i in full])
    a, b = _coefficients(permutations)
    least = np.empty((permutations, len(full)), dtype=np.uint32)
    y = np.empty_like(x)
    for k in range(permutations):
        np.multiply(x, a[k], out=y)
        np.add(y, b[k], out=y)
        least[k] = np.minimum.reduceat(y, starts) >> np.uint64(32)
    out[full] = least.T
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of signatures by their 16 low bits, row by row."""
    same = ((a & 0xFFFF) == (b & 0xFFFF)).mean(axis=1)
    chance = 2.0**-16
    return np.where(same == 1, 1.0, np.maximum(0.0, (same - chance) / (1 - chance)))


def _hex(s: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in (s & 0xFFFF).astype(">u2")]


def dealt_in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, ahead, id, no_id, text): rows dealt by ranges of ids, in each by descending id, then text.

    Ranges come from approximate quantiles of all ids. An id that fills several quantiles is a range of its own, dealt
    to as many buckets by a hash of the text. The smallest text that follows a range (of the next range's first id,
    after the last that of the first) is dealt ahead of every bucket of it, so that the successor of each row comes
    before the row, and texts are shuffled once.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(4 * n, 4096)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0]
    if cuts is None:
        return rows.select(F.lit(0).alias("bucket"), F.lit(0).alias("ahead"), "id", "no_id", "text")
    often = {c: k for c, k in Counter(cuts).items() if k > 1}
    cuts = sorted({*cuts, *(c - 1 for c in often if c > -(2**63))})  # range k holds the ids over cut k - 1 up to cut k
    salts = [often.get(c, 1) for c in cuts] + [1]
    wide = max(1, int(len(cuts) ** 0.5))
    coarse = cuts[wide - 1 :: wide]
    fine = [cuts[i * wide : (i + 1) * wide] for i in range(len(coarse) + 1)]
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs)) if xs else F.expr("cast(array() as array<bigint>)")
    rows = rows.withColumn("_c", F.size(F.filter(longs(coarse), lambda c: c < F.col("id"))))
    within = F.size(F.filter(F.element_at(F.array(*map(longs, fine)), F.col("_c") + 1), lambda c: c < F.col("id")))
    rows = rows.withColumn("range", F.col("_c") * wide + within).drop("_c")
    firsts = sorted(tuple(r) for r in rows.groupBy("range").agg(F.min("id")).collect())
    ahead_of = {firsts[i][1]: firsts[i - 1][0] for i in range(len(firsts))}  # first id of a range: the range before it
    heads = rows.filter(F.col("id").isin([i for _, i in firsts])).groupBy("id").agg(F.min("text").alias("text"))
    before = F.create_map(*(F.lit(x) for p in ahead_of.items() for x in p))
    room = F.array(*(F.lit(k) for k in salts))
    most = max(salts)
    heads = heads.withColumn("range", before[F.col("id")]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.element_at(room, F.col("range") + 1) - 1)))
    heads = heads.select((F.col("range") * most + F.col("salt")).cast("int").alias("bucket"), F.lit(1).alias("ahead"), "id", F.lit(False).alias("no_id"), "text")
    salt = F.pmod(F.xxhash64("text"), F.element_at(room, F.col("range") + 1).cast("long")) if most > 1 else F.lit(0)
    own = rows.select((F.col("range") * most + salt).cast("int").alias("bucket"), F.lit(0).alias("ahead"), "id", "no_id", "text")
    return own.unionByName(heads).repartition(n, "bucket").sortWithinPartitions("bucket", F.col("ahead").desc(), F.col("id").desc(), "text")


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next text, that
    of the next larger id, after the largest that of the smallest; of rows with one id the smallest text is the next.
    Rows without an id come before all others. A worker holds the rows of one answer and two texts besides.
    """
    out = pa.schema([(id_col, pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        texts = [t for _, t, _ in rows]
        edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for _, t, after in rows]
        # most successors are the row before, whose signature is made anyway; the others once for each text
        other = [i for i in range(len(rows)) if not i or rows[i - 1][1] is not rows[i][2]]
        fresh = [i for k, i in enumerate(other) if not k or rows[other[k - 1]][2] is not rows[i][2]]
        s = signatures([shingles(t) for t in (*texts, *edited, *(rows[i][2] for i in fresh))])
        k = len(rows)
        own, changed = s[:k], s[k : 2 * k]
        after = np.empty_like(own)
        after[1:] = own[:-1]
        at = -1
        for i in other:
            at += at + 1 < len(fresh) and fresh[at + 1] == i
            after[i] = s[2 * k + at]
        sha = [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]
        columns = [[i for i, _, _ in rows], [len(t) for t in texts], sha, _hex(own), _hex(changed), likeness(own, changed), likeness(own, after)]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        chars, of = 0, None
        after = first = ""  # the text that follows the id at hand, and that id's own smallest
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                for bucket, ahead, key, no_id, text in zip(*(c.to_pylist() for c in batch.slice(at, 128).columns), strict=True):
                    if of is None or of[0] != bucket:
                        after = first = text
                    elif of != (bucket, ahead, key):
                        after, first = first, text
                    of = (bucket, ahead, key)
                    if not ahead:
                        ready.append((None if no_id else key, text, after))
                        chars += len(text) + len(after)
                if len(ready) >= 128 or chars > 2_000_000:
                    yield finish(ready)
                    ready, chars = [], 0
        if ready:
            yield finish(ready)

    return map_arrow(dealt_in_order(docs, id_col, text_col), run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(``id_col``, class_id): the smallest id that each row reaches over pairs of at least ``threshold`` Jaccard likeness.

    Bands of the signature, joined in Spark, deal texts to groups of bounded size, in which the likeness of shingle sets
    is verified; pairs that no band brings together are found by shared rare shingles (see ``jaccard_join``), so none is
    missed. No set is shipped for each of its bands. Texts without words are one class.
    """
    from . import jaccard_join

    found = jaccard_join.join(docs, id_col=id_col, text_col=text_col, words=WORDS, least=threshold).select("id", F.coalesce("root", F.lit(-1)).alias("root"))
    return found.join(found.groupBy("root").agg(F.min("id").alias("class_id")), "root").select(F.col("id").alias(id_col), "class_id")
