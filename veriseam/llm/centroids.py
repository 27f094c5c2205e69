"""Centroid clustering in exact integers, with most centroids ruled out by block norms.

A vector is kept if it has exactly DIMENSIONS components, none null, NaN or infinite; component x becomes the integer
floor(SCALE * x). It is stored once in packed form: its integers in the least width that holds them, and the norms of
its segments of SEGMENT components. By Cauchy-Schwarz the squared distance of two vectors is at least the sum of the
squared differences of their segment norms. A vector goes to the centroid of the least such bound first; every other
centroid whose bound, less a margin for rounding, is over the best exact distance so far is passed over, and only the
rest get exact integer distances. Ties go to the smaller number, so bounds never decide a result.

Rounds of assignment stream over the packed table; a task adds up its own vectors, and what reaches the driver is
k x DIMENSIONS sums, whatever the number of vectors. Sums are exact at any size (added as limbs of 48 bits). Distances
over the largest long, which need components beyond 2**28, are reported as the largest long; assignments stay exact.

Seeds are the k kept vectors of the smallest SHA-256 of ``1:<id>``, repeated ids in order of their components; rows
without an id come last. With fewer than k kept vectors there are fewer centroids; a table without any gives no rows.
Repeated rows are clustered like others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .common import cut_lineage, map_arrow

DIMENSIONS, SCALE, SEGMENT, CLUSTERS, ROUNDS = 64, 64, 8, 16, 3
#: Components below this magnitude have exact distances in 64-bit integers; larger ones go by Python's integers.
SMALL = 1 << 27
LIMB, LARGEST = 48, (1 << 63) - 1
#: Vectors measured at a time.
BATCH = 4096


def _norms(x: np.ndarray, segment: int) -> np.ndarray:
    if x.dtype == object:  # integers that no float holds count as infinite, so no bound speaks of them
        x = np.array([[float(v) if abs(v) >> 1000 == 0 else np.inf for v in row] for row in x])
    y = x.astype(np.float64)
    with np.errstate(over="ignore"):
        return np.sqrt((y * y).reshape(len(y), -1, segment).sum(axis=2))


def _scaled(x: float, scale: int) -> int:
    n, d = x.as_integer_ratio()
    return n * scale // d


def pack(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, segment: int = SEGMENT) -> DataFrame:
    """(id, width, ints, norms) of the kept vectors: width 1, 2 or 4 bytes an integer, or 0 for decimals joined by commas."""
    out = pa.schema([("id", pa.int64()), ("width", pa.int8()), ("ints", pa.binary()), ("norms", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                flat = part.column(1).flatten()
                x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)  # nulls become NaN
                ids, x = part.column(0).filter(pa.array(np.isfinite(x).all(axis=1))), x[np.isfinite(x).all(axis=1)]
                with np.errstate(over="ignore"):
                    y = np.floor(x * scale)
                top = np.abs(y).max(axis=1, initial=0)
                widths = np.select([top < 1 << 7, top < 1 << 15, top < SMALL], [1, 2, 4], 0).astype(np.int8)
                norms, ints = _norms(y, segment), [b""] * len(y)
                for width in (1, 2, 4):
                    rows = np.flatnonzero(widths == width)
                    for i, z in zip(rows, y[rows].astype(f"<i{width}"), strict=True):
                        ints[i] = z.tobytes()
                for i in np.flatnonzero(widths == 0):
                    ints[i] = ",".join(str(_scaled(float(v), scale)) for v in x[i]).encode()
                yield pa.RecordBatch.from_arrays([ids, pa.array(widths), pa.array(ints, type=pa.binary()), pa.array([n.tobytes() for n in norms], type=pa.binary())], schema=out)

    kept = spread(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))).filter(F.size("x") == dimensions)
    return map_arrow(kept, run, "id long, width byte, ints binary, norms binary")


def _integers(width: int, packed: bytes) -> np.ndarray:
    if width:
        return np.frombuffer(packed, dtype=f"<i{width}").astype(np.int64)
    return np.array([int(v) for v in packed.split(b",")], dtype=object)


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, exact squared distance) of each row of ``x``, and how many distances it took.

    ``x`` and ``centroids`` hold integers, 64-bit ones below SMALL or Python's.
    """
    if x.dtype == object or centroids.dtype == object:
        x, centroids = x.astype(object), centroids.astype(object)
    of = _norms(centroids, segment)
    with np.errstate(over="ignore", invalid="ignore"):
        gap = norms[:, None, :] - of[None, :, :]
        # rounding of norms and differences is some 1e-15 of the squares; the margin is a thousand times that
        bound = np.einsum("nks,nks->nk", gap, gap) - 1e-12 * ((norms * norms).sum(axis=1)[:, None] + (of * of).sum(axis=1)[None, :]) - 1e-6
    bound[~np.isfinite(bound)] = -1.0
    first = bound.argmin(axis=1)

    def exact(rows, c) -> np.ndarray:
        d = x[rows] - c
        return (d * d).sum(axis=1)

    label, best, taken = first.copy(), exact(slice(None), centroids[first]), len(x)
    for j in range(len(centroids)):
        rows = np.flatnonzero((bound[:, j] <= best) & (first != j))
        if len(rows):
            d = exact(rows, centroids[j])
            better = (d < best[rows]) | ((d == best[rows]) & (j < label[rows]))
            label[rows[better]], best[rows[better]] = j, d[better]
            taken += len(rows)
    return label, best, taken


def _array(centroids: list[list[int]]) -> np.ndarray:
    small = all(abs(v) < SMALL for c in centroids for v in c)
    return np.array(centroids, dtype=np.int64 if small else object)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, integers, norms) of rows of one kind, at most BATCH at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            for small in (True, False):
                rows = part.filter(pa.array((np.asarray(part.column(1)) > 0) == small))
                if rows.num_rows:
                    x = np.stack([_integers(w, b) for w, b in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)])
                    yield rows.column(0), x, np.stack([np.frombuffer(b) for b in rows.column(3).to_pylist()])


def _totals(packed: DataFrame, centroids: list[list[int]], segment: int) -> dict[tuple[int, int], int]:
    """Exact sums over the vectors of each centroid: by (number, component), with -1 for their count and -2 for their distances."""
    out = pa.schema([("k", pa.int32()), ("i", pa.int32()), ("limb", pa.int32()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        for _, x, norms in _groups(batches):
            label, d, _ = nearest(x, norms, _array(centroids), segment)
            for k in np.unique(label):
                own = label == k
                total = [*x[own].sum(axis=0), own.sum(), sum(map(int, d[own]))]
                for i, v in zip([*range(x.shape[1]), -1, -2], total, strict=True):
                    sums[int(k), i] = sums.get((int(k), i), 0) + int(v)
        rows = []
        for (k, i), v in sums.items():
            limb, rest = 0, abs(v)
            while rest or not limb:
                rows.append((k, i, limb, (rest & (1 << LIMB) - 1) * (-1 if v < 0 else 1)))
                limb, rest = limb + 1, rest >> LIMB
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    made = map_arrow(packed, run, "k int, i int, limb int, v long").groupBy("k", "i", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found: dict[tuple[int, int], int] = {}
    for k, i, limb, v in made.collect():  # (components + 2) x centroids x limbs
        found[k, i] = found.get((k, i), 0) + (int(v) << LIMB * limb)
    return found


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, segment: int = SEGMENT) -> DataFrame:
    """(``id_col``, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    packed = cut_lineage(pack(vectors, id_col=id_col, vector_col=vector_col, dimensions=dimensions, scale=scale, segment=segment))
    rank = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    seeds = packed.orderBy(rank.asc_nulls_last(), "width", "ints").limit(k).select("width", "ints").collect()
    centroids = [[int(v) for v in _integers(w, bytes(b))] for w, b in seeds]
    for _ in range(rounds if centroids else 0):
        sums = _totals(packed, centroids, segment)
        centroids = [[sums[j, i] // sums[j, -1] for i in range(dimensions)] if (j, -1) in sums else c for j, c in enumerate(centroids)]

    out = pa.schema([("id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, norms in _groups(batches):
            label, d, _ = nearest(x, norms, _array(centroids), segment)
            yield pa.RecordBatch.from_arrays([ids, pa.array(label.astype(np.int32)), pa.array([min(int(v), LARGEST) for v in d], type=pa.int64())], schema=out)

    ddl = "id long, cluster int, distance long"
    made = map_arrow(packed, assign, ddl) if centroids else vectors.sparkSession.createDataFrame([], ddl)
    sums = _totals(packed, centroids, segment) if centroids else {}
    inertia = [min(sums.get((j, -2), 0), LARGEST) for j in range(len(centroids))]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    by_number = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1) if values else F.lit(None)
    return made.select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        by_number(inertia).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(sums.get((j, -2), 0) for j in range(len(centroids))), LARGEST)).cast("long").alias("inertia"),
        by_number(shas).cast("string").alias("centroid_sha256"),
    )


SQL = f"""
with kept as (
  select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (
  select row_number() over (order by sha256('1:' || vec_id)) - 1 as k, v from kept
  qualify row_number() over (order by sha256('1:' || vec_id)) <= {CLUSTERS}),
""" + "".join(f"""
d{r} as (
  select vec_id, kept.v, c.k, list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (kept.v[i] - c.v[i]) * (kept.v[i] - c.v[i])))::bigint as d
  from kept cross join c{r} c),
a{r} as (select vec_id, v, k, d from d{r} qualify row_number() over (partition by vec_id order by d, k) = 1),
""" + (f"""
s{r} as (select k, i, sum(v[i])::bigint as s, count(*) as n from a{r} cross join range(1, {DIMENSIONS + 1}) t(i) group by k, i),
c{r + 1} as (
  select c.k, coalesce(m.v, c.v) as v from c{r} c
  left join (select k, list((s - ((s % n) + n) % n) // n order by i) as v from s{r} group by k) m on c.k = m.k),
""" if r < ROUNDS else "") for r in range(ROUNDS + 1)) + f"""
total as (select k, sum(d)::bigint as cluster_inertia from a{ROUNDS} group by k)
select vec_id, a.k::int as cluster, d as distance, cluster_inertia, (select sum(d)::bigint from a{ROUNDS}) as inertia,
  sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{ROUNDS} a join total t on a.k = t.k join c{ROUNDS} c on a.k = c.k"""
