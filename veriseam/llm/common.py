"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import cut_lineage, map_arrow
from ..sources.tables import table

__all__ = ["ROWS_AT_A_TIME", "bounded", "cut_lineage", "keep_rows", "map_arrow", "map_rows", "member_test", "table"]

#: Rows that a Python worker turns into Python objects at a time; bounds memory, never drops rows.
ROWS_AT_A_TIME = 256


def map_rows(df: DataFrame, columns: list[str], start: Callable[[], Callable[..., list[list]]], out: pa.Schema, ddl: str) -> DataFrame:
    """Stream ``columns`` of every row through a function, a few rows at a time.

    ``start`` runs once in each task and returns the function; that gets one list for each column and returns one for
    each field of ``out``, as many rows or as few as it likes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(at, ROWS_AT_A_TIME)
                made = step(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(made, out, strict=True)], schema=out)

    return map_arrow(df.select(*columns), run, ddl)


def keep_rows(docs: DataFrame, column: str, start: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of ``docs``, with all columns, for which a function of ``column`` is true; no shuffle."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        at = names.index(column)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(i, ROWS_AT_A_TIME)
                yield part.filter(pa.array(step(part.column(at).to_pylist()), type=pa.bool_()))

    return map_arrow(docs, run, docs.schema)


#: Bits of a bitmap that tells which numbers are wanted.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 26


def member_test(numbers: DataFrame, column: str) -> Callable[[np.ndarray], np.ndarray]:
    """A test that all longs of a column pass, and few others: a bitmap of LEAST_BITS to MOST_BITS bits.

    It has eight bits for each row, up to its bound; beyond that numbers pass that needn't, which costs time and changes
    nothing. The longs must be hashes: their low bits are the places.
    """
    from pyspark.sql import functions as F

    size, n = LEAST_BITS, numbers.count()
    while size < min(8 * n, MOST_BITS):
        size *= 2
    at = F.col(column).bitwiseAND(F.lit(size - 1).cast("long"))
    words = numbers.select(at.alias("at")).selectExpr("int(at div 64) as word", "shiftleft(1L, int(at % 64)) as bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most MOST_BITS / 64 rows
    bitmap = np.zeros(size // 64, dtype=np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    packed = bitmap.tobytes()

    def held(values: np.ndarray) -> np.ndarray:
        place = values & (size - 1)
        return (np.frombuffer(packed, dtype=np.uint8)[place >> 3] >> (place & 7) & 1).astype(bool)

    return held


def bounded(df: DataFrame, limit_bytes: int, size_of) -> bool:
    """Whether the rows of ``df`` measure at most ``limit_bytes`` by the expression ``size_of``; scans ``df`` once."""
    from pyspark.sql import functions as F

    return (df.agg(F.coalesce(F.sum(size_of), F.lit(0)).cast("long")).first()[0]) <= limit_bytes
