"""Four-valued logic over statuses TRUE, FALSE, UNKNOWN and NOT_APPLICABLE, as aggregates and column functions.

Statuses are strings throughout: SQL null would stand for UNKNOWN alone, and boolean aggregates pass over nulls.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE, FALSE, UNKNOWN, NOT_APPLICABLE = "TRUE", "FALSE", "UNKNOWN", "NOT_APPLICABLE"
#: Headings by strength.
RANKS = {"Standard": 4, "Guidance": 3, "Option": 2, "Support": 1}


def _any(status: Column, value: str) -> Column:
    return F.coalesce(F.max(F.when(status == value, 1).otherwise(0)), F.lit(0)) == 1


def conjunction(status: Column) -> Column:
    """Aggregate: inputs that don't apply are left out; none left means the merge doesn't apply."""
    return F.when(_any(status, FALSE), FALSE).when(_any(status, UNKNOWN), UNKNOWN).when(_any(status, TRUE), TRUE).otherwise(NOT_APPLICABLE)


def alternative(status: Column) -> Column:
    """Aggregate: one TRUE input is enough."""
    return F.when(_any(status, TRUE), TRUE).when(_any(status, UNKNOWN), UNKNOWN).when(_any(status, FALSE), FALSE).otherwise(NOT_APPLICABLE)


def exception(base: Column, exceptions: Column) -> Column:
    """A base that doesn't apply stays so, a TRUE one TRUE; else base or an exception that applies."""
    return F.when(base.isin(NOT_APPLICABLE, TRUE), base).when(exceptions == TRUE, TRUE).when((base == UNKNOWN) | (exceptions == UNKNOWN), UNKNOWN).otherwise(base)


def threshold(status: Column, least: int) -> Column:
    """Aggregate: TRUE if at least so many inputs are TRUE whatever the unknown ones turn out to be."""
    n = lambda v: F.count_if(status == v)
    return F.when(n(TRUE) >= least, TRUE).when(n(TRUE) + n(UNKNOWN) >= least, UNKNOWN).otherwise(FALSE)


def negation(status: Column) -> Column:
    return F.when(status == TRUE, FALSE).when(status == FALSE, TRUE).otherwise(status)


def heading_rank(heading: Column) -> Column:
    return F.create_map(*(F.lit(x) for r in RANKS.items() for x in r))[heading]


def non_blocking(status: Column, heading: Column, merge_heading: Column) -> Column:
    """A FALSE under a weaker heading than the merge's counts as TRUE."""
    return F.when((status == FALSE) & (heading_rank(heading) < heading_rank(merge_heading)), TRUE).otherwise(status)


def guard(leaves: list[Column], holds) -> Column:
    """OPEN, CLOSED, PENDING or UNDECIDED of a guard over statuses of which some may be UNKNOWN or not marked (null).

    ``holds`` maps a list of boolean columns to one; all worlds of the open leaves are tried (at most 8 leaves). A
    guard that differs between worlds waits where a leaf isn't marked yet, and is undecided where all are.
    """
    if len(leaves) > 8:
        raise ValueError("at most 8 leaves")
    always, never = F.lit(True), F.lit(True)
    for world in product((True, False), repeat=len(leaves)):
        possible = F.lit(True)
        for leaf, value in zip(leaves, world, strict=True):
            # a leaf that doesn't apply matches neither way, so it is as good as false
            fits = F.coalesce(leaf == (TRUE if value else FALSE), F.lit(False)) | F.coalesce(leaf == UNKNOWN, F.lit(True))
            possible = possible & (fits | (leaf == NOT_APPLICABLE if not value else F.lit(False)))
        truth = holds([F.lit(v) for v in world])
        always = always & (~possible | truth)
        never = never & (~possible | ~truth)
    waiting = F.lit(False)
    for leaf in leaves:
        waiting = waiting | leaf.isNull()
    return F.when(F.coalesce(always, F.lit(False)), "OPEN").when(F.coalesce(never, F.lit(False)), "CLOSED").when(waiting, "PENDING").otherwise("UNDECIDED")
