"""What networks may come to: for every op the set of statuses that are possible, pushed through the levels of a DAG.

A set is a mask of TRUE, FALSE, UNKNOWN and NOT_APPLICABLE. A merge of sets is the set of what it makes of all
combinations of its inputs; that needs no enumeration, since which statuses can come out follows from whether some or
every input can be, or some must be, each status. A bit each is kept of that for a waiting op, and a wave joins only what
was just settled. Ops on a cycle, or behind something that nothing produces, are UNKNOWN.

``ops``: (net, op, merge) with merge one of check, conjunction, alternative, exception; ``requires``: (net, op, needs,
part), part being input, or base and exception for exception merges, or guard with the status it wants in column want
(RESOLVED: TRUE or FALSE); ``checks``: (net, op, possible) with an array of statuses. Needs of a check are prerequisites.
An input repeated among an op's needs counts once for each part.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import logic as L
from ..session import cut_lineage

T, N, U, A = 1, 2, 4, 8
BITS = {L.TRUE: T, L.FALSE: N, L.UNKNOWN: U, L.NOT_APPLICABLE: A}


def mask(possible: Column) -> Column:
    """An array of statuses as a mask."""
    out = F.lit(0)
    for status, bit in BITS.items():
        out = out.bitwiseOR(F.when(F.array_contains(possible, status), bit).otherwise(0))
    return out


def statuses(of: Column) -> Column:
    """A mask as an array of statuses."""
    return F.array_compact(F.array(*(F.when(of.bitwiseAND(F.lit(bit)) != 0, status) for status, bit in BITS.items())))


def settled(of: Column) -> Column:
    """The one status that is possible, else UNKNOWN."""
    out = F.lit(L.UNKNOWN)
    for status, bit in BITS.items():
        out = F.when(of == bit, status).otherwise(out)
    return out


# What is kept of the inputs of an op, in two numbers for all its parts. ``some``: that there is one, and what one can be
# (T, N, U, A) or must be; ``every``: what all of them can be.
GROUPS = ("input", "base", "exception")
MUST_T, MUST_F, PRESENT, SOME_BITS = 16, 32, 64, 7
ALL_A, ALL_T_OR_A, ALL_F_OR_A, ALL_KNOWN, EVERY_BITS = 1, 2, 4, 8, 4
CLOSES, OPENS = 1 << SOME_BITS * len(GROUPS), 1 << EVERY_BITS * len(GROUPS)
EVERY = 2 * OPENS - 1


def _some(of: Column) -> Column:
    return of.bitwiseOR(F.when(of == T, MUST_T | PRESENT).when(of == N, MUST_F | PRESENT).otherwise(PRESENT))


def _every(of: Column) -> Column:
    out = F.lit(0)
    for bit, can in ((ALL_A, A), (ALL_T_OR_A, T | A), (ALL_F_OR_A, N | A), (ALL_KNOWN, T | N | A)):
        out = out.bitwiseOR(F.when(of.bitwiseAND(F.lit(can)) != 0, bit).otherwise(0))
    return out


def _of(group: str):
    """Tests of one part's inputs: ``some`` and ``every`` of a bit."""
    k = GROUPS.index(group)
    return lambda name, bit: F.col(name).bitwiseAND(F.lit(bit << k * (SOME_BITS if name == "some" else EVERY_BITS))) != 0


def _bits(**can: Column) -> Column:
    out = F.lit(0)
    for key, bit in (("t", T), ("f", N), ("u", U), ("a", A)):
        out = out.bitwiseOR(F.when(can[key], bit).otherwise(0))
    return out


def _conjunction(c) -> Column:
    return F.when(~c("some", PRESENT), A).otherwise(_bits(f=c("some", N), u=c("some", U) & ~c("some", MUST_F), t=c("every", ALL_T_OR_A) & c("some", T), a=c("every", ALL_A)))


def _alternative(c) -> Column:
    return F.when(~c("some", PRESENT), A).otherwise(_bits(t=c("some", T), u=c("some", U) & ~c("some", MUST_T), f=c("every", ALL_F_OR_A) & c("some", N), a=c("every", ALL_A)))


def _exception(base: Column, exceptions: Column) -> Column:
    """Every base with every exception: 16 combinations of two statuses."""
    out = F.lit(0)
    for x, y in product(BITS.values(), BITS.values()):
        made = x if x in (T, A) else T if y == T else U if U in (x, y) else x
        out = out.bitwiseOR(F.when((base.bitwiseAND(F.lit(x)) != 0) & (exceptions.bitwiseAND(F.lit(y)) != 0), made).otherwise(0))
    return out


def _checked(own: Column, c) -> Column:
    """A check with prerequisites: none of them known to be missing lets it speak, all not applicable leave it so."""
    speaks = c("every", ALL_KNOWN) & (c("some", T) | c("some", N))
    return F.when(~c("some", PRESENT), own).otherwise(F.when(speaks, own).otherwise(0).bitwiseOR(F.when(c("some", U), U).otherwise(0)).bitwiseOR(F.when(c("every", ALL_A), A).otherwise(0)))


def outcomes(ops: DataFrame, requires: DataFrame, checks: DataFrame) -> DataFrame:
    """(net, op, mask, wave) of every op; wave is null for ops that were never settled, whose mask is UNKNOWN's."""
    guards = F.col("part") == "guard"
    if "want" not in requires.columns:
        requires = requires.withColumn("want", F.lit(None).cast("string"))
    needs = cut_lineage(requires.select("net", "op", "needs", "part", "want"))
    wanted = needs.groupBy("net", "op").agg(F.count("*").alias("wanted"))
    kinds = ops.select("net", "op", "merge").join(checks.select("net", "op", mask(F.col("possible")).alias("own")), ["net", "op"], "left").join(wanted, ["net", "op"], "left")
    kinds = cut_lineage(kinds.select("net", "op", "merge", F.coalesce("own", F.lit(U)).alias("own"), F.coalesce("wanted", F.lit(0)).alias("wanted")))

    sums = [F.bit_or("some").alias("some"), F.bit_and("every").alias("every"), F.sum("got").alias("got")]

    def result() -> Column:
        base = F.shiftright("some", SOME_BITS * GROUPS.index("base")).bitwiseAND(F.lit(T | N | U | A))
        merged = (
            F.when(F.col("merge") == "conjunction", _conjunction(_of("input")))
            .when(F.col("merge") == "alternative", _alternative(_of("input")))
            .when(F.col("merge") == "exception", _exception(F.when(base > 0, base).otherwise(A), _alternative(_of("exception"))))
            .otherwise(_checked(F.col("own"), _of("input")))
        )
        opened = F.when(F.col("every").bitwiseAND(F.lit(OPENS)) != 0, merged).otherwise(0)
        return opened.bitwiseOR(F.when(F.col("some").bitwiseAND(F.lit(CLOSES)) != 0, A).otherwise(0))

    def passed_on(new: DataFrame) -> DataFrame:
        """What just settled, as bits of the ops that need it."""
        met = needs.join(new.select("net", F.col("op").alias("needs"), "mask"), ["net", "needs"])
        of, want = F.col("mask"), F.col("want")
        bits = F.when(want == "RESOLVED", T | N)
        for status, bit in BITS.items():
            bits = F.when(want == status, bit).otherwise(bits)
        bits = F.coalesce(bits, F.lit(T))
        some = F.when(guards & (of.bitwiseAND(F.lit(15) - bits) != 0), CLOSES)
        every = F.when(guards & (of.bitwiseAND(bits) == 0), EVERY - OPENS)
        for k, g in enumerate(GROUPS):
            some = some.when(F.col("part") == g, F.shiftleft(_some(of), k * SOME_BITS))
            every = every.when(F.col("part") == g, F.shiftleft(_every(of), k * EVERY_BITS).bitwiseOR(F.lit(EVERY - (15 << k * EVERY_BITS))))
        row = met.select("net", "op", some.otherwise(0).alias("some"), every.otherwise(EVERY).alias("every"), F.lit(1).alias("got"))
        return row.groupBy("net", "op").agg(*sums)

    first = kinds.filter("wanted = 0").select("*", F.lit(0).alias("some"), F.lit(EVERY).alias("every"))
    new = cut_lineage(first.select("net", "op", result().alias("mask"), F.lit(0).alias("wave")))
    done, waiting, wave = [new], None, 0
    while True:
        wave += 1
        more = passed_on(new)
        counted = more if waiting is None else waiting.unionByName(more).groupBy("net", "op").agg(*sums)
        counted = cut_lineage(counted.join(kinds, ["net", "op"]).withColumn("ready", F.col("got") == F.col("wanted")))
        new = counted.filter("ready").select("net", "op", result().alias("mask"), F.lit(wave).alias("wave"))
        if new.isEmpty():
            break
        done.append(new)
        waiting = counted.filter("not ready").select("net", "op", "some", "every", "got")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    never = ops.select("net", "op").join(out.select("net", "op"), ["net", "op"], "left_anti")
    return out.unionByName(never.select("net", "op", F.lit(U).alias("mask"), F.lit(None).cast("int").alias("wave")))
