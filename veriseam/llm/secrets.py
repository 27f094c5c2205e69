"""Secret scans with DataFrame functions only.

Three base kinds are found by their patterns, leftmost first and without overlap within a kind. A fourth, ``entropy``,
looks at candidate strings (maximal runs of ``[A-Za-z0-9+/_=-]`` of 20 or more characters): a window slides over the
candidate, the counts of the character that enters and of the one that leaves change, and with them the Shannon entropy.
A candidate is a secret if some window is at or over the threshold of its character class (hexadecimal digits, letters
of one case, letters of both, letters and digits, all else) and no allow-list pattern suppresses it. The allow list
never touches base kinds. Work is proportional to the length of a candidate: it is cut into pieces that overlap by a
window, and no pattern repeats a group, which Java would match by recursion.

Places of matches come from the text split at the pattern: piece and match lengths, added up. Lengths and places are
code points, ends are exclusive.

Null texts count as empty and have no spans; an empty table gives an empty result; repeated rows stay.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds' patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Candidates that are no secrets: UUIDs, plain numbers and dates, paths, words with numbers, words joined by strokes,
#: placeholders, one character again and again.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[0-9_/=+-]+$",
    r"^[a-z0-9]*+/[a-z0-9_-]*+/[a-z0-9/_-]*+$",
    r"^[A-Za-z](?!.*[_-][_=-])[A-Za-z_-]*+=?[0-9]{1,6}$",
    r"^[A-Za-z](?=.{0,40}[_/-])(?!.*[_/=-][_=-])[A-Za-z/_-]*+$",
    r"(?i)(example|sample|dummy|placeholder|changeme|xxxx|your[_-])",
    r"(.)\1{7}",
)
WINDOW = 20
#: Character classes, the first that fits a candidate, and their least entropy.
CLASSES = {"^([0-9a-f]++|[0-9A-F]++)$": 2.75, "^([a-z]++|[A-Z]++)$": 4.05, "^[A-Za-z]++$": 3.9, "^[A-Za-z0-9]++$": 3.6}
LEAST = 3.6
#: Characters of a candidate looked at in one piece, besides the window that overlaps.
PIECE = 256
KINDS = ("assign", "access", "hex", "entropy")
#: Matches that are folded in one go.
CHUNK = 256


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """array<struct<start, rank, kind, end>> of the matches of a pattern; keep: an array of booleans, one for each match."""
    pieces = F.transform(F.split(text, pattern, -1), F.char_length)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length)
    matches = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("gap"), found.alias("size"), (keep if keep is not None else F.transform(found, lambda _: F.lit(True))).alias("keep"))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")

    def run(part: Column) -> Column:
        """Places of the matches of one chunk, counted from its start, and its length."""
        return F.aggregate(
            part,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda a, x: F.struct(
                (a["at"] + x["gap"] + x["size"]).alias("at"),
                F.concat(a["out"], F.when(x["keep"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), (a["at"] + x["gap"] + x["size"]).alias("end")))).otherwise(none)).alias("out"),
            ),
        )

    moved = lambda s, by: F.struct((s["start"] + by).alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), (s["end"] + by).alias("end"))
    return F.aggregate(
        F.transform(_let(matches, _chunks), run),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start:int,rank:int,kind:string,end:int>>>)").alias("out")),
        lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(F.transform(x["out"], lambda s: moved(s, a["at"])))).alias("out")),
        lambda a: F.flatten(a["out"]),
    )


def _chunks(values: Column) -> Column:
    """An array cut into arrays of CHUNK values, so that what a fold has gathered is copied a bounded number of times."""
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.transform(F.slice(values, 1, 0), lambda v: F.array(v)))


def _let(value: Column, of) -> Column:
    """``of(value)`` with the value worked out once."""
    return F.transform(F.array(value), of)[0]


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits) of the windows of an ASCII string, by incremental counts; whole if shorter."""
    # S is the sum of c*log2(c) over the counts c; entropy = log2(n) - S/n. What two neighbouring windows share are the
    # window - 1 characters between the one that leaves and the one that enters; each of them changes S by
    # (c+1)*log2(c+1) - c*log2(c), where c is its count among the shared ones.
    gain = F.array(*(F.lit(float((c + 1) * log2(c + 1) - (c * log2(c) if c else 0.0))) for c in range(window)))
    wide = F.least(F.char_length(text), F.lit(window))
    pieces = F.filter(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{PIECE + window - 1}}})).{{1,{PIECE}}}"), F.lit(1)), lambda p: F.char_length(p) >= wide)

    def changes(piece: Column) -> Column:
        def change(i: Column) -> Column:
            shared = F.substring(piece, F.greatest(F.lit(1), i - (window - 1)), F.least(F.lit(window - 1), i - 1))
            by = lambda at: F.element_at(gain, F.char_length(shared) - F.char_length(F.replace(shared, F.substring(piece, at, F.lit(1)), F.lit(""))) + 1)
            return by(i) - F.when(i > window, by(i - window)).otherwise(0.0)

        return F.transform(F.sequence(F.lit(1), F.char_length(piece)), change)

    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("s"), F.lit(float("inf")).alias("least"))
    step = lambda a, d: F.struct((a["i"] + 1).alias("i"), (a["s"] + d).alias("s"), F.when(a["i"] + 1 >= wide, F.least(a["least"], a["s"] + d)).otherwise(a["least"]).alias("least"))
    least = F.array_min(F.transform(pieces, lambda p: F.aggregate(changes(p), start, step, lambda a: a["least"])))
    n = wide.cast("double")
    return F.when(n > 0, F.greatest(F.lit(0.0), F.log2(n) - least / n)).otherwise(0.0)


def _is_secret(candidate: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    least = F.lit(LEAST)
    for pattern, bits in reversed(CLASSES.items()):
        least = F.when(candidate.rlike(pattern), bits).otherwise(least)
    return F.when(allowed, False).otherwise(window_entropy(candidate) >= least)


def _free(docs: DataFrame) -> str:
    """A name for the spans that no column of ``docs`` has."""
    name = "_spans"
    while name in docs.columns:
        name += "_"
    return name


def with_spans(docs: DataFrame, *, text_col: str = "text", to: str = "_spans") -> DataFrame:
    """``docs`` and a column ``to``: array<struct<start, rank, kind, end>> by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    by_kind = [
        _spans(text, ASSIGN, "assign", F.transform(value, lambda v: F.char_length(v) >= 6)),
        _spans(text, ACCESS, "access"),
        _spans(text, HEX, "hex"),
        _spans(text, CANDIDATE, "entropy", F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), _is_secret)),
    ]
    may = (r"(?i)(password|passwd|secret|token|api_?key)", ACCESS, HEX, CANDIDATE)
    spans = [F.when(text.rlike(p), s).otherwise(none) for p, s in zip(may, by_kind, strict=True)]
    return docs.withColumn(to, F.array_sort(F.concat(*spans)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``id_col``, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    found = with_spans(docs.select(id_col, text_col), text_col=text_col)
    n = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        F.col(id_col),
        n("assign"),
        n("access"),
        n("hex"),
        F.sha2(joined(F.filter("_spans", lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        joined(F.col("_spans")).alias("spans"),
        n("entropy"),
    )


def redact(docs: DataFrame, *, text_col: str = "text", by: str = "[SECRET]", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by ``by``; overlapping spans are one. ``chars_col`` gets the new length."""
    text = F.col(text_col)
    spans = _free(docs)
    found = with_spans(docs, text_col=text_col, to=spans)

    def rewritten(section: Column, start: Column, part: Column) -> Column:
        """(at, out): where the last span of a chunk ends, and the section of the text up to there with spans replaced."""
        cut = lambda lo, hi: F.substring(section, lo - start + 1, F.greatest(F.lit(0), hi - lo))
        return F.aggregate(
            part,
            F.struct(start.alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
            lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(cut(a["at"], s["start"]), F.when(s["start"] >= a["at"], F.lit(by)).otherwise(F.lit("")))).alias("out"))),
            lambda a: F.struct(a["at"].alias("at"), F.array_join(a["out"], "").alias("out")),
        )

    def step(a: Column, part: Column) -> Column:
        last = F.greatest(a["at"], F.array_max(F.transform(part, lambda s: s["end"])))
        made = _let(F.substring(text, a["at"] + 1, last - a["at"]), lambda section: rewritten(section, a["at"], part))
        return _let(made, lambda x: F.struct(x["at"].alias("at"), F.concat(a["out"], F.array(x["out"])).alias("out")))

    kept = F.aggregate(
        _chunks(F.col(spans)),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        step,
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.char_length(text))),
    )
    new = found.withColumn(text_col, F.when(F.size(spans) > 0, kept).otherwise(text)).drop(spans)
    if chars_col and chars_col in docs.columns:
        new = new.withColumn(chars_col, F.char_length(text_col).cast(docs.schema[chars_col].dataType))
    return new.select(*docs.columns)
