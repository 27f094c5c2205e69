"""Conditions in words as comparisons: clauses of a rule, and comparisons that a claim states itself. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .logic import FALSE, TRUE

# Names of quantities in the order that breaks ties, phrases that compare in the order they count, units.
QUANTITIES = (
    ("major_street_speed", r"major[- ]street speed|speed on (?:the )?major street|on major street"),
    ("population", r"\bpopulation\b|\bcommunity\b"),
    ("pixel_spacing", r"pixel spacing"),
    ("letter_height", r"letter height|upper[- ]case letters?"),
    ("sign_size", r"signs? measuring|\bmeasuring\b|sign size"),
    ("volume", r"\bvolume\b|vehicles per (?:hour|day)|\baadt\b"),
    ("radius", r"\bradius\b"),
    ("spacing", r"\bspacing\b"),
    ("width", r"\bwidth\b"),
    ("distance", r"\bdistance\b"),
    ("speed", r"\bspeed(?:s| limits?)?\b|mph"),
)
UNIT_WORDS = "mph|feet|foot|ft|inches|inch|in|mm|millimeters|meters|metres|m|vph|vpd"
AMOUNT = r"([0-9,]+\.?[0-9]*)"
COMPARED = (
    (rf"(?:of\s+)?{AMOUNT}\s*({UNIT_WORDS})?\s+or\s+(?:less|lower|fewer|below)\b(?!\s*[0-9])", "<=", "after"),
    (rf"(?:of\s+)?{AMOUNT}\s*({UNIT_WORDS})?\s+or\s+(?:more|greater|higher|above)\b(?!\s*[0-9])", ">=", "after"),
    (rf"\b(?:exceeds|exceeding|greater than|more than|above|over)\s+{AMOUNT}\s*([A-Za-z]+)?", ">", "before"),
    (rf"\b(?:less than|fewer than|below|under)\s+{AMOUNT}\s*([A-Za-z]+)?", "<", "before"),
    (rf"\b(?:at least|no less than|not less than|a minimum of|minimum of)\s+{AMOUNT}\s*([A-Za-z]+)?", ">=", "before"),
    (rf"\b(?:at most|no more than|not more than|does not exceed|not exceed|a maximum of|maximum of)\s+{AMOUNT}\s*([A-Za-z]+)?", "<=", "before"),
    (rf"\b(?:equals|equal to|is)\s+{AMOUNT}\s*([A-Za-z]+)?", "==", "before"),
)
EXPLICIT = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*(>=|<=|==|!=|>|<)\s*(-?[0-9,]+\.?[0-9]*)\s*([A-Za-z]+)?\s*$"
CANON = {"mph": "mph", "feet": "ft", "foot": "ft", "ft": "ft", "inches": "in", "inch": "in", "in": "in", "mm": "mm", "millimeters": "mm", "meters": "m", "metres": "m", "m": "m", "vph": "vph", "vpd": "vpd"}
CONVERTED = {("ft", "in"): 12.0, ("in", "ft"): 1 / 12}
DENIED = r"(?i)^\s*(?:it is not the case that|not)\s+"
OR_SUFFIX = r"(?i)\s+or\s+(less|lower|fewer|below|more|greater|higher|above)\b(?!\s*[0-9])"
LISTED_OR = r"(?i),\s*or\s+"
_MASK = "\x00OR\x00"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def denied(text: Column) -> Column:
    """Whether a condition starts with a negation."""
    return text.rlike(DENIED)


def affirmed(text: Column) -> Column:
    """A condition without the negation that it starts with."""
    return F.regexp_replace(text, DENIED, "")


def parts(text: Column) -> Column:
    """struct<kind, parts> of a condition: ``or`` of alternatives, else ``and`` of requirements, else one ``clause``.

    "or less" belongs to a comparison and is masked before the split; a comma before "or" makes a list of words, which
    is no choice. Alternatives count if one of them has a number, requirements if all have.
    """
    cut = lambda t, word: F.filter(F.transform(F.split(t, rf"(?i)\s+{word}\s+", -1), _strip), lambda p: p != "")
    number = lambda p: p.rlike("[0-9]")
    alternatives = F.transform(cut(F.regexp_replace(text, OR_SUFFIX, f"{_MASK}$1"), "or"), lambda p: F.replace(p, F.lit(_MASK), F.lit(" or ")))
    requirements = cut(text, "and")
    either = ~text.rlike(LISTED_OR) & (F.size(alternatives) > 1) & F.exists(alternatives, number)
    both = (F.size(requirements) > 1) & F.forall(requirements, number)
    return F.when(either, F.struct(F.lit("or").alias("kind"), alternatives.alias("parts"))).when(both, F.struct(F.lit("and").alias("kind"), requirements.alias("parts"))).otherwise(F.struct(F.lit("clause").alias("kind"), F.array(text).alias("parts")))


def amount(text: Column) -> Column:
    """A printed number as a double; thousands are separated by commas. Null if there is none."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def unit_of(word: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in CANON.items() for x in pair))[F.lower(word)]


def _nearest(window: Column, ahead: bool) -> Column:
    """The quantity named nearest to a number that follows (``ahead`` false) or precedes the window; null if none is."""
    named = F.array(*(F.struct(F.lit(k).alias("order"), F.lit(name).alias("name"), F.lit(f"(?i){pattern}").alias("pattern")) for k, (name, pattern) in enumerate(QUANTITIES)))

    def hit(q: Column) -> Column:
        last = F.try_element_at(F.regexp_extract_all(window, q["pattern"], F.lit(0)), F.lit(-1))
        rest = F.char_length(F.element_at(F.split(window, q["pattern"], F.lit(-1)), -1))
        far = F.char_length(window) - rest - F.char_length(last) if ahead else rest
        return F.struct(F.when(last.isNotNull(), far).alias("far"), q["order"].alias("order"), q["name"].alias("name"))

    return F.array_min(F.filter(F.transform(named, hit), lambda h: h["far"].isNotNull()))["name"]


def comparison(text: Column) -> Column:
    """struct<subject, op, bound, unit> of a clause: written as an expression, or by the first phrase whose subject is found.

    A phrase's subject is the quantity nearest to it, on the side where such a phrase has it, else on the other. Null if
    the clause can't be read.
    """
    clause = F.regexp_replace(_strip(text), r"\.+$", "")
    made = lambda subject, op, bound, unit: F.struct(subject.alias("subject"), op.alias("op"), bound.alias("bound"), unit_of(unit).alias("unit"))
    out = F.lit(None)
    phrases = []
    for pattern, op, side in COMPARED:
        whole = rf"(?is)^(.*?)(?:{pattern})(.*)$"
        of = lambda k, whole=whole: F.regexp_extract(clause, whole, k)
        windows = (_nearest(of(1), False), _nearest(of(4), True))
        subject = F.coalesce(*(windows if side == "before" else windows[::-1]))
        phrases.append((clause.rlike(rf"(?is){pattern}"), subject, made(subject, F.lit(op), amount(of(2)), of(3))))
    for found, subject, value in reversed(phrases):
        out = F.when(found & subject.isNotNull(), value).otherwise(out)
    name = F.regexp_replace(F.lower(F.regexp_extract(clause, EXPLICIT, 1)), "[^a-z0-9]+", "_")
    explicit = made(F.regexp_replace(name, "^_+|_+$", ""), F.regexp_extract(clause, EXPLICIT, 2), amount(F.regexp_extract(clause, EXPLICIT, 3)), F.regexp_extract(clause, EXPLICIT, 4))
    out = F.when(clause.rlike(EXPLICIT), explicit).otherwise(out)
    return F.when(out["bound"].isNotNull(), out)


def holds(value: Column, op: Column, bound: Column) -> Column:
    return F.when(op == ">", value > bound).when(op == ">=", value >= bound).when(op == "<", value < bound).when(op == "<=", value <= bound).when(op == "==", value == bound).when(op == "!=", value != bound)


# Numbers that are no piece of a code, phrases of stated comparisons, units that convert, and negations.
NUMERAL = r"(?<![A-Za-z0-9.,-])([0-9][0-9,]*(?:\.[0-9]+)?)(?![0-9.]*[A-Za-z]\.[0-9])(?![A-Za-z0-9])"
_THE = r"(?:the\s+)?"
STATED = (
    (rf"\bis\s+not\s+(?:less|fewer)\s+than\s+{_THE}{NUMERAL}", ">=", "end"),
    (rf"\bis\s+not\s+(?:more|greater)\s+than\s+{_THE}{NUMERAL}", "<=", "end"),
    (rf"\b(?:not\s+less\s+than|no\s+less\s+than|not\s+fewer\s+than|no\s+fewer\s+than|at\s+least|a\s+minimum\s+of)\s+{_THE}{NUMERAL}", ">=", "end"),
    (rf"\b(?:not\s+more\s+than|no\s+more\s+than|not\s+greater\s+than|no\s+greater\s+than|does\s+not\s+exceed|do\s+not\s+exceed|not\s+exceeding|at\s+most|a\s+maximum\s+of)\s+{_THE}{NUMERAL}", "<=", "end"),
    (rf"{NUMERAL}[\s-]*(?:[a-z]+[\s-]+){{0,3}}?or\s+(?:more|greater|larger|higher|above|longer|wider)\b", ">=", "start"),
    (rf"{NUMERAL}[\s-]*(?:[a-z]+[\s-]+){{0,3}}?or\s+(?:less|fewer|lower|below|shorter|narrower)\b", "<=", "start"),
    (rf"\b(?:more\s+than|greater\s+than|in\s+excess\s+of|exceeds|exceeding|larger\s+than|higher\s+than|longer\s+than|wider\s+than)\s+{_THE}{NUMERAL}", ">", "end"),
    (rf"\b(?:less\s+than|fewer\s+than|lower\s+than|shorter\s+than|narrower\s+than)\s+{_THE}{NUMERAL}", "<", "end"),
)
INCHES = {"ft": 12.0, "feet": 12.0, "foot": 12.0, "in": 1.0, "inch": 1.0, "inches": 1.0, "mi": 63360.0, "mile": 63360.0, "miles": 63360.0, "yd": 36.0, "yard": 36.0, "yards": 36.0, "mm": 1 / 25.4, "millimeter": 1 / 25.4, "millimeters": 1 / 25.4, "meter": 1000 / 25.4, "meters": 1000 / 25.4, "km": 1e6 / 25.4, "kilometer": 1e6 / 25.4, "kilometers": 1e6 / 25.4}
SECONDS = {"second": 1.0, "seconds": 1.0, "sec": 1.0, "secs": 1.0, "minute": 60.0, "minutes": 60.0, "min": 60.0, "mins": 60.0, "hour": 3600.0, "hours": 3600.0, "hr": 3600.0, "hrs": 3600.0}
NEGATION = r"(?i)\b(?:not|no|never|neither|nor|none|without|cannot)\b|n't\b"
FRACTION = r"[0-9]\s*/\s*[0-9]|[¼-¾⅐-⅞]"
MULTIPLE = r"(?i)^\s*(?:times\b|x\b|×|percent\s+of\b|%\s+of\b)"


def _places(text: Column, pattern: str, op: str, number_at: str) -> Column:
    """array<struct<start, stop, low, high, op>> of the matches of a phrase, and of the number in each."""
    whole, number = (F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(k)), F.char_length) for k in (0, 1))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.char_length), F.lit(1), F.size(whole))
    at = lambda a, x: a["at"] + x["gap"]
    low = (lambda a, x: at(a, x) + x["size"] - x["number"]) if number_at == "end" else at
    none = "cast(array() as array<struct<start:int,stop:int,low:int,high:int,op:string>>)"
    return F.aggregate(
        F.arrays_zip(gaps.alias("gap"), whole.alias("size"), number.alias("number")),
        F.struct(F.lit(0).alias("at"), F.expr(none).alias("out")),
        lambda a, x: F.struct((at(a, x) + x["size"]).alias("at"), F.concat(a["out"], F.array(F.struct(at(a, x).alias("start"), (at(a, x) + x["size"]).alias("stop"), low(a, x).alias("low"), (low(a, x) + x["number"]).alias("high"), F.lit(op).alias("op")))).alias("out")),
        lambda a: a["out"],
    )


def _map(values: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key]


def stated_comparison(claims, *, claim: str = "claim", given: str = "given"):
    """``claims`` with status, value, value_unit, op, bound, bound_unit, phrase, confirmed_by of what a claim compares itself.

    Decided only where that is unambiguous: one phrase that compares, one other number, which a given text (array of
    struct<id, text>) states as well, both with units of one kind, no fraction, multiple or further negation. Else the
    status and all others are null; ``confirmed_by`` lists the ids that state the number.
    """
    text = F.coalesce(F.col(claim), F.lit(""))
    cut = lambda lo, hi=None: F.substring(text, lo + 1, (F.char_length(text) if hi is None else hi) - lo)
    found = F.concat(*(_places(text, f"(?i){p}", op, at) for p, op, at in STATED))
    numbers = _places(text, NUMERAL, "", "start")
    df = claims.withColumn("_found", found).withColumn("_numbers", numbers)
    inside = lambda f: F.exists("_found", lambda g: (g["start"] <= f["start"]) & (g["stop"] >= f["stop"]) & ((g["start"] != f["start"]) | (g["stop"] != f["stop"])))
    df = df.withColumn("_found", F.filter("_found", lambda f: ~inside(f)))
    spans = F.array_distinct(F.transform("_found", lambda f: F.struct(f["start"], f["stop"])))
    df = df.withColumn("_one", F.when((F.size(spans) == 1) & ~text.rlike(FRACTION), F.col("_found")[0]))
    one = F.col("_one")
    clear = ~cut(F.lit(0), one["start"]).rlike(NEGATION) & ~cut(one["stop"]).rlike(NEGATION) & ~cut(one["high"]).rlike(MULTIPLE)
    df = df.withColumn("_one", F.when(clear, one))
    value_of = lambda n: amount(cut(n["low"], n["high"]))
    others = F.filter("_numbers", lambda n: (n["start"] < one["start"]) | (n["start"] >= one["stop"]))
    df = df.withColumn("_others", F.when(one.isNotNull(), others))
    df = df.withColumn("_other", F.when(F.size(F.array_distinct(F.transform("_others", value_of))) == 1, F.col("_others")[0]))
    other = F.col("_other")

    def unit_after(at: Column) -> Column:
        word = F.lower(F.regexp_extract(cut(at), r"^[\s-]*([A-Za-z%]+)", 1))
        return F.when(word == "%", "percent").when(word != "", word)

    df = df.withColumn("_value", value_of(other)).withColumn("_bound", value_of(one)).withColumn("_v", unit_after(other["high"])).withColumn("_b", unit_after(one["high"]))
    states = lambda g: F.exists(F.regexp_extract_all(F.coalesce(g["text"], F.lit("")), F.lit(NUMERAL), F.lit(1)), lambda n: F.abs(amount(n) - F.col("_value")) < 1e-9)
    df = df.withColumn("_by", F.transform(F.filter(given, states), lambda g: g["id"]))
    v, b = F.col("_v"), F.col("_b")
    scaled = lambda kinds: F.struct((F.col("_value") * _map(kinds, v)).alias("value"), (F.col("_bound") * _map(kinds, b)).alias("bound"))
    length, time = _map(INCHES, v).isNotNull() & _map(INCHES, b).isNotNull(), _map(SECONDS, v).isNotNull() & _map(SECONDS, b).isNotNull()
    known = lambda u: _map(INCHES, u).isNotNull() | _map(SECONDS, u).isNotNull()
    same = ~(known(v) & known(b)) & (F.regexp_replace(v, "s+$", "") == F.regexp_replace(b, "s+$", ""))
    sides = F.when(length, scaled(INCHES)).when(time, scaled(SECONDS)).when(same, F.struct(F.col("_value").alias("value"), F.col("_bound").alias("bound")))
    df = df.withColumn("_sides", F.when(F.size("_by") > 0, sides))
    held = holds(F.col("_sides.value"), one["op"], F.col("_sides.bound"))
    decided = lambda c: F.when(held.isNotNull(), c)
    names = {"status": F.when(held, TRUE).when(~held, FALSE), "value": decided(F.col("_value")), "value_unit": decided(v), "op": decided(one["op"]), "bound": decided(F.col("_bound")), "bound_unit": decided(b), "phrase": decided(cut(one["start"], one["stop"])), "confirmed_by": decided(F.col("_by"))}
    return df.select(*claims.columns, *(c.alias(n) for n, c in names.items()))
