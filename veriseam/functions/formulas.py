"""Written arithmetic, evaluated in the JVM: tokens, postfix by a shunting yard, and a stack machine, all as array folds.

The grammar has numbers, names, ``+ - * / // % **``, signs, parentheses, and sqrt, abs, min, max, round, floor, ceil.
Nothing else can be reached. What can't be read, has an unknown name, divides by zero or isn't finite has no value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+)?"
TOKEN = rf"{NUMBER}|[A-Za-z_][A-Za-z0-9_]*\s*\(|[A-Za-z_][A-Za-z0-9_]*|\*\*|//|[-+*/%(),]"
#: Binding strength of operators; n and p are signs.
STRENGTH = {"+": 1, "-": 1, "*": 2, "/": 2, "//": 2, "%": 2, "n": 3, "p": 3, "**": 4}
#: Functions with one argument, and with two or more.
ONE, MANY = ("sqrt", "abs", "round", "floor", "ceil"), ("min", "max")
_STRINGS = "cast(array() as array<string>)"


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def _but_last(values: Column, n=1) -> Column:
    return F.slice(values, F.lit(1), F.greatest(F.lit(0), F.size(values) - n))


def _let(value: Column, of) -> Column:
    """``of(value)`` with the value worked out once."""
    return F.transform(F.array(value), of)[0]


def tokens(text: Column) -> Column:
    """The tokens of an expression; a function's name comes with its parenthesis. Null if anything is left over."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.regexp_replace(t, r"\s", ""))
    return F.when(F.array_join(found, "") == F.regexp_replace(text, r"[ \t\r\n]", ""), found)


def _is_number(t: Column) -> Column:
    return t.rlike(r"^\.?[0-9]")


def postfix(text: Column) -> Column:
    """The expression in postfix: numbers, names, operators (signs as n and p), and calls as ``name:arguments``. Null if it can't be read."""
    strength = F.create_map(*(F.lit(x) for pair in STRENGTH.items() for x in pair))
    keep = lambda a, **new: F.struct(*(new.get(k, a[k]).alias(k) for k in ("out", "ops", "counts", "operand", "ok")))

    def unwound(a: Column, until: Column | None = None) -> Column:
        """The operators on top that bind more than ``until`` go out; without it all down to a parenthesis."""
        n = F.size(a["ops"])
        stays = F.transform(a["ops"], lambda o: o.endswith("(") | (F.lit(False) if until is None else F.when(until == "**", strength[o] <= strength[until]).otherwise(strength[o] < strength[until])))
        kept = F.coalesce(F.array_max(F.filter(F.transform(stays, lambda s, i: F.when(s, i + 1)), lambda i: i.isNotNull())), F.lit(0))
        return _let(kept, lambda k: keep(a, out=F.concat(a["out"], F.reverse(F.slice(a["ops"], k + 1, n - k))), ops=F.slice(a["ops"], F.lit(1), k)))

    def step(a: Column, t: Column) -> Column:
        wrong = keep(a, ok=F.lit(False))
        value = keep(a, out=F.concat(a["out"], F.array(t)), operand=F.lit(False))
        sign = keep(a, ops=F.concat(a["ops"], F.array(F.when(t == "-", "n").otherwise("p"))))
        opened = keep(a, ops=F.concat(a["ops"], F.array(t)), counts=F.concat(a["counts"], F.array(F.lit(1))))
        binary = _let(unwound(a, t), lambda b: keep(b, ops=F.concat(b["ops"], F.array(t)), operand=F.lit(True)))
        closed = _let(unwound(a), lambda b: F.when(F.size(b["ops"]) == 0, keep(b, ok=F.lit(False))).otherwise(
            keep(b, ops=_but_last(b["ops"]), counts=_but_last(b["counts"]), out=F.when(_last(b["ops"]) == "(", b["out"]).otherwise(F.concat(b["out"], F.array(F.concat(F.regexp_replace(_last(b["ops"]), r"\($", ":"), _last(b["counts"]).cast("string"))))))
        ))
        comma = _let(unwound(a), lambda b: F.when(F.coalesce(_last(b["ops"]), F.lit("(")) == "(", keep(b, ok=F.lit(False))).otherwise(keep(b, counts=F.concat(_but_last(b["counts"]), F.array(_last(b["counts"]) + 1)), operand=F.lit(True))))
        want = a["operand"]
        return (
            F.when(~a["ok"], a)
            .when(t.endswith("("), F.when(want, opened).otherwise(wrong))
            .when(t.isin("+", "-") & want, sign)
            .when(t == ")", F.when(want, wrong).otherwise(closed))
            .when(t == ",", F.when(want, wrong).otherwise(comma))
            .when(t.isin(*STRENGTH) & ~t.isin("n", "p"), F.when(want, wrong).otherwise(binary))
            .when(want & ~(t.rlike(r"^0[0-9_]*[1-9]") & ~t.rlike(r"[.eE]")), value)
            .otherwise(wrong)
        )

    start = F.struct(F.expr(_STRINGS).alias("out"), F.expr(_STRINGS).alias("ops"), F.expr("cast(array() as array<int>)").alias("counts"), F.lit(True).alias("operand"), F.lit(True).alias("ok"))
    end = lambda a: _let(unwound(a), lambda b: F.when(b["ok"] & ~b["operand"] & (F.size(b["ops"]) == 0), b["out"]))
    return F.aggregate(tokens(text), start, step, end)


def run(postfix_: Column, values: Column) -> Column:
    """struct<value, problem> of a postfix expression over map<string, double>; problem is null, ``unknown name`` or ``no number``."""
    nan = F.lit(float("nan"))

    def binary(t: Column, x: Column, y: Column) -> Column:
        rest = x % F.when(y != 0, y)
        rest = F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest)
        power = F.pow(x, y)
        power = F.when((x == 0) & (y < 0), None).when(F.isnan(power), None).when(F.abs(power) == float("inf"), F.when(F.abs(x) == float("inf"), power)).otherwise(power)
        return (
            F.when(t == "+", x + y).when(t == "-", x - y).when(t == "*", x * y).when(t == "/", x / F.when(y != 0, y))
            .when(t == "//", F.rint((x - rest) / F.when(y != 0, y))).when(t == "%", rest).when(t == "**", power)
        )

    def call(name: Column, args: Column) -> Column:
        x = args[0]
        whole = F.when(F.abs(x) < float("inf"), x)
        one = F.when(name == "sqrt", F.when(x >= 0, F.sqrt(x))).when(name == "abs", F.abs(x)).when(name == "round", F.rint(whole)).when(name == "floor", F.when(F.abs(whole) < 2.0**52, F.floor(whole).cast("double")).otherwise(whole)).when(name == "ceil", F.when(F.abs(whole) < 2.0**52, F.ceil(whole).cast("double")).otherwise(whole))
        return F.when(name.isin(*ONE), F.when(F.size(args) == 1, one)).when(name == "min", F.when(F.size(args) > 1, F.array_min(args))).when(name == "max", F.when(F.size(args) > 1, F.array_max(args)))

    put = lambda a, n, v: F.struct(F.concat(_but_last(a["stack"], n), F.array(v)).alias("stack"), F.when(a["problem"].isNotNull(), a["problem"]).when(v.isNull(), "no number").alias("problem"))

    def step(a: Column, t: Column) -> Column:
        top, below = _last(a["stack"]), F.try_element_at(a["stack"], F.lit(-2))
        n = F.substring_index(t, ":", -1).cast("int")
        named = F.try_element_at(values, t)
        return (
            F.when(a["problem"].isNotNull(), a)
            .when(_is_number(t), put(a, 0, F.regexp_replace(t, "_", "").cast("double")))
            .when(t == "n", put(a, 1, -top))
            .when(t == "p", a)
            .when(t.isin(*STRENGTH), _let(binary(t, below, top), lambda v: put(a, 2, v)))
            .when(t.contains(":"), _let(call(F.substring_index(t, ":", 1), F.slice(a["stack"], F.size(a["stack"]) - n + 1, n)), lambda v: put(a, n, v)))
            .when(named.isNull(), F.struct(a["stack"].alias("stack"), F.lit("unknown name").alias("problem")))
            .otherwise(put(a, 0, named))
        )

    start = F.struct(F.expr("cast(array() as array<double>)").alias("stack"), F.lit(None).cast("string").alias("problem"))
    finite = lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return F.aggregate(postfix_, start, step, lambda a: F.struct(F.when(a["problem"].isNull(), finite(F.coalesce(_last(a["stack"]), nan))).alias("value"), F.coalesce(a["problem"], F.when(finite(F.coalesce(_last(a["stack"]), nan)).isNull(), "no number")).alias("problem")))


def evaluate(text: Column, values: Column) -> Column:
    """struct<value, problem> of a written expression; problem is null, ``unreadable``, ``unknown name`` or ``no number``."""
    unreadable = F.struct(F.lit(None).cast("double").alias("value"), F.lit("unreadable").alias("problem"))
    return _let(postfix(text), lambda p: F.coalesce(run(p, values), unreadable))


def variables(text: Column) -> Column:
    """The names that an expression reads, sorted; none if it can't be read."""
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(postfix(text), lambda t: t.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~t.isin("n", "p")))), F.expr(_STRINGS))


def stated_formulas(text: Column) -> Column:
    """array<struct<variable, expression>> of the formulas in a note, as in ``S = 3*sqrt(R-50)``; prose is none."""
    pattern = r"\b([A-Z])\s*=\s*([0-9A-Za-z_+\-*/^(). ]{2,80}?)(?=[.;,]\s|[.;,]?$)"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("variable"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("expression"))
    made = F.transform(both, lambda x: F.struct(x["variable"].alias("variable"), F.replace(F.trim(x["expression"]), F.lit("^"), F.lit("**")).alias("expression")))
    prose = lambda e: F.regexp_replace(e, r"\bsqrt\b", "").rlike("[A-Za-z]{3,}")
    return F.filter(made, lambda x: x["expression"].rlike("[0-9]") & ~prose(x["expression"]) & postfix(x["expression"]).isNotNull())


# Unit words behind a number, in the order they count, and characters of written arithmetic.
UNIT_WORDS = (r"square\s+(?:feet|foot|ft)|sq\.?\s*(?:ft|feet)\.?", r"square\s+(?:inches|inch|in)|sq\.?\s*in\.?", r"inches|inch|in\.?(?=\s*[x×*/=])", r"feet|foot|ft\.?", r"miles|mile|mi\.?", r"mph|km/h", r"seconds|second|sec\.?|s", r"meters|metres|m")
ARITHMETIC = r"0-9.,()+\-*/^ ×÷−²³x"
#: A character for each unit that no text has.
MARKS = [chr(0xE400 + k) for k in range(len(UNIT_WORDS))]
SQUARES = MARKS[:2]
SQUARED = {MARKS[2]: MARKS[1], MARKS[3]: MARKS[0]}


def arithmetic_checks(text: Column) -> Column:
    """array<struct<expression, stated, computed, holds>> of every ``expression = number`` that a text writes out.

    Ranges, stations, formulas with letters and conversions between units are none, nor is a result that goes on as
    more arithmetic. A result may be rounded to the digits it shows, or by half a percent; before a percent sign it may
    be the share or a hundred times that.
    """
    for words, mark in zip(UNIT_WORDS, MARKS, strict=True):
        text = F.regexp_replace(text, rf"(?i)(?<=[0-9])(\s?)(?:{words})(?![A-Za-z0-9])", f"$1{mark}")
    marks = "".join(MARKS)
    pattern = rf"([{ARITHMETIC}{marks}]*)=(?=\s*([-−]?[0-9][0-9,]*(?:\.[0-9]+)?)(?![0-9.,]*[0-9])((?s:.{{0,80}})))"
    left, stated, rest = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2, 3))
    goes_on = rf"^\s*[{marks}]?\s*(?:[+*/^×÷]|x\s*[0-9]|[-−]\s*[0-9])"
    squares = F.create_map(*(F.lit(x) for pair in SQUARED.items() for x in pair))

    def made(x: Column) -> Column:
        units = F.regexp_extract_all(x["left"], F.lit(f"[{marks}]"), F.lit(0))
        unit = F.regexp_extract(x["rest"], rf"^\s*([{marks}])", 1)
        e = F.trim(F.regexp_replace(F.regexp_replace(x["left"], f"[{marks}]", ""), r"^[)+*/^ ×÷]+", ""))
        e = F.when(e.rlike("^[-−]") & ~e.rlike(r"^[-−]\s*[0-9]"), F.trim(F.substring(e, F.lit(2), F.char_length(e)))).otherwise(e)
        converts = (unit != "") & ~F.coalesce(F.exists(units, lambda u: squares[u] == unit), F.lit(False)) & ((F.size(units) > 0) & ~F.array_contains(units, unit) | unit.isin(*SQUARES) & ~F.exists(units, lambda u: u.isin(*SQUARES)))
        p = F.regexp_replace(e, r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")
        p = F.regexp_replace(p, r"(?<=[0-9)\s])x(?=[\s0-9(])", "*")
        odd = ~e.rlike(r"[0-9]\s*(?:[+*/^×÷−-]|\sx\s|²|³)") | ~e.rlike(r"^[0-9(−-]") | e.rlike(r"[0-9]-[0-9]") | e.rlike(r"[0-9]\+[0-9]{2}(?![0-9.])") | p.rlike("[A-Za-z,]")
        p = F.regexp_replace(F.regexp_replace(F.translate(p, "×÷−", "*/-"), "²", "**2"), "³", "**3")
        p = F.replace(p, F.lit("^"), F.lit("**"))
        free = p.rlike(r"//|\*\*(?!\s*(?:[0-3](?:\.[0-9]*)?|4(?:\.0*)?)(?![0-9.])(?!\s*\*\*))")
        number = F.regexp_replace(F.replace(x["stated"], F.lit(","), F.lit("")), "−", "-")
        skip = x["rest"].rlike(goes_on) | converts | odd | free
        return F.when(~skip, F.struct(e.alias("expression"), p.alias("formula"), number.alias("number"), x["rest"].alias("rest")))

    found = F.transform(F.arrays_zip(left.alias("left"), stated.alias("stated"), rest.alias("rest")), made)
    none = F.expr("cast(map() as map<string,double>)")
    valued = F.transform(F.filter(found, lambda f: f.isNotNull()), lambda f: F.struct(f.alias("f"), evaluate(f["formula"], none)["value"].alias("value")))

    def judged(x: Column) -> Column:
        f, v = x["f"], x["value"]
        decimals = F.when(f["number"].contains("."), F.char_length(F.substring_index(f["number"], ".", -1))).otherwise(0)
        near = lambda by, more: F.abs(v - f["number"].cast("double") / by) <= F.greatest(0.5 * F.pow(F.lit(10.0), -(decimals + more).cast("double")) + 1e-9, 0.005 * F.abs(v))
        percent = f["rest"].rlike(r"(?i)^\s*(?:%|percent\b|per cent\b)")
        return F.struct(f["expression"].alias("expression"), f["number"].cast("double").alias("stated"), F.round(v, 6).alias("computed"), (near(1, 0) | percent & near(100, 2)).alias("holds"))

    return F.transform(F.filter(valued, lambda x: x["value"].isNotNull()), judged)
