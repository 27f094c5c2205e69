"""Written arithmetic against Python's own parser."""

import ast
import math
import operator

from pyspark.sql import functions as F

from veriseam.functions import formulas

VALUES = {"R": 450.0, "W": 12.0, "S": 55.0, "x_1": -2.5}
TEXTS = [
    "3*sqrt(R-50)", "W*S**2/60", "W * S", "-2**2", "2**-1", "2**3**2", "-(R)", "+-+3", "7//2", "-7//2", "7%-3", "-7 % 3", "7.5 // 0.5",
    "min(1, 2, W)", "max(min(R, W), S, 3)", "round(2.5)", "round(3.5)", "round(-0.5)", "floor(-2.1)", "ceil(2.1)", "abs(x_1)", "1_000 + 1", "1e3", ".5+.5", "5.", "2 ** 0.5",
    "1/0", "1//0", "1%0", "0**-1", "(-8)**0.5", "sqrt(-1)", "10.0**400", "1e308*10", "1/(1e308*10)", "(1e308*10) - (1e308*10)", "1e308*10 // 3",
    "R +", "", " ", "()", "sqrt()", "sqrt(1,2)", "min(1)", "round(1, 2)", "(1, 2)", "1 2", "R R", "2(3)", "(2", "2)", "a.b", "foo(1)", "Q + 1", "1 < 2", "012 + 1", "00", "0.5e-1", "1,2", "max(1,,2)", "sqrt (4)", "2*-3", "2- -3", "8 / 4 / 2", "8 - 4 - 2", "(1 + 2) * (3 - (4 + 5))", "S = 3", "R**W**0",
]
OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod}
CALLS = {"sqrt": math.sqrt, "abs": abs, "min": min, "max": max, "round": round, "floor": math.floor, "ceil": math.ceil}


def by_tree(text):
    def walk(n):
        if isinstance(n, ast.Constant):
            return float(n.value)
        if isinstance(n, ast.Name):
            return VALUES[n.id]
        if isinstance(n, ast.BinOp):
            return float(OPS[type(n.op)](walk(n.left), walk(n.right)))
        if isinstance(n, ast.UnaryOp):
            return -walk(n.operand) if isinstance(n.op, ast.USub) else walk(n.operand)
        if isinstance(n, ast.Call):
            return float(CALLS[n.func.id](*map(walk, n.args)))
        raise ValueError(n)

    try:
        v = walk(ast.parse(text.strip(), mode="eval").body)
    except Exception:
        return None
    return v if math.isfinite(v) else None


def test_values_are_those_of_the_tree(spark):
    values = F.create_map(*(F.lit(x) for pair in VALUES.items() for x in pair))
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string").withColumn("made", formulas.evaluate(F.col("text"), values))
    rows = {r["text"]: r["made"] for r in df.collect()}
    assert {t: rows[t]["value"] for t in TEXTS} == {t: by_tree(t) for t in TEXTS}
    assert all((r["problem"] is None) == (r["value"] is not None) for r in rows.values())
    assert rows["Q + 1"]["problem"] == "unknown name" and rows["R +"]["problem"] == "unreadable" and rows["1/0"]["problem"] == "no number"


def test_names_and_formulas_of_notes(spark):
    notes = ["Values come from the formula S=3*sqrt(R-50).", "L = taper length in feet; L = W*S^2/60, where W is 12", "A = 2*B + 1", "S = spacing", "V = 3 +", None]
    df = spark.createDataFrame(list(enumerate(notes)), "k int, text string")
    got = [[tuple(x) for x in r["f"] or []] for r in df.select("k", formulas.stated_formulas(F.col("text")).alias("f")).orderBy("k").collect()]
    assert got == [[("S", "3*sqrt(R-50)")], [("L", "W*S**2/60")], [("A", "2*B + 1")], [], [], []]
    names = spark.createDataFrame([("W*S**2/sqrt(W)",), ("1 +",)], "text string").select(formulas.variables(F.col("text"))).collect()
    assert [r[0] for r in names] == [["S", "W"], []]


CHECKS = {
    "Here 12 x 35 = 420 in all": [("12 x 35", 420.0, True)],
    "12 x 35 = 421": [("12 x 35", 421.0, True)],
    "12 x 35 = 430.": [("12 x 35", 430.0, False)],
    "100 ft x 0.5 = 50 ft": [("100  x 0.5", 50.0, True)],
    "1,000 + 2,500 = 3,500": [("1,000 + 2,500", 3500.0, True)],
    "= 5 + 1 = 6": [("5 + 1", 6.0, True)],
    "2 + 2 = 5 + 1 = 6": [("5 + 1", 6.0, True)],
    "5² = 25 and 2^3 = 9": [("5²", 25.0, True), ("2^3", 9.0, False)],
    "60/80 = 75%": [("60/80", 75.0, True)],
    "60 / 80 = 0.75 percent": [("60 / 80", 0.75, True)],
    "10/3 = 3.33": [("10/3", 3.33, True)],
    "36 x 36 inches = 9 square feet": [],
    "36 in x 36 in = 1,296 square inches": [("36  x 36", 1296.0, True)],
    "pages 20-50 = 30": [],
    "station 10+50 = 60": [],
    "Q = AB^2/7 = 3": [("2/7", 3.0, False)],
    "2^5 = 32": [],
    "1/0 = 5": [],
    "(2 + 3) × 4 ÷ 2 = 10": [("(2 + 3) × 4 ÷ 2", 10.0, True)],
    "(2 + 3 = 5": [],
    "3 = 3": [],
    "−3 − 4 = −7": [("−3 − 4", -7.0, True)],
    "": [],
}


def test_arithmetic_of_texts(spark):
    df = spark.createDataFrame([(t,) for t in CHECKS] + [(None,)], "text string")
    got = {r["text"]: [(x["expression"], x["stated"], x["holds"]) for x in r["c"] or []] for r in df.select("text", formulas.arithmetic_checks(F.col("text")).alias("c")).collect()}
    assert got == {**CHECKS, None: []}
