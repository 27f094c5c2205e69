"""Queries over conditions in words and written arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas, rules as R
from ..operators import rules
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

RULES = (
    "The major-street speed exceeds {a} mph.",
    "Community less than {n} population or above {a} mph on major street",
    "not speeds of {a} mph or less",
    "speed at least {a} mph and width under {b} ft",
    "a posted, statutory, or 85th-percentile speed of {a} mph or higher",
    "may be used on low-volume roadways or roadways with speeds of {a} mph or less",
    "lane_width >= {b} ft",
    "the shoulder is paved",
)


def _rules(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.element_at(F.array(*map(F.lit, RULES)), (k % len(RULES) + 1).cast("int"))
    numbers = {"{a}": (k % 60).cast("string"), "{b}": (k % 14).cast("string"), "{n}": F.concat((k % 9 + 1).cast("string"), F.lit(",000"))}
    for mark, number in numbers.items():
        text = F.replace(text, F.lit(mark), number)
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_nationkey").alias("case"), text.alias("text"))


def _facts(spark, sf_dir):
    """Of each nation what its suppliers make of it: a speed where the key isn't a multiple of 3, a population, a width in feet or inches."""
    of = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("case")).agg(F.min("s_suppkey").alias("s"), F.count("*").alias("n"))
    speed = F.when(F.col("case") % 3 != 0, F.struct(F.lit("Major-street speed").alias("name"), (F.col("s") % 70).cast("double").alias("value"), F.lit("mph").alias("unit")))
    people = F.struct(F.lit("population").alias("name"), (F.col("n") * 1000).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"))
    width = F.struct(F.lit("lane width").alias("name"), F.when(F.col("case") % 2 == 0, F.col("s") % 14).otherwise(F.col("s") % 14 * 12).cast("double").alias("value"), F.when(F.col("case") % 2 == 0, "ft").otherwise("in").alias("unit"))
    return of.select("case", F.inline(F.array_compact(F.array(speed, people, width))))


_SQL_FACTS = """f as (select s_nationkey as c, case when s_nationkey % 3 <> 0 then min(s_suppkey) % 70 end as speed, count(*) * 1000 as people, min(s_suppkey) % 14 as width from supplier group by 1),
r as (select c_custkey as id, c_nationkey as c, c_custkey % 8 as k, c_custkey % 60 as a, c_custkey % 14 as b, (c_custkey % 9 + 1) * 1000 as n from customer)"""


def q95_rule_clauses(spark, sf_dir):
    """The clauses of every customer's rule, counted by how they are read."""
    clauses = rules.parse(_rules(spark, sf_dir))
    return clauses.groupBy("kind", "denied", "subject", "op", "unit").agg(F.count("*").alias("n"), F.sum("bound").alias("bounds"))


SQL["q95_rule_clauses"] = f"""with {_SQL_FACTS},
x as (select 'clause' as kind, false as denied, 'major_street_speed' as subject, '>' as op, 'mph' as unit, a as bound from r where k = 0
 union all select 'or', false, 'population', '<', null, n from r where k = 1 union all select 'or', false, 'major_street_speed', '>', 'mph', a from r where k = 1
 union all select 'clause', true, 'speed', '<=', 'mph', a from r where k = 2
 union all select 'and', false, 'speed', '>=', 'mph', a from r where k = 3 union all select 'and', false, 'width', '<', 'ft', b from r where k = 3
 union all select 'clause', false, 'speed', '>=', 'mph', a from r where k = 4
 union all select 'or', false, null, null, null, null from r where k = 5 union all select 'or', false, 'speed', '<=', 'mph', a from r where k = 5
 union all select 'clause', false, 'lane_width', '>=', 'ft', b from r where k = 6 union all select 'clause', false, null, null, null, null from r where k = 7)
select kind, denied, subject, op, unit, count(*) as n, sum(bound)::double as bounds from x group by all"""


def q96_rule_verdicts(spark, sf_dir):
    """Whether every customer's rule holds for the facts of the nation."""
    return rules.evaluate(_rules(spark, sf_dir), _facts(spark, sf_dir))


SQL["q96_rule_verdicts"] = f"""with {_SQL_FACTS},
v as (select id, r.c, case k when 0 then speed > a when 1 then people < n or speed > a when 2 then not speed <= a when 3 then speed >= a and width < b when 4 then speed >= a when 5 then (null::boolean or speed <= a) when 6 then width >= b end as v from r left join f on f.c = r.c)
select id, c as "case", case when v is null then 'UNKNOWN' when v then 'TRUE' else 'FALSE' end as status from v"""

CLAIMS = (
    "The flow of {v} units per hour is {b} units per hour or more.",
    "The zone of {v} feet is not more than {b} feet.",
    "The {v}-foot arm is longer than {b} yards.",
    "The phase of {v} seconds is at least {b} minutes",
    "The zone of {v} feet is not at least {b} feet.",
    "The zone of {v} feet is at least {b} minutes.",
)


def q97_stated_comparisons(spark, sf_dir):
    """Comparisons that claims about orders state themselves, with the value given or not."""
    k = F.col("o_orderkey")
    v, b = (k % 90 + 10).cast("string"), (k % 37 + 3).cast("string")
    text = F.replace(F.replace(F.element_at(F.array(*map(F.lit, CLAIMS)), (k % len(CLAIMS) + 1).cast("int")), F.lit("{v}"), v), F.lit("{b}"), b)
    given = F.array(F.struct(F.lit("g1").alias("id"), F.concat(F.lit("It is "), F.when(k % 7 == 0, F.lit("unknown")).otherwise(v), F.lit(" in all.")).alias("text")), F.struct(F.lit("g2").alias("id"), F.lit("No number here, but R1-10.").alias("text")))
    claims = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("claim"), given.alias("given"))
    made = R.stated_comparison(claims)
    return made.select("o_orderkey", "status", "value", "value_unit", "op", "bound", "bound_unit", "phrase", F.array_join("confirmed_by", ",").alias("confirmed_by"))


SQL["q97_stated_comparisons"] = """with o as (select o_orderkey, o_orderkey % 6 as k, (o_orderkey % 90 + 10)::double as v, (o_orderkey % 37 + 3)::double as b, o_orderkey % 7 <> 0 as ok from orders),
d as (select *, case when ok and k < 4 then case k when 0 then v >= b when 1 then v <= b when 2 then v * 12 > b * 36 else v >= b * 60 end end as held from o)
select o_orderkey, case when held is null then null when held then 'TRUE' else 'FALSE' end as status, case when held is not null then v end as value,
 case when held is not null then (['units', 'feet', 'foot', 'seconds'])[(k + 1)::int] end as value_unit, case when held is not null then (['>=', '<=', '>', '>='])[(k + 1)::int] end as op, case when held is not null then b end as bound,
 case when held is not null then (['units', 'feet', 'yards', 'minutes'])[(k + 1)::int] end as bound_unit,
 case when held is not null then case k when 0 then b::bigint || ' units per hour or more' when 1 then 'is not more than ' || b::bigint when 2 then 'longer than ' || b::bigint else 'at least ' || b::bigint end end as phrase,
 case when held is not null then 'g1' end as confirmed_by from d"""

FORMULAS = ("3*sqrt(R-50)", "W*S**2/60", "-W**2 + S % 7", "max(R, W, S) // (W - 5)", "round(S/2) - ceil(R/4)", "W*(S", "Q + 1", "min(R, S)**0.5 / (R - R)")


def q98_formula_values(spark, sf_dir):
    """Written formulas over the columns of lines; what has no value says why."""
    k, w, s, r = F.col("l_partkey"), F.col("l_linenumber").cast("double"), F.col("l_quantity").cast("double"), (F.col("l_suppkey") % 100).cast("double")
    text = F.element_at(F.array(*map(F.lit, FORMULAS)), (k % len(FORMULAS) + 1).cast("int"))
    # what stands in many lines is worked out once
    asked = table(spark, sf_dir, "lineitem").groupBy(text.alias("formula"), w.alias("W"), s.alias("S"), r.alias("R")).agg(F.count("*").alias("n")).repartition(spark.sparkContext.defaultParallelism)
    made = formulas.evaluate(F.col("formula"), F.create_map(F.lit("W"), "W", F.lit("S"), "S", F.lit("R"), "R"))
    lines = asked.select("formula", "n", made.alias("made"))
    return lines.groupBy("formula", "made.problem").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("made.value") * F.col("n")), 3).alias("total"))


SQL["q98_formula_values"] = f"""with l as (select l_partkey % 8 as k, l_linenumber::double as w, l_quantity::double as s, (l_suppkey % 100)::double as r from lineitem),
v as (select ([{", ".join(f"'{f}'" for f in FORMULAS)}])[(k + 1)::int] as formula, k, case k when 0 then case when r >= 50 then 3 * sqrt(r - 50) end when 1 then w * s * s / 60 when 2 then -(w * w) + s % 7
 when 3 then case when w <> 5 then floor(greatest(r, w, s) / (w - 5)) end when 4 then round_even(s / 2, 0) - ceil(r / 4) end as v from l)
select formula, case when k = 5 then 'unreadable' when k = 6 then 'unknown name' when v is null then 'no number' end as problem, count(*) as n, round(sum(v), 3) as total from v group by all"""


def q99_written_arithmetic(spark, sf_dir):
    """Products, sums and quotients that texts about lines write out, right, rounded or wrong; conversions and ranges are none."""
    q, t, k = F.col("l_quantity").cast("long"), (F.col("l_partkey") % 97 + 2).cast("long"), F.col("l_orderkey") % 6
    text = (
        F.when(k == 0, F.format_string("Sold %d x %d = %d in all.", q, t, q * t + F.col("l_linenumber") - 1))
        .when(k == 1, F.format_string("With %d ft + %d ft = %d ft it fits", q, t, q + t))
        .when(k == 2, F.format_string("(%d + %d) × 2 = %d; %d/8 = %.2f", q, t, (q + t) * 2, t, F.round(t / 8, 2)))
        .when(k == 3, F.format_string("pages %d-%d = %d", q, t, q))
        .when(k == 4, F.format_string("%d x %d inches = %d square feet", q, t, q * t))
        .otherwise(F.format_string("%d/50 = %d%%", q, q * 2))
    )
    # a text that stands in many lines is checked once
    texts = table(spark, sf_dir, "lineitem").groupBy(k.alias("k"), text.alias("text")).agg(F.count("*").alias("n")).repartition(spark.sparkContext.defaultParallelism)
    found = texts.select("k", "n", F.explode(formulas.arithmetic_checks(F.col("text"))).alias("c"))
    return found.groupBy("k", "c.holds").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("c.stated") * F.col("n")), 2).alias("stated"), F.round(F.sum(F.col("c.computed") * F.col("n")), 2).alias("computed"))


SQL["q99_written_arithmetic"] = """with l as (select l_orderkey % 6 as k, l_quantity::bigint as q, l_partkey % 97 + 2 as t, l_linenumber - 1 as d from lineitem),
c as (select k, (q * t + d)::double as stated, (q * t)::double as v, 0.5 as tol from l where k = 0 union all select k, q + t, q + t, 0.5 from l where k = 1 union all select k, (q + t) * 2, (q + t) * 2, 0.5 from l where k = 2
 union all select k, round(t / 8.0 + 1e-12, 2), t / 8.0, 0.005 from l where k = 2 union all select k, q * 2, q / 50.0, 0.5 from l where k = 5)
select k, case when k = 5 then true else abs(v - stated) <= greatest(tol + 1e-9, 0.005 * abs(v)) end as holds, count(*) as n, round(sum(stated), 2) as stated, round(sum(round(v, 6)), 2) as computed from c group by all"""

for _name, _f in list(globals().items()):
    if _name[:1] == "q" and _name[1:3].isdigit():
        QUERIES[_name] = _f
