"""Queries over places on a line or a page, over calls and over lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lists
from ..operators import asof, packing
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _lines(spark, sf_dir, *columns):
    """One row for each line number of an order."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in columns))


def _sql_lines(*columns):
    return "l as (select l_orderkey, l_linenumber, " + ", ".join(f"min({c}) as {c}" for c in columns) + " from lineitem group by all)"


def q103_span_resolution(spark, sf_dir):
    """The chunks that two units of each order cover: one found in its text, one known by the chunks it names."""
    marks = _lines(spark, sf_dir, "l_partkey").select("l_orderkey", (F.col("l_linenumber") * 10).cast("double").alias("at"), F.concat(F.lit("c"), (F.col("l_partkey") % 5).cast("string")).alias("chunk"))
    low, k = F.col("o_custkey") % 70, F.col("o_orderkey")
    found = F.struct(F.lit(0).alias("span"), low.alias("low"), (low + k % 30).alias("high"), F.array().cast("array<string>").alias("explicit"))
    named = F.struct(F.lit(1).alias("span"), F.lit(None).cast("bigint").alias("low"), F.lit(None).cast("bigint").alias("high"), F.array(F.concat(F.lit("c"), (k % 7).cast("string")), F.concat(F.lit("c"), (F.col("o_custkey") % 5).cast("string"))).alias("explicit"))
    units = table(spark, sf_dir, "orders").select(k.alias("l_orderkey"), F.inline(F.array(found, named)))
    return asof.resolve_spans(units, marks, key="l_orderkey").select("l_orderkey", "span", F.array_join("chunks", ",").alias("chunks"), "how")


SQL["q103_span_resolution"] = f"""with {_sql_lines("l_partkey")},
m as (select l_orderkey as k, l_linenumber * 10 as pos, 'c' || (l_partkey % 5) as chunk from l), o as (select o_orderkey as k, o_custkey % 70 as low, o_custkey % 70 + o_orderkey % 30 as high, 'c' || (o_orderkey % 7) as a, 'c' || (o_custkey % 5) as b from orders),
f as (select o.k, low, high, coalesce(max(pos) filter (where pos <= low), min(pos)) as first from o left join m using (k) group by all),
c as (select f.k, chunk, min(pos) as pos from f join m on m.k = f.k and m.pos >= f.first and m.pos < f.high group by all),
s as (select k, string_agg(chunk, ',' order by pos) as chunks from c group by k),
e as (select o.k, o.a, o.b, count(*) filter (where chunk = a) > 0 as has_a, count(*) filter (where chunk = b) > 0 as has_b from o left join m using (k) group by all)
select o.k as l_orderkey, 0 as span, coalesce(chunks, '') as chunks, 'span' as how from o left join s using (k)
union all select k, 1, concat_ws(',', case when has_a then a end, case when has_b and a <> b then b end), 'explicit' from e"""


def q104_caption_owners(spark, sf_dir):
    """Which captions of an order own each of its items: the nearest above, or one that begins just below."""
    rows = _lines(spark, sf_dir, "l_partkey", "l_quantity").withColumn("y", (F.col("l_partkey") % 50).cast("double"))
    captions = rows.select("l_orderkey", F.col("l_linenumber").alias("caption"), F.col("l_quantity").cast("double").alias("at"))
    return asof.owners(rows.select("l_orderkey", F.col("l_linenumber").alias("item"), F.col("y").alias("at")), captions, key="l_orderkey", pad=3.0)


SQL["q104_caption_owners"] = f"""with {_sql_lines("l_partkey", "l_quantity")},
i as (select l_orderkey, l_linenumber as item, l_partkey % 50 as y from l), c as (select l_orderkey, l_linenumber as caption, l_quantity as pos from l),
a as (select i.l_orderkey, item, y, max(pos) filter (where pos <= y) as above from i join c using (l_orderkey) group by all)
select a.l_orderkey, item, caption from a join c on c.l_orderkey = a.l_orderkey and (c.pos = a.above or c.pos > a.y and c.pos <= a.y + 3)"""


def q105_caption_regions(spark, sf_dir):
    """What each caption of an order heads on its page."""
    flag = F.col("l_returnflag")  # the least of a line as a number: least strings are found by sorting
    flags = F.when(flag < "R", 0).when(flag == "R", 1).when(flag > "R", 2)
    lines = table(spark, sf_dir, "lineitem")
    n = lines.count()
    rows = asof.dealt(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), n, "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.min(flags).alias("flag"))
    top = ((F.col("l_partkey") % 140) * 5).cast("double")
    captions = rows.select("l_orderkey", F.col("l_linenumber").alias("caption"), top.alias("top"), (top + 12.0).alias("foot"), ((F.col("l_suppkey") % 5) * 110 + 40).cast("double").alias("left"), (F.col("flag") == 1).alias("inset"))
    return asof.regions(captions, key="l_orderkey", width=612.0, height=792.0, n=n)


SQL["q105_caption_regions"] = f"""with {_sql_lines("l_partkey", "l_suppkey", "l_returnflag")},
c as (select l_orderkey, l_linenumber as caption, (l_partkey % 140) * 5.0::double as t, ((l_suppkey % 5) * 110 + 40)::double as x, l_returnflag = 'R' as inset from l),
p as (select a.l_orderkey, a.caption, a.t, a.x, a.inset, min(b.t) filter (where b.t > a.t + 13) as next, min(b.x) filter (where b.caption <> a.caption and abs(a.t - b.t) < 6 and b.x > a.x) as r,
 coalesce(bool_or(b.x < a.x) filter (where b.caption <> a.caption and abs(a.t - b.t) < 6), false) as has_left from c a join c b using (l_orderkey) group by all),
g as (select l_orderkey, caption, case when has_left then greatest(case when inset then greatest(36, x - 10) else 36 end, x - 10) when inset then greatest(36, x - 10) else 36 end::double as x0, t + 14 as y0, least(576, coalesce(r - 8, 576))::double as x1, least(752, coalesce(next - 4, 752))::double as y1 from p)
select * from g where y1 - y0 >= 40 and x1 - x0 >= 80"""

CAP = 2


def q106_call_plan(spark, sf_dir):
    """The lines of each order packed into calls by part family, two decisions a call."""
    rows = _lines(spark, sf_dir, "l_partkey", "l_returnflag")
    items = rows.select(F.col("l_orderkey").alias("question"), F.col("l_linenumber").alias("rank"), F.col("l_linenumber").alias("item"), F.concat(F.lit("s"), (F.col("l_partkey") % 4).cast("string")).alias("section"), (F.col("l_returnflag") != "N").alias("decided"), (-F.col("l_linenumber")).alias("place"))
    return packing.plan_calls(items, cap=CAP).withColumn("call", F.col("call").cast("long"))


SQL["q106_call_plan"] = f"""with recursive {_sql_lines("l_partkey", "l_returnflag")},
i as (select l_orderkey as q, l_linenumber as item, 's' || (l_partkey % 4) as section, l_returnflag <> 'N' as decided from l),
g as (select q, section, min(item) as rank, count(*) filter (where decided) as n from i group by all),
s as (select *, row_number() over (partition by q order by rank) as k, ceil(greatest(n, 1) / ceil(greatest(n, 1) / {CAP}.0))::bigint as size from g),
r as (select distinct q, 0::bigint as k, 0::bigint as closed, 0::bigint as filled, null::bigint as first, 0::bigint as n from i
 union all select r.q, r.k + 1,
  case when s.n = 0 then closed when s.n > {CAP} then closed + (filled > 0)::bigint + ceil(s.n / s.size)::bigint when filled > 0 and filled + s.n > {CAP} then closed + 1 else closed end,
  case when s.n = 0 then filled when s.n > {CAP} then 0 when filled > 0 and filled + s.n <= {CAP} then filled + s.n else s.n end,
  case when s.n = 0 then case when filled > 0 then closed end when s.n > {CAP} then closed + (filled > 0)::bigint when filled > 0 and filled + s.n > {CAP} then closed + 1 else closed end, s.n
  from r join s on s.q = r.q and s.k = r.k + 1),
n as (select q, max(closed + (filled > 0)::bigint) as calls from r group by q),
p as (select r.q, r.k, coalesce(r.first, (select x.first from r x where x.q = r.q and x.k > r.k and x.n > 0 order by x.k limit 1), case when calls > 0 then calls - 1 end) as first from r join n using (q) where r.k > 0),
t as (select s.q, s.section, p.first, case when s.n > {CAP} then ceil(s.n / s.size)::bigint else 1 end as parts, s.size from s join p on p.q = s.q and p.k = s.k where p.first is not null),
o as (select *, row_number() over (partition by q, section, decided order by item desc) - 1 as pos from i)
select o.q as question, (first + part)::bigint as call, o.section, item, decided and (parts = 1 or pos // size = part) as decides from o join t using (q, section), lateral (select unnest(range(parts)) as part)"""


def q107_list_items(spark, sf_dir):
    """The lettered list in the lines of each order: what follows a gap is nested content."""
    line = F.when(F.col("l_partkey") % 5 == 0, F.lit("a line without a marker")).otherwise(F.concat(F.chr(F.col("l_linenumber") + 64), F.lit(". item "), F.col("l_partkey").cast("string")))
    rows = _lines(spark, sf_dir, "l_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))).alias("x"))
    return rows.select("l_orderkey", F.inline(lists.list_items(F.transform("x", lambda x: x["line"]))))


SQL["q107_list_items"] = f"""with {_sql_lines("l_partkey")},
x as (select *, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as pos, count(*) over (partition by l_orderkey) as n from l),
m as (select l_orderkey, l_linenumber, pos, n, row_number() over (partition by l_orderkey order by l_linenumber) as k from x where l_partkey % 5 <> 0),
r as (select * from m where k = l_linenumber),
s as (select *, count(*) over (partition by l_orderkey) as items, lead(pos) over (partition by l_orderkey order by pos) as next from r)
select l_orderkey, chr((64 + l_linenumber)::int) as marker, pos::int as start, coalesce(next, n)::int as stop from s where items > 1"""

for _name, _f in list(globals().items()):
    if _name[:1] == "q" and _name[1:3].isdigit():
        QUERIES[_name] = _f
