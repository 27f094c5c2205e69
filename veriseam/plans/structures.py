"""Queries over graphs, printed tables, logic and obligation networks, built from the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logic as L
from ..operators import bands, graph, network
from ..session import cut_lineage
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


KINDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


def _number(kind: str, key: str):
    """A node as a number: its key and, in the last three bits, its kind."""
    return F.shiftleft(F.col(key).cast("long"), 3).bitwiseOR(F.lit(list(KINDS).index(kind)).cast("long"))


def _named(number):
    """The id of a node that is given as a number."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (number.bitwiseAND(F.lit(7)) + 1).cast("int"))
    return F.concat(kind, F.lit(":"), F.shiftright(number, 3).cast("string"))


def _graph(spark, sf_dir, ident=_id, repeats=False):
    """Nodes (id, kind) and edges (src, label, dst) of the star schema; with ``repeats`` an edge comes once a row it is from."""
    t = lambda n: table(spark, sf_dir, n)
    _id, nodes = ident, None
    for kind, key in KINDS.items():
        part = t(kind).select(_id(kind, key).alias("id"), F.lit(kind).alias("kind"))
        nodes = part if nodes is None else nodes.unionByName(part)
    once = lambda df: df if repeats else df.distinct()
    e = lambda df, src, label, dst: once(df.select(src.alias("src"), F.lit(label).alias("label"), dst.alias("dst")))
    edges = e(t("nation"), _id("region", "n_regionkey"), "contains", _id("nation", "n_nationkey"))
    edges = edges.unionByName(e(t("customer"), _id("nation", "c_nationkey"), "home_of", _id("customer", "c_custkey")))
    edges = edges.unionByName(e(t("supplier"), _id("nation", "s_nationkey"), "seat_of", _id("supplier", "s_suppkey")))
    edges = edges.unionByName(e(t("orders"), _id("customer", "o_custkey"), "placed", _id("orders", "o_orderkey")))
    edges = edges.unionByName(e(t("lineitem"), _id("orders", "l_orderkey"), "asks_for", _id("part", "l_partkey")))
    edges = edges.unionByName(e(t("lineitem"), _id("supplier", "l_suppkey"), "supplies", _id("part", "l_partkey")))
    return nodes, edges


GRAPH = """
nodes as (select 'region:' || r_regionkey as id from region union all select 'nation:' || n_nationkey from nation union all select 'customer:' || c_custkey from customer
 union all select 'supplier:' || s_suppkey from supplier union all select 'part:' || p_partkey from part union all select 'orders:' || o_orderkey from orders),
edges as (select distinct 'region:' || n_regionkey as src, 'contains' as label, 'nation:' || n_nationkey as dst from nation
 union all select distinct 'nation:' || c_nationkey, 'home_of', 'customer:' || c_custkey from customer
 union all select distinct 'nation:' || s_nationkey, 'seat_of', 'supplier:' || s_suppkey from supplier
 union all select distinct 'customer:' || o_custkey, 'placed', 'orders:' || o_orderkey from orders
 union all select distinct 'orders:' || l_orderkey, 'asks_for', 'part:' || l_partkey from lineitem
 union all select distinct 'supplier:' || l_suppkey, 'supplies', 'part:' || l_partkey from lineitem)"""


def q29_hierarchy_graph(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.references(edges, nodes)


SQL["q29_hierarchy_graph"] = f"""with {GRAPH},
d as (select label, src, count(*) as n, count(*) filter (where nodes.id is null) as lost from edges left join nodes on edges.dst = nodes.id group by all)
select label, sum(n)::bigint as n_edges, sum(lost)::bigint as n_unresolved, max(n) as max_degree from d group by label"""


def q30_neighbors_2hop(spark, sf_dir):
    """All within two steps of every hundredth supplier, by ownership edges in either direction."""
    edges = _graph(spark, sf_dir)[1].filter(F.col("label").isin("contains", "home_of", "seat_of"))
    starts = table(spark, sf_dir, "supplier").filter(F.col("s_suppkey") % 100 == 0).select(_id("supplier", "s_suppkey").alias("start"))
    return graph.distances(edges, starts.withColumn("node", F.col("start")), 2, by=["start"]).select("start", "node", F.col("depth").cast("long").alias("depth"))


SQL["q30_neighbors_2hop"] = f"""with {GRAPH},
u as (select src as a, dst as b from edges where label in ('contains', 'home_of', 'seat_of') union select dst, src from edges where label in ('contains', 'home_of', 'seat_of')),
s as (select 'supplier:' || s_suppkey as start from supplier where s_suppkey % 100 = 0),
r as (select start, start as node, 0 as depth from s union all select start, b, 1 from s join u on start = a
 union all select start, v.b, 2 from s join u on start = u.a join u v on u.b = v.a)
select start, node, min(depth)::bigint as depth from r group by all"""


def q31_bfs_proximity(spark, sf_dir):
    """1 / (1 + distance) of every node from the first region, up to six steps, as many as lead to all that hangs together here."""
    edges = _graph(spark, sf_dir, _number, repeats=True)[1]
    start = table(spark, sf_dir, "region").agg(F.min("r_regionkey").alias("r_regionkey")).select(_number("region", "r_regionkey").alias("node"))
    return graph.distances(edges, start, 6).select(_named(F.col("node")).alias("node"), F.round(1 / (1 + F.col("depth")), 6).alias("proximity"))


SQL["q31_bfs_proximity"] = f"""with recursive {GRAPH},
u as (select src as a, dst as b from edges union select dst, src from edges),
r as (select 'region:' || min(r_regionkey) as node, 0 as depth from region union select b, depth + 1 from r join u on node = a where depth < 6)
select node, round(1 / (1 + min(depth)), 6) as proximity from r group by node"""


def q32_closure_budget(spark, sf_dir):
    """Orders, parts and suppliers that hang on every hundredth customer: 40 each, every kind in turn."""
    edges = _graph(spark, sf_dir)[1]
    ways = edges.filter(F.col("label").isin("placed", "asks_for")).unionByName(edges.filter("label = 'supplies'").select(F.col("dst").alias("src"), F.lit("supplied_by").alias("label"), F.col("src").alias("dst")))
    starts = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 100 == 0).select(_id("customer", "c_custkey").alias("start")).withColumn("node", F.col("start"))
    made = graph.closure(ways, starts, by="start", reach={"placed": 1, "asks_for": 3, "supplied_by": 3}, budget=40)
    return made.select("start", "node", F.col("depth").cast("long").alias("depth"), "reason")


def _closure_round(d: int, labels: str) -> str:
    seen, before = " union all ".join(f"select start, node from k{i}" for i in range(d)), " union all ".join(f"select start from k{i}" for i in range(1, d)) or "select start from k0 where false"
    return f"""f{d} as (select start, dst as node, min(label) as reason from k{d - 1} join ways on src = node where label in ({labels}) group by all),
n{d} as (select * from f{d} anti join ({seen}) using (start, node)),
t{d} as (select *, row_number() over (partition by start, reason order by node) as turn from n{d}),
p{d} as (select *, row_number() over (partition by start order by turn, reason) as place from t{d} where turn <= 40),
k{d} as (select start, node, {d} as depth, reason from p{d} left join (select start, count(*) as used from ({before}) group by start) using (start) where place + coalesce(used, 0) <= 40)"""


SQL["q32_closure_budget"] = f"""with {GRAPH},
ways as (select * from edges where label in ('placed', 'asks_for') union all select dst, 'supplied_by', src from edges where label = 'supplies'),
k0 as (select 'customer:' || c_custkey as start, 'customer:' || c_custkey as node, 0 as depth, 'start' as reason from customer where c_custkey % 100 = 0),
{_closure_round(1, "'placed', 'asks_for', 'supplied_by'")}, {_closure_round(2, "'asks_for', 'supplied_by'")}, {_closure_round(3, "'asks_for', 'supplied_by'")}
select start, node, depth::bigint as depth, reason from (select * from k0 union all select * from k1 union all select * from k2 union all select * from k3)"""


def q33_anchor_argmax(spark, sf_dir):
    """For each supplier the nation that orders most from it, one of its own region preferred; ties: the smaller key."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey")).join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey").join(t("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    counts = lines.groupBy("s_suppkey", "n_nationkey").agg(F.count("*").alias("n"))
    nation = t("nation").select("n_nationkey", "n_regionkey")
    own = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")).join(nation, "n_nationkey").select("s_suppkey", F.col("n_regionkey").alias("own"))
    rows = counts.join(nation, "n_nationkey").join(own, "s_suppkey").withColumn("home", F.col("n_regionkey") == F.col("own"))
    best = rows.groupBy("s_suppkey").agg(F.max_by(F.struct("n_nationkey", "home", "n"), F.struct(F.col("home"), F.col("n"), -F.col("n_nationkey"))).alias("x"))
    return best.select("s_suppkey", F.col("x.n_nationkey").cast("long").alias("nation"), F.col("x.home").alias("own_region"), F.col("x.n").alias("n_lines"))


SQL["q33_anchor_argmax"] = """with c as (select l_suppkey as s_suppkey, c_nationkey as nk, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all),
o as (select s_suppkey, n_regionkey as own from supplier join nation on s_nationkey = n_nationkey),
r as (select c.*, n_regionkey = own as home from c join nation on nk = n_nationkey join o using (s_suppkey))
select s_suppkey, nk::bigint as nation, home as own_region, n as n_lines from (select *, row_number() over (partition by s_suppkey order by home desc, n desc, nk) as k from r) where k = 1"""


def q34_dag_levels(spark, sf_dir):
    """Levels of a network in which each part needs those at a half and a third of its key, and what feeds the last."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    edges = parts.filter("node > 0").select("node", F.explode(F.array(F.floor(F.col("node") / 2).cast("long"), F.floor(F.col("node") / 3).cast("long"))).alias("needs")).distinct()
    last = parts.agg(F.max("node").alias("node"))
    fed = graph.slice_back(edges, last).withColumn("feeds_last", F.lit(True))
    return graph.levels(parts, edges).join(fed, "node", "left").select("node", F.col("level").cast("long").alias("level"), F.coalesce("feeds_last", F.lit(False)).alias("feeds_last"))


SQL["q34_dag_levels"] = """with recursive e as (select p_partkey as node, p_partkey // 2 as needs from part where p_partkey > 0 union select p_partkey, p_partkey // 3 from part where p_partkey > 0),
l as (select p_partkey as node, 1 as level from part where p_partkey not in (select node from e) union select e.node, level + 1 from l join e on e.needs = l.node),
s as (select max(p_partkey) as node from part union select needs from s join e on e.node = s.node)
select node, max(level)::bigint as level, node in (select node from s) as feeds_last from l group by node"""

# A printed table of size bands, points of a curve, notes and conditions.
BANDS = [(1, None, 1.0, None, False, False, "tiny", 5.0), (2, None, None, 10.0, False, True, "small", 10.0), (3, None, 10.0, 25.0, False, False, "middle", 20.0), (4, 25.0, None, None, False, False, "exact", 25.0), (5, None, 25.0, 40.0, True, True, "large", 40.0), (6, None, 45.0, None, False, False, "huge", 80.0)]
_BANDS_DDL = "row int, number double, lo double, hi double, lo_inc boolean, hi_inc boolean, label string, result double"
_BANDS = [(BANDS[0][0], 1.0, None, None, False, False, "tiny", 5.0), *BANDS[1:]]


def _sql_rows(rows) -> str:
    cell = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x}::double" if isinstance(x, float) else str(x)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def q35_band_lookup(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"))
    return bands.band_lookup(parts, spark.createDataFrame(_BANDS, _BANDS_DDL), key="p_partkey", value="size").select("p_partkey", "size", "label", "result")


SQL["q35_band_lookup"] = f"""with b(row, number, lo, hi, lo_inc, hi_inc, label, result) as (values {_sql_rows(_BANDS)}),
m as (select p_partkey, p_size::double as size, row, label, result from part left join b on case when number is not null then p_size = number
 else (lo is not null or hi is not null) and (lo is null or case when lo_inc then p_size >= lo else p_size > lo end) and (hi is null or case when hi_inc then p_size <= hi else p_size < hi end) end)
select p_partkey, size, label, result from (select *, row_number() over (partition by p_partkey order by row) as k from m) where k = 1"""

POINTS = [(900.0, 10.0), (925.0, 14.0), (950.0, 30.0), (1000.0, 31.0), (1050.0, 45.0)]


def q36_interpolation(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    return bands.interpolate(parts, POINTS, value="price").select("p_partkey", F.round("found", 6).alias("found"), "confidence")


SQL["q36_interpolation"] = f"""with p(x, y) as (values {_sql_rows(POINTS)}),
s as (select x as x0, y as y0, lead(x) over (order by x) as x1, lead(y) over (order by x) as y1 from p)
select p_partkey, round(coalesce(p.y, y0 + (p_retailprice - x0) * (y1 - y0) / (x1 - x0)), 6) as found, case when p.y is not null then 1.0 when x0 is not null then 0.6 else 0.0 end::double as confidence
from part left join p on p_retailprice = p.x left join s on p_retailprice > x0 and p_retailprice < x1"""

NOTES = [("table", None, None, "t1", False), ("row", "Brand#2", None, "r1", True), ("column", None, "ECONOMY", "c1", False), ("column", None, "PROMO", "c2", True), ("cell", "Brand#17", "ECONOMY", "x1", True)]


def q37_conditions(spark, sf_dir):
    """Which footnotes govern each cell (brand, type), and whether one blocks its value."""
    cells = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    notes = spark.createDataFrame(NOTES, "scope string, row string, `column` string, note string, blocks boolean")
    met = bands.scoped(cells, notes, row="p_brand", column="p_type")
    return met.groupBy("p_brand", "p_type").agg(F.array_join(F.array_sort(F.collect_set("note")), ",").alias("notes"), F.max("blocks").alias("blocked"))


SQL["q37_conditions"] = f"""with n(scope, row, col, note, blocks) as (values {_sql_rows(NOTES)}), c as (select distinct p_brand, p_type from part)
select p_brand, p_type, string_agg(distinct note, ',' order by note) as notes, bool_or(blocks) as blocked from c join n on scope = 'table' or (scope = 'row' and row = p_brand)
 or (scope = 'column' and col = p_type) or (scope = 'cell' and row = p_brand and col = p_type) group by all"""

CONDITIONS = [("c1", "size", ">=", 25.0, "mm"), ("c2", "size", "<", 10.0, "mm"), ("c3", "size", "=", 7.0, "inch"), ("c4", "price", "<=", 950.0, "usd"), ("c5", "price", ">", 1000.0, "usd")]


def q38_facts_satisfied(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    facts = parts.select("p_brand", F.explode(F.array(F.struct(F.lit("size").alias("kind"), F.col("p_size").cast("double").alias("value"), F.lit("mm").alias("unit")), F.struct(F.lit("price").alias("kind"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("value"), F.lit("usd").alias("unit")))).alias("f")).select("p_brand", "f.*")
    conditions = spark.createDataFrame(CONDITIONS, "condition string, kind string, op string, bound double, unit string")
    return bands.satisfied(facts, conditions).groupBy("condition", "p_brand", "status").agg(F.count("*").alias("n"))


SQL["q38_facts_satisfied"] = f"""with c(condition, kind, op, bound, unit) as (values {_sql_rows(CONDITIONS)}),
f as (select p_brand, 'size' as kind, p_size::double as value, 'mm' as unit from part union all select p_brand, 'price', case when p_partkey % 7 <> 0 then p_retailprice end, 'usd' from part)
select condition, p_brand, case when f.unit <> c.unit then 'WRONG_UNIT' when value is null then 'UNKNOWN'
 when case op when '=' then value = bound when '>=' then value >= bound when '<=' then value <= bound when '>' then value > bound else value < bound end then 'TRUE' else 'FALSE' end as status, count(*) as n
from f join c using (kind) group by all"""


def _status():
    kind = F.col("event_type")
    return F.when(kind == "error", L.FALSE).when(kind == "signup", L.UNKNOWN).when(kind == "view", L.NOT_APPLICABLE).otherwise(L.TRUE)


STATUS = "case event_type when 'error' then 'FALSE' when 'signup' then 'UNKNOWN' when 'view' then 'NOT_APPLICABLE' else 'TRUE' end"
_CONJ = "case when count(*) filter (where {s} = 'FALSE') > 0 then 'FALSE' when count(*) filter (where {s} = 'UNKNOWN') > 0 then 'UNKNOWN' when count(*) filter (where {s} = 'TRUE') > 0 then 'TRUE' else 'NOT_APPLICABLE' end"
_ALT = "case when count(*) filter (where {s} = 'TRUE') > 0 then 'TRUE' when count(*) filter (where {s} = 'UNKNOWN') > 0 then 'UNKNOWN' when count(*) filter (where {s} = 'FALSE') > 0 then 'FALSE' else 'NOT_APPLICABLE' end"


def q39_kleene_merge(spark, sf_dir):
    """Merges of each user's hourly statuses: conjunction, alternative, at least two, and an exception merge of the two halves."""
    ev = table(spark, sf_dir, "events").select("user_id", F.hour("ts").alias("hour"), "event_id", _status().alias("status"))
    half = F.when(F.col("event_id") % 2 == 0, F.col("status"))
    per = ev.groupBy("user_id", "hour").agg(
        L.conjunction(F.col("status")).alias("all_of"),
        L.alternative(F.col("status")).alias("any_of"),
        L.threshold(F.col("status"), 2).alias("two_of"),
        L.conjunction(half).alias("base"),
        L.alternative(F.when(half.isNull(), F.col("status"))).alias("exceptions"),
    )
    return per.select("user_id", F.col("hour").cast("long").alias("hour"), "all_of", "any_of", "two_of", L.exception(F.col("base"), F.col("exceptions")).alias("excepted"), L.negation(F.col("any_of")).alias("none_of"))


SQL["q39_kleene_merge"] = f"""with e as (select user_id, hour(ts) as hour, event_id, {STATUS} as s, case when event_id % 2 = 0 then {STATUS} end as h, case when event_id % 2 <> 0 then {STATUS} end as o from events),
p as (select user_id, hour, {_CONJ.format(s="s")} as all_of, {_ALT.format(s="s")} as any_of,
 case when count(*) filter (where s = 'TRUE') >= 2 then 'TRUE' when count(*) filter (where s in ('TRUE', 'UNKNOWN')) >= 2 then 'UNKNOWN' else 'FALSE' end as two_of,
 {_CONJ.format(s="h")} as base, {_ALT.format(s="o")} as ex from e group by all)
select user_id, hour::bigint as hour, all_of, any_of, two_of, case when base in ('NOT_APPLICABLE', 'TRUE') then base when ex = 'TRUE' then 'TRUE' when base = 'UNKNOWN' or ex = 'UNKNOWN' then 'UNKNOWN' else base end as excepted,
 case any_of when 'TRUE' then 'FALSE' when 'FALSE' then 'TRUE' else any_of end as none_of from p"""


def _headed(spark, sf_dir):
    heading = F.element_at(F.array(*(F.lit(x) for x in L.RANKS)), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("user_id", F.hour("ts").alias("hour"), _status().alias("status"), heading.alias("heading"))


def q40_authority_adjust(spark, sf_dir):
    """Merges under the heading Guidance: weaker failures don't block, the strongest failed input raises the heading."""
    ev = _headed(spark, sf_dir)
    adjusted = L.non_blocking(F.col("status"), F.col("heading"), F.lit("Guidance"))
    failed = F.max(F.when(adjusted == L.FALSE, L.heading_rank(F.col("heading"))))
    per = ev.groupBy("user_id", "hour").agg(L.conjunction(adjusted).alias("status"), failed.alias("strongest"))
    name = F.element_at(F.array(*(F.lit(x) for x in reversed(L.RANKS))), F.greatest(F.when(F.col("status") == L.FALSE, F.coalesce("strongest", F.lit(3))).otherwise(3), F.lit(3)))
    return per.select("user_id", F.col("hour").cast("long").alias("hour"), "status", name.alias("heading"))


SQL["q40_authority_adjust"] = f"""with e as (select user_id, hour(ts) as hour, {STATUS} as s0, 4 - event_id % 4 as r from events),
a as (select *, case when s0 = 'FALSE' and r < 3 then 'TRUE' else s0 end as s from e),
p as (select user_id, hour, {_CONJ.format(s="s")} as status, max(r) filter (where s = 'FALSE') as strongest from a group by all)
select user_id, hour::bigint as hour, status, case when status = 'FALSE' and strongest = 4 then 'Standard' else 'Guidance' end as heading from p"""


def q41_guard_worlds(spark, sf_dir):
    """The state of the guard a and (b or not c) for each user and hour; a kind without an event isn't marked yet."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "purchase", "error"))
    status = F.when(F.col("value") < 40, L.FALSE).when(F.col("value") < 80, L.TRUE).otherwise(L.UNKNOWN)
    last = lambda kind, name: F.max_by(F.when(F.col("event_type") == kind, F.col("status")), F.when(F.col("event_type") == kind, F.col("event_id"))).alias(name)
    per = ev.withColumn("status", status).groupBy("user_id", F.hour("ts").cast("long").alias("hour")).agg(last("click", "a"), last("purchase", "b"), last("error", "c"))
    state = L.guard([F.col("a"), F.col("b"), F.col("c")], lambda x: x[0] & (x[1] | ~x[2]))
    return per.select("user_id", "hour", "a", "b", "c", state.alias("state"))


SQL["q41_guard_worlds"] = """with e as (select user_id, hour(ts)::bigint as hour, event_type, event_id, case when value < 40 then 'FALSE' when value < 80 then 'TRUE' else 'UNKNOWN' end as status from events),
p as (select user_id, hour, arg_max(status, event_id) filter (where event_type = 'click') as a, arg_max(status, event_id) filter (where event_type = 'purchase') as b, arg_max(status, event_id) filter (where event_type = 'error') as c
 from e where event_type in ('click', 'purchase', 'error') group by all),
w as (select p.*, a1 and (b1 or not c1) as truth from p, (values (true), (false)) x(a1), (values (true), (false)) y(b1), (values (true), (false)) z(c1)
 where coalesce(a, 'UNKNOWN') in ('UNKNOWN', upper(a1::text)) and coalesce(b, 'UNKNOWN') in ('UNKNOWN', upper(b1::text)) and coalesce(c, 'UNKNOWN') in ('UNKNOWN', upper(c1::text)))
select user_id, hour, a, b, c, case when bool_and(truth) then 'OPEN' when not bool_or(truth) then 'CLOSED' when a is null or b is null or c is null then 'PENDING' else 'UNDECIDED' end as state from w group by user_id, hour, a, b, c"""


def _networks(spark, sf_dir, status):
    """A network for each order: its lines are checks, shipped and open lines merge apart, and the end excepts."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("net"), F.col("l_linenumber").alias("line")).agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"), F.min("l_discount").alias("l_discount"), F.min("l_tax").alias("l_tax"))
    # lines are grouped once; all that follows is made of what is written here
    li = cut_lineage(li.select("net", F.concat(F.lit("line"), F.col("line").cast("string")).alias("op"), "l_linestatus", status.alias("status")))
    checks = li.select("net", "op", "status")
    nets = li.select("net").distinct()
    ops = li.select("net", "op", F.lit("check").alias("merge")).unionByName(nets.select("net", F.explode(F.array(F.struct(F.lit("shipped").alias("op"), F.lit("conjunction").alias("merge")), F.struct(F.lit("open").alias("op"), F.lit("alternative").alias("merge")), F.struct(F.lit("end").alias("op"), F.lit("exception").alias("merge")))).alias("x")).select("net", "x.*"))
    ops = ops.withColumn("authority", F.lit("Standard"))
    needs = li.select("net", F.when(F.col("l_linestatus") == "F", "shipped").otherwise("open").alias("op"), F.col("op").alias("needs"), F.lit("input").alias("part"))
    has = needs.groupBy("net").agg(F.max((F.col("op") == "shipped").cast("int")).alias("s"), F.max((F.col("op") == "open").cast("int")).alias("o"))
    # a merge of no lines gets a check that doesn't apply
    void = has.select("net", F.explode(F.array(F.when(F.col("s") == 0, "shipped"), F.when(F.col("o") == 0, "open"))).alias("op")).filter("op is not null").withColumn("needs", F.concat(F.lit("void_"), "op"))
    checks = checks.unionByName(void.select("net", F.col("needs").alias("op"), F.lit(L.NOT_APPLICABLE).alias("status")))
    ops = ops.unionByName(void.select("net", F.col("needs").alias("op"), F.lit("check").alias("merge"), F.lit("Standard").alias("authority")))
    needs = needs.unionByName(void.select("net", "op", "needs", F.lit("input").alias("part")))
    ends = nets.select("net", F.lit("end").alias("op"), F.explode(F.array(F.struct(F.lit("shipped").alias("needs"), F.lit("base").alias("part")), F.struct(F.lit("open").alias("needs"), F.lit("exception").alias("part")))).alias("x")).select("net", "op", "x.*")
    return ops, needs.unionByName(ends), checks


def _flag_status():
    return F.when(F.col("l_discount") == 0, L.NOT_APPLICABLE).when(F.col("l_returnflag") == "A", L.TRUE).when(F.col("l_returnflag") == "R", L.FALSE).otherwise(L.UNKNOWN)


def q42_wave_executor(spark, sf_dir):
    """How all networks end: waves run and statuses of the merges."""
    done = network.execute(*_networks(spark, sf_dir, _flag_status()))
    return done.filter(F.col("op").isin("shipped", "open", "end")).groupBy("op", "status", F.col("wave").cast("long").alias("wave")).agg(F.count("*").alias("n"))


LINES = "l as (select l_orderkey as net, l_linenumber as line, min(l_returnflag) as f, min(l_linestatus) as st, min(l_discount) as d, min(l_tax) as tax from lineitem group by all)"
_END = "case when sh in ('NOT_APPLICABLE', 'TRUE') then sh when op = 'TRUE' then 'TRUE' when sh = 'UNKNOWN' or op = 'UNKNOWN' then 'UNKNOWN' else sh end"
_FLAG = "case when d = 0 then 'NOT_APPLICABLE' when f = 'A' then 'TRUE' when f = 'R' then 'FALSE' else 'UNKNOWN' end"
SQL["q42_wave_executor"] = f"""with {LINES},
m as (select net, {_CONJ.format(s=f"case when st = 'F' then {_FLAG} end")} as sh, {_ALT.format(s=f"case when st <> 'F' then {_FLAG} end")} as op from l group by net)
select 'shipped' as op, sh as status, 1::bigint as wave, count(*) as n from m group by all union all select 'open', op, 1::bigint, count(*) from m group by all
union all select 'end', {_END}, 2::bigint, count(*) from m group by all"""


def _drawn():
    """A scenario by hash: 70 % TRUE, 15 % FALSE, 15 % UNKNOWN."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "net", "line")), 1, 6), 16, 10).cast("bigint") % 100
    return F.when(h < 70, L.TRUE).when(h < 85, L.FALSE).otherwise(L.UNKNOWN)


_DRAW = "(('0x' || substr(md5(net || ':' || line), 1, 6))::bigint % 100)"
_DRAWN = f"case when {_DRAW} < 70 then 'TRUE' when {_DRAW} < 85 then 'FALSE' else 'UNKNOWN' end"


def _ends(done, names, called):
    """The ends of networks, a row for each of the runs ``names``: its name as ``called``, its status, and all runs' columns."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias(called), F.col(n).alias("status")) for n in names))).alias("x")
    return done.filter("op = 'end'").select("*", each).select("*", "x.*").drop("x")


def q43_scenarios_ablations(spark, sf_dir):
    """Accuracy against the full run, and the share of unfounded TRUE, without exceptions and with unknown taken as TRUE."""
    ops, needs, checks = _networks(spark, sf_dir, _drawn())
    ops = ops.withColumn("merge_no_exceptions", F.when(F.col("merge") == "exception", "conjunction").otherwise(F.col("merge")))
    bold = F.when(F.col("status") == L.UNKNOWN, L.TRUE).otherwise(F.col("status"))
    checks = checks.select("net", "op", F.col("status").alias("full"), F.col("status").alias("no_exceptions"), bold.alias("unknown_as_true"))
    names = ("full", "no_exceptions", "unknown_as_true")
    both = _ends(network.execute(ops, needs, checks, runs=names), names, "run").select("run", "status", F.col("full"))
    return both.groupBy("run").agg(F.count("*").alias("n"), F.round(F.avg((F.col("status") == F.col("full")).cast("double")), 6).alias("accuracy"), F.round(F.avg(((F.col("status") == L.TRUE) & (F.col("full") != L.TRUE)).cast("double")), 6).alias("unfounded"))


def _merged(k: int, s: str) -> str:
    shipped, open_ = f"case when st = 'F' then {s} end", f"case when st <> 'F' then {s} end"
    return f"m{k} as (select net, {_CONJ.format(s=shipped)} as sh, {_ALT.format(s=open_)} as op from l group by net)"


SQL["q43_scenarios_ablations"] = f"""with {LINES}, {_merged(1, _DRAWN)}, {_merged(2, f"(case when {_DRAW} < 70 or {_DRAW} >= 85 then 'TRUE' else 'FALSE' end)")},
r as (select net, 'full' as run, {_END} as status from m1 union all
 select net, 'no_exceptions', case when sh = 'FALSE' or op = 'FALSE' then 'FALSE' when sh = 'UNKNOWN' or op = 'UNKNOWN' then 'UNKNOWN' when sh = 'TRUE' or op = 'TRUE' then 'TRUE' else 'NOT_APPLICABLE' end from m1 union all
 select net, 'unknown_as_true', {_END} from m2),
f as (select net, status as full_ from r where run = 'full')
select run, count(*) as n, round(avg((status = full_)::int), 6) as accuracy, round(avg((status = 'TRUE' and full_ <> 'TRUE')::int), 6) as unfounded from r join f using (net) group by run"""


def q44_fault_containment(spark, sf_dir):
    """The first line of each order loses its evidence, is distracted or flipped: how often the end abstains or stays."""
    ops, needs, checks = _networks(spark, sf_dir, _drawn())
    faults = {"removed": F.lit(L.UNKNOWN), "distracted": F.lit(L.TRUE), "flipped": F.when(F.col("status") == L.UNKNOWN, L.TRUE).otherwise(L.negation(F.col("status")))}
    broken = checks.select("net", "op", F.col("status").alias("clean"), *(F.when(F.col("op") == "line1", status).otherwise(F.col("status")).alias(fault) for fault, status in faults.items()))
    both = _ends(network.execute(ops, needs, broken, runs=("clean", *faults)), tuple(faults), "fault")
    same = F.col("status") == F.col("clean")
    return both.groupBy("fault").agg(F.count("*").alias("n"), F.round(F.avg((same | (F.col("status") == L.UNKNOWN)).cast("double")), 6).alias("contained"), F.round(F.avg((same & (F.col("clean") != L.UNKNOWN)).cast("double")), 6).alias("preserved"))


_FAULTS = {"removed": "'UNKNOWN'", "distracted": "'TRUE'", "flipped": f"case {_DRAWN} when 'TRUE' then 'FALSE' else 'TRUE' end"}
SQL["q44_fault_containment"] = f"with {LINES}, {_merged(0, _DRAWN)}, " + ", ".join(_merged(i + 1, f"(case when line = 1 then {x} else {_DRAWN} end)") for i, x in enumerate(_FAULTS.values())) + f", c as (select net, {_END} as clean from m0), r as (" + " union all ".join(f"select net, '{n}' as fault, {_END} as status from m{i + 1}" for i, n in enumerate(_FAULTS)) + """)
select fault, count(*) as n, round(avg((status = clean or status = 'UNKNOWN')::int), 6) as contained, round(avg((status = clean and clean <> 'UNKNOWN')::int), 6) as preserved from r join c using (net) group by fault"""

for _name, _f in list(globals().items()):
    if _name[:1] == "q" and _name[1:3].isdigit():
        QUERIES[_name] = _f
