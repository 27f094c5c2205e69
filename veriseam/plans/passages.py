"""Queries over passages, merges and routing, built from the relational tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import passages as P
from ..operators import merges, rank
from ..sources.tables import table
from .ranking import BM25, QRELS, SPARSE, _bm25, _inputs, _qrels, _round, _sparse
from .structures import STATUS, _status

QUERIES: dict = {}
SQL: dict[str, str] = {}


def q61_note_prose(spark, sf_dir):
    """Lines of the documents that read as prose, by language."""
    lines = table(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return lines.groupBy("lang").agg(F.count("*").alias("n_lines"), F.count_if(P.is_prose(F.col("line"))).alias("n_prose"))


SQL["q61_note_prose"] = r"""with l as (select lang, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
w as (select lang, regexp_extract_all(line, '[^ \t\n\x0B\f\r]+') as ws from l)
select lang, count(*) as n_lines, count(*) filter (where len(ws) >= 6 and len(list_filter(ws, lambda w: regexp_matches(w, '^\p{Ll}'))) >= 3) as n_prose from w group by lang"""


def q62_stems(spark, sf_dir):
    """Stems of the documents' words of four letters or more, and how many documents have them."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)))).alias("w"))
    stems = words.select("doc_id", P.stem(F.col("w")).alias("stem")).distinct()
    return stems.groupBy("stem").agg(F.count("*").alias("df")).filter("df > 1")


SQL["q62_stems"] = """with w as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}'))) as w from documents),
s as (select distinct doc_id, case when w like '%ies' and length(w) >= 7 then left(w, -3) || 'y' when w like '%es' and length(w) >= 6 then left(w, -2) when w like '%s' and length(w) >= 5 then left(w, -1) else w end as stem from w)
select stem, count(*) as df from s group by stem having count(*) > 1"""

_PREFIX = ("R", "W", "D", "I", "M", "OM", "EM", "RM")


def _signs(spark, sf_dir):
    prefix = F.element_at(F.array(*(F.lit(p) for p in _PREFIX)), (F.col("p_partkey") % 8 + 1).cast("int"))
    text = F.concat(F.col("p_name"), F.lit(" ("), prefix, F.col("p_size").cast("string"), F.lit("-"), (F.col("p_partkey") % 30).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "aP").otherwise(""), F.lit(") with "), prefix, F.lit("3-1,2,"), (F.col("p_partkey") % 9).cast("string"), F.lit(" signs, FHWA3"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


_SIGNS = """t as (select p_partkey, p_name || ' (' || pre || p_size || '-' || (p_partkey % 30) || case when p_partkey % 3 = 0 then 'aP' else '' end || ') with ' || pre || '3-1,2,' || (p_partkey % 9) || ' signs, FHWA3' as text
 from (select *, (['R', 'W', 'D', 'I', 'M', 'OM', 'EM', 'RM'])[(p_partkey % 8 + 1)::int] as pre from part))"""


def q63_sign_codes(spark, sf_dir):
    """Codes named in titles, series spelled out, by category."""
    text = _signs(spark, sf_dir)
    each = text.select(F.explode(F.array_distinct(F.concat(P.codes(F.col("text")), P.expand_series(F.col("text"))))).alias("code"))
    return each.groupBy("code", P.category(F.col("code")).alias("category")).agg(F.count("*").alias("n"))


SQL["q63_sign_codes"] = f"""with {_SIGNS},
c as (select p_partkey, unnest(regexp_extract_all(text, '\\b(OM|EM|RM|R|W|D|I|M)([0-9]{{1,3}}(?:-[0-9]{{1,3}})?[a-z]?P?)\\b')) as code from t
 union select p_partkey, unnest(list_transform(string_split(regexp_extract(text, '(?:OM|EM|RM|R|W|D|I|M)[0-9]{{1,3}}-([0-9]{{1,3}}(?:,[0-9]{{1,3}})+)', 1), ','), lambda n: regexp_extract(text, '((?:OM|EM|RM|R|W|D|I|M)[0-9]{{1,3}}-)[0-9]{{1,3}}(?:,[0-9]{{1,3}})+', 1) || n)) from t)
select code, case when code like 'OM%' then 'ObjectMarker' when code like 'EM%' then 'Emergency' when code like 'RM%' then 'RoadMarker' when code like 'R%' then 'Regulatory' when code like 'W%' then 'Warning'
 when code like 'D%' then 'Guide' when code like 'I%' then 'Information' else 'Marker' end as category, count(*) as n from c group by all"""


def _claims(spark, sf_dir):
    k = F.col("p_partkey")
    named = F.when(k % 4 == 0, F.concat(F.lit(" with W = "), F.col("p_size").cast("string"), F.lit(" feet"))).otherwise("")
    more = F.when(k % 5 == 0, " and 10 feet").when(k % 5 == 1, " and 1,250 feet or 30 Percent").when(k % 5 == 2, " and a 48-inch sign, 900 vph or 12,000 AADT").when(k % 5 == 3, " on 3 - metre lanes").otherwise("")
    text = F.concat(F.lit("A taper of "), F.col("p_size").cast("string"), F.lit(" feet at "), (k % 60 + 15).cast("string"), F.lit(" mph"), named, more)
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


_AFTER = r"\s*[-\s]?\s*"
_UNIT = r"(mph|miles per hour|feet|foot|ft|inches|inch|in|meters|metres|meter|metre|m|vph|veh/h|vpd|aadt|percent|%)\b"
_VALUE = r"-?[0-9][0-9,]*\.?[0-9]*"
_CLAIMS = rf"""t as (select p_partkey, 'A taper of ' || p_size || ' feet at ' || (p_partkey % 60 + 15) || ' mph' || case when p_partkey % 4 = 0 then ' with W = ' || p_size || ' feet' else '' end
 || case p_partkey % 5 when 0 then ' and 10 feet' when 1 then ' and 1,250 feet or 30 Percent' when 2 then ' and a 48-inch sign, 900 vph or 12,000 AADT' when 3 then ' on 3 - metre lanes' else '' end as text from part),
r as (select p_partkey, text, regexp_replace(text, '\b[A-Z]\s*=\s*{_VALUE}\b(?:{_AFTER}(?i:{_UNIT}))?', ' ', 'g') as rest from t),
units(word, unit) as (values ('mph', 'mph'), ('feet', 'ft'), ('inch', 'in'), ('metre', 'm'), ('vph', 'vph'), ('aadt', 'vpd'), ('percent', '%')),
loose as (select p_partkey, unnest(regexp_extract_all(rest, '(?i)({_VALUE}){_AFTER}{_UNIT}', 1)) as v, unnest(regexp_extract_all(rest, '(?i)({_VALUE}){_AFTER}{_UNIT}', 2)) as u from r),
lv as (select p_partkey, replace(v, ',', '')::double as value, unit from loose left join units on word = lower(u)),
nv as (select p_partkey, unnest(regexp_extract_all(text, '\b([A-Z])\s*=\s*({_VALUE})', 1)) as name, replace(unnest(regexp_extract_all(text, '\b([A-Z])\s*=\s*({_VALUE})', 2)), ',', '')::double as value from t)"""


def q64_measurements(spark, sf_dir):
    """Named and loose measurements of claims, with their units."""
    text = _claims(spark, sf_dir)
    named = text.select("p_partkey", F.inline(P.named_values(F.col("text")))).select("p_partkey", "name", "value", "unit")
    loose = text.select("p_partkey", F.inline(P.loose_values(F.col("text")))).select("p_partkey", F.lit(None).cast("string").alias("name"), "value", "unit")
    return named.unionByName(loose)


SQL["q64_measurements"] = f"with {_CLAIMS} select p_partkey, name, value, 'ft' as unit from nv union all select p_partkey, null, value, unit from lv"


def q65_bindings(spark, sf_dir):
    """Variables of each claim bound by name, else by the only value of their unit, else missing."""
    text = _claims(spark, sf_dir)
    wanted = text.select("p_partkey", F.explode(F.array(*(F.struct(F.lit(v).alias("var"), F.lit(u).alias("unit")) for v, u in (("W", "ft"), ("S", "mph"), ("G", "%"))))).alias("x")).select("p_partkey", "x.*")
    named = text.select("p_partkey", F.inline(P.named_values(F.col("text"))))
    loose = text.select("p_partkey", F.inline(P.loose_values(F.col("text"))))
    return merges.bound(wanted, named, loose, key="p_partkey")


SQL["q65_bindings"] = f"""with {_CLAIMS},
o as (select p_partkey, unit, max(value) as loose from lv group by all having count(*) = 1),
w as (select p_partkey, var, unit from part, (values ('W', 'ft'), ('S', 'mph'), ('G', '%')) x(var, unit))
select p_partkey, var, coalesce(n.value, loose) as value, case when n.value is not null then 'name' when loose is not null then 'unit' else 'missing' end as how
from w left join (select p_partkey, name as var, max(value) as value from nv group by all) n using (p_partkey, var) left join o using (p_partkey, unit)"""

MESSAGES = ("InternalError", "insufficient_quota", "OUT_OF_SERVICE", "limit_requests", "DataInspectionFailed", "RateLimit exceeded", "FreeTierOnly", "No backend server available: InvalidParameter", "Arrearage", "InternalError.Algo.InvalidParameter", "Throttling.RateQuota", "Too Many Requests", "data_inspection_failed", "Request timed out", "something else", "access_denied: busy")


def q66_error_kinds(spark, sf_dir):
    """Kinds of error messages by hour; which is retried follows from the kind."""
    names = F.array(*(F.lit(m) for m in MESSAGES))
    message = F.when(F.col("event_type") == "error", F.element_at(names, (F.col("event_id") % len(MESSAGES) + 1).cast("int")))
    kind = P.error_kind(message)
    return table(spark, sf_dir, "events").groupBy(F.hour("ts").cast("long").alias("hour"), kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(kind == "passing").alias("n_retried"))


_LADDER = " ".join("when " + " or ".join(f"contains(m, '{x}')" for x in marks) + f" then '{kind}'" for kind, marks in P.ERRORS)
SQL["q66_error_kinds"] = f"""with e as (select hour(ts)::bigint as hour, coalesce(lower(case when event_type = 'error' then ([{", ".join(f"'{m}'" for m in MESSAGES)}])[(event_id % {len(MESSAGES)} + 1)::int] end), '') as m from events),
k as (select hour, case {_LADDER} else '' end as kind from e)
select hour, kind, count(*) as n, count(*) filter (where kind = 'passing') as n_retried from k group by all"""


def q67_natural_order(spark, sf_dir):
    """Ids such as r2 and r10 in natural order within each brand."""
    ids = table(spark, sf_dir, "part").select("p_brand", F.concat(F.lower(F.substring("p_type", 1, 1)), F.col("p_partkey").cast("string")).alias("id"))
    order = [F.regexp_extract("id", "^([^0-9]*)", 1), F.regexp_extract("id", "([0-9]+)$", 1).cast("long"), F.col("id")]
    return ids.select("p_brand", "id", F.row_number().over(W.partitionBy("p_brand").orderBy(*order)).cast("long").alias("place"))


SQL["q67_natural_order"] = """select p_brand, id, row_number() over (partition by p_brand order by regexp_extract(id, '^([^0-9]*)', 1), regexp_extract(id, '([0-9]+)$', 1)::bigint, id) as place
from (select p_brand, lower(substr(p_type, 1, 1)) || p_partkey as id from part)"""


def q68_span_claims(spark, sf_dir):
    """Spans that no longer one of the same order contains."""
    start = F.col("l_linenumber") * 3 + F.col("l_partkey") % 5
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", start.cast("long").alias("start"), (start + 1 + F.col("l_quantity").cast("long") % 7).cast("long").alias("end"))
    return merges.longest_spans(spans, by="l_orderkey")


SQL["q68_span_claims"] = """with s as (select distinct l_orderkey, l_linenumber * 3 + l_partkey % 5 as a, l_linenumber * 3 + l_partkey % 5 + 1 + l_quantity::bigint % 7 as b from lineitem)
select l_orderkey, a as start, b as "end" from s where not exists (select 1 from s o where o.l_orderkey = s.l_orderkey and o.a <= s.a and o.b >= s.b and o.b - o.a > s.b - s.a)"""


def q69_most_common(spark, sf_dir):
    return merges.most_common(table(spark, sf_dir, "events"), by="user_id", value="event_type", seen="event_id", n=2)


SQL["q69_most_common"] = """with c as (select user_id, event_type, count(*) as n, min(event_id) as first from events group by all)
select user_id, event_type, n, place from (select *, row_number() over (partition by user_id order by n desc, first) as place from c) where place <= 2"""


def q70_ordered_union(spark, sf_dir):
    return merges.ordered_union([_bm25(spark, sf_dir), _sparse(spark, sf_dir)], by="item_id", item="doc_id")


SQL["q70_ordered_union"] = f"""with {BM25.format(k=10)}, {SPARSE.format(k=10)},
u as (select item_id, doc_id, min((list, rank)) as seen from (select item_id, doc_id, 0 as list, rank from bm25 union all select item_id, doc_id, 1, rank from sparse) group by all)
select item_id, doc_id, row_number() over (partition by item_id order by seen, doc_id) as place from u"""


def q71_plan_differences(spark, sf_dir):
    """Orders against a later version of them: lost, gained, and the first field that changed."""
    k = F.col("o_orderkey")
    old = table(spark, sf_dir, "orders").filter(k % 17 != 0).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = table(spark, sf_dir, "orders").filter(k % 19 != 0).select("o_orderkey", F.when(k % 13 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return merges.differences(old, new, key="o_orderkey", fields=["o_orderstatus", "o_orderpriority"])


SQL["q71_plan_differences"] = """with a as (select o_orderkey, o_orderstatus as s, o_orderpriority as p from orders where o_orderkey % 17 <> 0),
b as (select o_orderkey, case when o_orderkey % 13 = 0 then 'X' else o_orderstatus end as s, case when o_orderkey % 11 <> 0 then o_orderpriority end as p from orders where o_orderkey % 19 <> 0),
j as (select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when b.o_orderkey is null then 'lost' when a.o_orderkey is null then 'gained' when a.s is distinct from b.s or a.p is distinct from b.p then 'changed' end as kind,
 case when a.s is distinct from b.s then 'o_orderstatus' else 'o_orderpriority' end as f from a full join b on a.o_orderkey = b.o_orderkey)
select o_orderkey, kind, case when kind = 'changed' then f end as field from j where kind is not null"""


def q72_first_of_page(spark, sf_dir):
    """The section first seen on each page: of a customer's orders the earliest."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"), F.count("*").alias("n"))


SQL["q72_first_of_page"] = "select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as first_order, count(*) as n from orders group by o_custkey"


def q73_sheets(spark, sf_dir):
    """All crops of a figure in order of sheet and page: of a part its lines by supplier and order."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("l_suppkey", "l_orderkey", "l_linenumber"))).alias("x"))
    one = lambda s: F.concat_ws(":", s["l_suppkey"].cast("string"), s["l_orderkey"].cast("string"))
    return rows.select("l_partkey", F.size("x").cast("long").alias("n_sheets"), F.array_join(F.transform("x", one), ",").alias("sheets"))


SQL["q73_sheets"] = "select l_partkey, count(*) as n_sheets, string_agg(l_suppkey || ':' || l_orderkey, ',' order by l_suppkey, l_orderkey, l_linenumber) as sheets from lineitem group by l_partkey"


def q74_siblings(spark, sf_dir):
    """Lines of the same part; parts of more than 24 lines have none."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("line"))
    return merges.siblings(lines, key="line", parent="l_partkey").groupBy("line").agg(F.count("*").alias("n"), F.min("sibling").alias("first"), F.max("sibling").alias("last"))


SQL["q74_siblings"] = """with l as (select l_partkey, l_orderkey * 1000 + l_linenumber as line from lineitem), g as (select l_partkey from l group by l_partkey having count(*) <= 24)
select a.line, count(*) as n, min(b.line) as first, max(b.line) as last from l a join l b using (l_partkey) join g using (l_partkey) where a.line <> b.line group by a.line"""


def q75_cited_by_winners(spark, sf_dir):
    """Sources named by the best hits of each question, by first mention, three at most."""
    docs = _inputs(spark, sf_dir)[0].filter("source is not null").select("doc_id", "source")
    first = _bm25(spark, sf_dir).join(docs, "doc_id").groupBy("item_id", "source").agg(F.min("rank").alias("first_rank"))
    return _round(rank.top(first, ["item_id"], [F.col("first_rank").asc()], 3, rank="place"))


SQL["q75_cited_by_winners"] = f"""with {BM25.format(k=10)}, f as (select item_id, source, min(rank) as first_rank from bm25 join documents using (doc_id) where source is not null group by all)
select item_id, source, first_rank, place from (select *, row_number() over (partition by item_id order by first_rank) as place from f) where place <= 3"""


def q76_rehydrated_hits(spark, sf_dir):
    """Hits with the payload of the corpus; where that lacks it, what the hit itself brought."""
    docs = _inputs(spark, sf_dir)[0].filter("n_chars >= 500").select("doc_id", "lang", "n_chars")
    hits = _bm25(spark, sf_dir).select("item_id", "doc_id", "rank")
    return _round(hits.join(docs, "doc_id", "left").select("item_id", "doc_id", "rank", F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.col("n_chars").isNotNull().alias("found")))


SQL["q76_rehydrated_hits"] = f"""with {BM25.format(k=10)}, d as (select doc_id, lang, n_chars from documents where n_chars >= 500)
select item_id, doc_id, rank, coalesce(lang, 'unknown') as lang, coalesce(n_chars, 0) as n_chars, n_chars is not null as found from bm25 left join d using (doc_id)"""


def q77_rank_cuts(spark, sf_dir):
    """Questions all of whose relevant documents stand at rank 1, 3, 5 and 10 or better."""
    ranked = _qrels(spark, sf_dir).join(_bm25(spark, sf_dir).select("item_id", "doc_id", "rank"), ["item_id", "doc_id"], "left")
    worst = ranked.groupBy("item_id").agg(F.max(F.coalesce("rank", F.lit(1_000_000))).alias("worst"))
    return worst.agg(F.count("*").alias("n"), *(F.count_if(F.col("worst") <= k).alias(f"complete_{k}") for k in (1, 3, 5, 10)))


SQL["q77_rank_cuts"] = f"""with {BM25.format(k=10)}, {QRELS}, w as (select q.item_id, max(coalesce(rank, 1000000)) as worst from qrels q left join bm25 b on b.item_id = q.item_id and b.doc_id = q.doc_id group by q.item_id)
select count(*) as n, {", ".join(f"count(*) filter (where worst <= {k}) as complete_{k}" for k in (1, 3, 5, 10))} from w"""


def q78_section_routing(spark, sf_dir):
    """Routing of each question to sections: which of the sources with relevant documents are among those of its five best hits."""
    source = _inputs(spark, sf_dir)[0].filter("source is not null").select("doc_id", "source")
    gold = _qrels(spark, sf_dir).join(source, "doc_id").groupBy("item_id").agg(F.collect_set("source").alias("gold"))
    hits = _bm25(spark, sf_dir, 5).join(source, "doc_id")
    got = hits.groupBy("item_id").agg(F.collect_set("source").alias("got"), F.min_by("source", "rank").alias("top"))
    both = gold.join(got, "item_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    found = F.size(F.array_intersect("gold", "got"))
    return both.select("item_id", (found == F.size("gold")).alias("complete"), F.round(found / F.size("gold"), 6).alias("recall"), F.coalesce(F.array_contains("gold", F.col("top")), F.lit(False)).alias("top1"), F.size(F.array_except("got", "gold")).cast("long").alias("extras"))


SQL["q78_section_routing"] = f"""with {BM25.format(k=5)}, {QRELS},
g as (select item_id, list(distinct source) as gold from qrels join documents using (doc_id) where source is not null group by item_id),
h as (select item_id, list(distinct source) as got, arg_min(source, rank) as top from bm25 join documents using (doc_id) where source is not null group by item_id),
j as (select item_id, gold, coalesce(got, []) as got, top from g left join h using (item_id))
select item_id, len(list_intersect(gold, got)) = len(gold) as complete, round(len(list_intersect(gold, got)) / len(gold), 6) as recall, coalesce(list_contains(gold, top), false) as top1,
 len(list_filter(got, lambda s: not list_contains(gold, s)))::bigint as extras from j"""


def q79_precision_recall(spark, sf_dir):
    """Precision, recall and F1 of the five best hits, from sums by language."""
    lang = _inputs(spark, sf_dir)[0].select("doc_id", "lang")
    made = _bm25(spark, sf_dir, 5).select("item_id", "doc_id", F.lit(1).alias("made"))
    both = made.join(_qrels(spark, sf_dir).withColumn("gold", F.lit(1)), ["item_id", "doc_id"], "full").join(lang, "doc_id").fillna(0, ["made", "gold"])
    sums = both.groupBy("lang").agg(F.count_if((F.col("made") == 1) & (F.col("gold") == 1)).alias("tp"), F.count_if((F.col("made") == 1) & (F.col("gold") == 0)).alias("fp"), F.count_if((F.col("made") == 0) & (F.col("gold") == 1)).alias("fn"))
    return _round(sums.select("lang", "tp", "fp", "fn", *merges.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))))


SQL["q79_precision_recall"] = f"""with {BM25.format(k=5)}, {QRELS},
j as (select coalesce(b.doc_id, q.doc_id) as doc_id, b.doc_id is not null as made, q.doc_id is not null as gold from bm25 b full join qrels q on b.item_id = q.item_id and b.doc_id = q.doc_id),
s as (select lang, count(*) filter (where made and gold) as tp, count(*) filter (where made and not gold) as fp, count(*) filter (where gold and not made) as fn from j join documents using (doc_id) group by lang)
select lang, tp, fp, fn, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall,
 round(case when tp > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1 from s"""


def q80_merged_evidence(spark, sf_dir):
    """Confidence and evidence of each user's hourly merges."""
    ev = table(spark, sf_dir, "events").select("user_id", F.hour("ts").cast("long").alias("hour"), "event_id", "event_type", _status().alias("status"), F.when(F.col("event_id") % 5 != 0, F.round(F.col("value") / 1000, 6)).alias("p"))
    return merges.merged_evidence(ev, by=["user_id", "hour"], status="status", confidence="p", evidence="event_type", order="event_id")


SQL["q80_merged_evidence"] = f"""with e as (select user_id, hour(ts)::bigint as hour, event_id, event_type, {STATUS} as s, case when event_id % 5 <> 0 then round(value / 1000, 6) end as p from events),
u as (select * from (select *, bool_or(s <> 'NOT_APPLICABLE') over (partition by user_id, hour) as used from e) where s <> 'NOT_APPLICABLE' or not used),
f as (select user_id, hour, event_type, min(event_id) as seen, min(p) filter (where p > 0) as p from u group by all)
select user_id, hour, coalesce(min(p), 0.0)::double as confidence, string_agg(event_type, ',' order by seen) as evidence from f group by all"""


def q81_frames(spark, sf_dir):
    """Frame-bounded analytics of each user's events."""
    by = W.partitionBy("user_id").orderBy("event_id")
    value = W.partitionBy("user_id").orderBy("value", "event_id")
    return table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        F.round(F.avg("value").over(by.rowsBetween(-2, 0)), 6).alias("mean_3"),
        F.round(F.sum("value").over(by.rangeBetween(-500, 0)), 6).alias("sum_500"),
        F.ntile(4).over(value).cast("long").alias("quarter"),
        F.round(F.percent_rank().over(value), 6).alias("percent"),
        F.round(F.cume_dist().over(value), 6).alias("share"),
    )


SQL["q81_frames"] = """select user_id, event_id, round(avg(value) over (b rows between 2 preceding and current row), 6) as mean_3, round(sum(value) over (b range between 500 preceding and current row), 6) as sum_500,
 ntile(4) over v as quarter, round(percent_rank() over v, 6) as percent, round(cume_dist() over v, 6) as share
from events window b as (partition by user_id order by event_id), v as (partition by user_id order by value, event_id)"""


def q82_coverage_gate(spark, sf_dir):
    """Whether at least 0.99 of the orders' customers and of the lines' orders are known."""
    t = lambda n: table(spark, sf_dir, n)
    orders = t("orders").select("o_orderkey", "o_custkey")
    a = orders.join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("hit")), "o_custkey", "left").agg(F.lit("customers").alias("what"), F.count("*").alias("n"), F.count("hit").alias("known"))
    b = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(orders.select("o_orderkey", F.lit(1).alias("hit")), "o_orderkey", "left").agg(F.lit("orders").alias("what"), F.count("*").alias("n"), F.count("hit").alias("known"))
    return a.unionByName(b).select("what", "n", "known", (F.col("known") >= 0.99 * F.col("n")).alias("passes"))


SQL["q82_coverage_gate"] = """with x as (select 'customers' as what, count(*) as n, count(c_custkey) as known from orders left join customer on o_custkey = c_custkey
 union all select 'orders', count(*), count(o_orderkey) from lineitem left join orders on l_orderkey = o_orderkey) select what, n, known, known >= 0.99 * n as passes from x"""

#: Prices a million tokens, as an example.
PRICES = (("assistant", 4.5), ("system", 0.5), ("user", 1.5))


def q83_token_costs(spark, sf_dir):
    """Tokens (a quarter of the code points, rounded up) and cost by role."""
    prices = spark.createDataFrame(PRICES, "role string, price double")
    turns = table(spark, sf_dir, "conversations").select("role", F.ceil(F.char_length(F.coalesce("text", F.lit(""))) / 4).alias("tokens"))
    sums = turns.groupBy("role").agg(F.count("*").alias("n"), F.sum("tokens").cast("long").alias("tokens"))
    return sums.join(prices, "role", "left").select("role", "n", "tokens", F.round(F.col("tokens") * F.coalesce("price", F.lit(0.0)) / 1e6, 6).alias("cost"))


SQL["q83_token_costs"] = f"""with p(role, price) as (values {", ".join(f"('{r}', {x}::double)" for r, x in PRICES)}),
s as (select role, count(*) as n, sum(ceil(length(coalesce(text, '')) / 4))::bigint as tokens from conversations group by role)
select s.role, n, tokens, round(tokens * coalesce(price, 0) / 1e6, 6) as cost from s left join p on s.role = p.role"""


def q84_embed_texts(spark, sf_dir):
    """What is embedded for each normative piece: type, section, title and text; plain of emphasis marks."""
    docs = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*(F.lit(t) for t in ("Standard", "Guidance", "Option", "Support"))), (F.col("doc_id") % 4 + 1).cast("int"))
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"\*\*|__|`", "")
    title = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.nullif(F.col("lang"), F.lit("")), F.lit("untitled"))
    rows = docs.select("doc_id", kind.alias("kind"), F.concat(F.lit("["), kind, F.lit("] Section "), F.col("doc_id").cast("string"), F.lit(" - "), title, F.lit(". "), plain).alias("embedded"))
    return rows.filter(F.col("kind").isin("Standard", "Guidance", "Option")).select("doc_id", "kind", F.sha2("embedded", 256).alias("sha256"), F.char_length("embedded").cast("long").alias("n_chars"))


SQL["q84_embed_texts"] = r"""with d as (select doc_id, (['Standard', 'Guidance', 'Option', 'Support'])[(doc_id % 4 + 1)::int] as kind, coalesce(nullif(source, ''), nullif(lang, ''), 'untitled') as title,
 regexp_replace(coalesce(text, ''), '\*\*|__|`', '', 'g') as t from documents),
e as (select doc_id, kind, '[' || kind || '] Section ' || doc_id || ' - ' || title || '. ' || t as embedded from d where kind in ('Standard', 'Guidance', 'Option'))
select doc_id, kind, sha256(embedded) as sha256, length(embedded)::bigint as n_chars from e"""


def q85_missing_values(spark, sf_dir):
    """Cells of a printed table: a value, a fact that there is none, or missing."""
    k = F.col("p_partkey") % 6
    cell = F.when(k == 0, "-").when(k == 1, "N/A").when(k == 2, "").when(k == 3, F.lit(None)).otherwise(F.col("p_size").cast("string"))
    low = F.lower(F.trim(cell))
    kind = F.when(cell.isNull(), "missing").when(low.isin("-", "n/a", ""), "NOT_UNDER").otherwise("value")
    return table(spark, sf_dir, "part").groupBy("p_brand", kind.alias("kind")).agg(F.count("*").alias("n"))


SQL["q85_missing_values"] = """with c as (select p_brand, case p_partkey % 6 when 0 then '-' when 1 then 'N/A' when 2 then '' when 3 then null else p_size::varchar end as cell from part)
select p_brand, case when cell is null then 'missing' when lower(trim(cell)) in ('-', 'n/a', '') then 'NOT_UNDER' else 'value' end as kind, count(*) as n from c group by all"""

for _name, _f in list(globals().items()):
    if _name[:1] == "q" and _name[1:3].isdigit():
        QUERIES[_name] = _f
