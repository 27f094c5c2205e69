"""Queries over provisions: list modes, verdicts, comparisons, citations, coverage of contexts and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import passages as P
from ..functions import provisions as V
from ..operators import facts
from ..sources.tables import table
from .passages import _SIGNS, _signs
from .ranking import BM25, QRELS, SPARSE, _bm25, _inputs, _qrels, _round, _sparse

QUERIES: dict = {}
SQL: dict[str, str] = {}

LEADS = ("The sign shall have one or more of the following", "All of the following apply", "Except in the following cases", "The sign should be")


def _pick(values, key):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (key % len(values) + 1).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def q86_list_modes(spark, sf_dir):
    """How the lines of each order combine, by its lead and the words that end its first and last but one line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_returnflag"), F.when(F.col("l_suppkey") % 3 == 0, " or;").when(F.col("l_suppkey") % 3 == 1, ", and").otherwise(".")).alias("item"))
    lists = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("l_linenumber", "item"))).alias("items"))
    before_last = F.when(F.col("n") > 1, F.try_element_at("items", F.lit(-2))["item"])
    mode = V.list_mode(_pick(LEADS, F.col("l_orderkey")), F.col("items")[0]["item"], before_last, F.col("n"))
    return lists.select("l_orderkey", "n", mode.alias("mode"))


SQL["q86_list_modes"] = f"""with i as (select l_orderkey, l_linenumber, l_returnflag || case l_suppkey % 3 when 0 then ' or;' when 1 then ', and' else '.' end as item from lineitem),
g as (select l_orderkey, count(*) as n, list(item order by l_linenumber, item) as items, ({_sql_list(LEADS)})[(l_orderkey % 4 + 1)::int] as lead from i group by l_orderkey)
select l_orderkey, n, case when regexp_matches(lead, '(?i)\\bexcept\\b[^.]*\\bfollowing\\b') then 'EXCEPTION CASES'
 when regexp_matches(lead, '(?i)\\bone or more of\\b') or n > 1 and regexp_matches(items[1], '(?i)\\bor *[.;,]? *$') then 'ANY'
 when n > 1 and (regexp_matches(lead, '(?i)\\ball of\\b') or regexp_matches(items[-2], '(?i)\\band *[.;,]? *$')) then 'ALL' else 'NOT STATED' end as mode from g"""


def q87_reply_verdicts(spark, sf_dir):
    """Verdicts of replies, in fences or behind a sentence or bare, some of which can't be read or cite what they weren't given."""
    k = F.col("event_id")
    word = _pick(("true", "FALSE", "maybe", "not_applicable", " Unknown "), k)
    object_ = F.concat(F.lit('{"status": "'), word, F.lit('", "confidence": '), F.when(k % 11 == 0, F.lit('"high"')).otherwise(F.concat((k % 13 - 2).cast("string"), F.lit(".5"))), F.lit(', "evidence": ["c'), (k % 4).cast("string"), F.lit('", " c'), (k % 6).cast("string"), F.lit('", ""]}'))
    reply = (
        F.when(k % 7 == 0, F.lit("I think so"))
        .when(k % 7 == 1, F.concat(F.lit("```json\n"), object_, F.lit("\n```")))
        .when(k % 7 == 2, F.concat(F.lit("Here is my answer: "), object_, F.lit(" Thanks.")))
        .when(k % 7 == 3, F.concat(object_, F.lit(" or {}")))
        .otherwise(object_)
    )
    allowed = F.array(F.lit("c0"), F.lit("c1"), F.lit("c2"))
    return table(spark, sf_dir, "events").select("event_id", *V.verdict(reply, allowed))


SQL["q87_reply_verdicts"] = """with e as (select event_id, event_id % 7 not in (0, 3) and event_id % 5 in (0, 1, 4) as ok, (['TRUE', 'FALSE', '', '', 'UNKNOWN'])[(event_id % 5 + 1)::int] as s,
 case when event_id % 11 = 0 then 0 else ((event_id % 13 - 2)::varchar || '.5')::double end as p, 'c' || (event_id % 4) as a, 'c' || (event_id % 6) as b from events),
c as (select *, case when not ok then [] else [a, b] end as cites from e)
select event_id, case when ok then s else 'UNKNOWN' end as status, case when ok then greatest(0.0, least(1.0, p)) else 0.0 end::double as confidence,
 array_to_string(list_filter(cites, lambda x: x in ('c0', 'c1', 'c2')), ',') as kept, array_to_string(list_filter(cites, lambda x: x not in ('c0', 'c1', 'c2')), ',') as dropped from c"""

UNITS = ("ft", "in", "yd", "lb")
OPS = (">=", "<=", ">", "<", "=")


def q88_comparisons(spark, sf_dir):
    """Conditions on lengths against the facts of a nation: facts by name, else by the one that ends with it."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    known = s.select(F.col("s_nationkey").alias("case"), F.concat(F.lit("lane"), (k % 3).cast("string"), F.lit(".width"), (k % 7).cast("string")).alias("name"), (k % 50).cast("double").alias("value"), _pick(UNITS[:3], k).alias("unit")).dropDuplicates(["case", "name", "value", "unit"])
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 2 == 0, F.concat(F.lit("lane"), (k % 3).cast("string"), F.lit("."))).otherwise(""), F.lit("width"), (k % 7).cast("string"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("case"), name.alias("name"), _pick(OPS, k).alias("op"), (k % 60).cast("double").alias("bound"), _pick(UNITS, k).alias("unit"))
    return facts.compare(asked, known)


SQL["q88_comparisons"] = f"""with u(unit, f) as (values ('ft', 1.0::double), ('in', 1.0::double / 12), ('yd', 3.0::double)),
k as (select distinct s_nationkey as c, 'lane' || (s_suppkey % 3) || '.width' || (s_suppkey % 7) as name, (s_suppkey % 50) * f as v, unit, s_suppkey % 50 as raw from supplier join u on u.unit = (['ft', 'in', 'yd'])[(s_suppkey % 3 + 1)::int]),
a as (select c_custkey as id, c_nationkey as c, case when c_custkey % 2 = 0 then 'lane' || (c_custkey % 3) || '.' else '' end || 'width' || (c_custkey % 7) as name, ({_sql_list(OPS)})[(c_custkey % 5 + 1)::int] as op,
 (c_custkey % 60) * f as b from customer left join u on u.unit = ({_sql_list(UNITS)})[(c_custkey % 4 + 1)::int]),
n as (select id, op, b, count(k.name) filter (where k.name = a.name) as exact, min(v) filter (where k.name = a.name) as ve, count(k.name) as n, min(v) as v from a left join k on k.c = a.c and (k.name = a.name or k.name like '%.' || a.name) group by all),
w as (select id, op, b, case when exact = 1 then ve when exact = 0 and n = 1 then v end as v from n)
select id, v is not null as resolved, case when v is null or b is null then 'UNKNOWN' when case op when '>=' then v >= b - 1e-9 when '<=' then v <= b + 1e-9 when '>' then v > b + 1e-9 when '<' then v < b - 1e-9 else abs(v - b) <= 1e-9 end then 'TRUE' else 'FALSE' end as status from w"""


def q89_cited_sections(spark, sf_dir):
    """Which customers' sections each customer's orders refer to: known ones, each once, not itself."""
    cites = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("section"), (F.col("o_orderkey") % 997 + 1).alias("cited")).filter("section <> cited").distinct()
    return cites.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cited")), "cited", "left_semi").select("section", "cited")


SQL["q89_cited_sections"] = "select distinct o_custkey as section, o_orderkey % 997 + 1 as cited from orders where o_custkey <> o_orderkey % 997 + 1 and o_orderkey % 997 + 1 in (select c_custkey from customer)"


def q90_context_coverage(spark, sf_dir):
    """Recall, hit and reciprocal rank of contexts that stand for two documents each (a hit and the next id)."""
    context = _bm25(spark, sf_dir, 10).select("item_id", "rank", F.explode(F.array(F.col("doc_id"), F.col("doc_id") + 1)).alias("doc_id"))
    covered = _qrels(spark, sf_dir).join(context.groupBy("item_id", "doc_id").agg(F.min("rank").alias("rank")), ["item_id", "doc_id"], "left")
    return _round(covered.groupBy("item_id").agg((F.count("rank") / F.count("*")).alias("recall"), (F.count("rank") > 0).alias("hit"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr")))


SQL["q90_context_coverage"] = f"""with {BM25.format(k=10)}, {QRELS}, c as (select item_id, rank, unnest([doc_id, doc_id + 1]) as doc_id from bm25), f as (select item_id, doc_id, min(rank) as rank from c group by all)
select q.item_id, round(count(rank) / count(*), 6) as recall, count(rank) > 0 as hit, round(coalesce(1 / min(rank), 0), 6) as mrr from qrels q left join f on f.item_id = q.item_id and f.doc_id = q.doc_id group by q.item_id"""


def q91_visual_hits(spark, sf_dir):
    """Exact hit, recall and precision of the sources shown, and whether a relevant page is among the first 1, 3 and 4."""
    docs = _inputs(spark, sf_dir)[0].select("doc_id", "source")
    gold = _qrels(spark, sf_dir).join(docs, "doc_id").groupBy("item_id").agg(F.collect_set("source").alias("sources"), F.collect_set("doc_id").alias("pages"))
    shown = _bm25(spark, sf_dir, 4).join(docs, "doc_id").groupBy("item_id").agg(F.collect_set("source").alias("shown"), F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("hits"))
    both = gold.join(shown, "item_id").withColumn("common", F.size(F.array_intersect("sources", "shown")))
    at = lambda k: F.exists(F.slice("hits", 1, k), lambda h: F.array_contains("pages", h["doc_id"])).alias(f"page_hit_{k}")
    share = lambda of: F.when(F.size(of) > 0, F.col("common") / F.size(of)).otherwise(0.0)
    exact = (F.size("sources") == F.col("common")) & (F.size("shown") == F.col("common"))
    return _round(both.select("item_id", exact.alias("exact"), share("sources").alias("recall"), share("shown").alias("precision"), at(1), at(3), at(4)))


SQL["q91_visual_hits"] = f"""with {BM25.format(k=4)}, {QRELS}, g as (select item_id, coalesce(list(distinct source) filter (where source is not null), []) as sources, list(doc_id) as pages from qrels join documents using (doc_id) group by item_id),
h as (select item_id, coalesce(list(distinct source) filter (where source is not null), []) as shown, list(doc_id order by rank) as hits from bm25 join documents using (doc_id) group by item_id),
j as (select *, len(list_intersect(sources, shown)) as n from g join h using (item_id))
select item_id, n = len(sources) and n = len(shown) as exact, round(case when len(sources) > 0 then n / len(sources) else 0 end, 6) as recall, round(case when len(shown) > 0 then n / len(shown) else 0 end, 6) as precision,
 list_has_any(hits[1:1], pages) as page_hit_1, list_has_any(hits[1:3], pages) as page_hit_3, list_has_any(hits[1:4], pages) as page_hit_4 from j"""


def q92_entity_links(spark, sf_dir):
    """Codes named in titles that are nodes: those that some title of an even key has."""
    named = _signs(spark, sf_dir).select("p_partkey", F.explode(F.array_distinct(P.codes(F.col("text")))).alias("code"))
    nodes = named.filter(F.col("p_partkey") % 2 == 0).select("code").distinct()
    return named.join(nodes, "code", "left_semi").groupBy("code").agg(F.count("*").alias("n_titles"), F.min("p_partkey").alias("first_title"))


SQL["q92_entity_links"] = f"""with {_SIGNS}, c as (select distinct p_partkey, unnest(regexp_extract_all(text, '\\b(OM|EM|RM|R|W|D|I|M)([0-9]{{1,3}}(?:-[0-9]{{1,3}})?[a-z]?P?)\\b')) as code from t)
select code, count(*) as n_titles, min(p_partkey) as first_title from c where code in (select code from c where p_partkey % 2 = 0) group by code"""


def q93_contents_guard(spark, sf_dir):
    """Lines that are no entries of contents, on pages of which at most half the lines are."""
    o = table(spark, sf_dir, "orders")
    lines = o.select(F.col("o_custkey").alias("page"), F.concat(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 5 < 2, F.concat(F.lit(" ......... "), (F.col("o_orderkey") % 900).cast("string"))).otherwise(" ... 7")).alias("line"))
    pages = lines.groupBy("page").agg(F.count("*").alias("n"), F.count_if(V.is_entry(F.col("line"))).alias("entries"))
    return pages.select("page", "n", F.when(2 * F.col("entries") > F.col("n"), 0).otherwise(F.col("n") - F.col("entries")).cast("long").alias("kept"))


SQL["q93_contents_guard"] = """with p as (select o_custkey as page, count(*) as n, count(*) filter (where o_orderkey % 5 < 2) as entries from orders group by o_custkey)
select page, n, case when 2 * entries > n then 0 else n - entries end::bigint as kept from p"""


def q94_retrieval_gate(spark, sf_dir):
    """Which targets a later run gains and loses against an earlier one, and whether it has all."""
    run = lambda df, name: df.select("item_id", "doc_id", F.lit(1).alias(name))
    both = _qrels(spark, sf_dir).join(run(_bm25(spark, sf_dir, 5), "before"), ["item_id", "doc_id"], "left").join(run(_sparse(spark, sf_dir, 5), "after"), ["item_id", "doc_id"], "left")
    had, has = F.col("before").isNotNull(), F.col("after").isNotNull()
    return both.groupBy("item_id").agg(F.count("*").alias("targets"), F.count_if(has & ~had).alias("gained"), F.count_if(had & ~has).alias("lost"), F.bool_and(has).alias("passes"))


SQL["q94_retrieval_gate"] = f"""with {BM25.format(k=5)}, {SPARSE.format(k=5)}, {QRELS},
j as (select q.item_id, b.doc_id is not null as had, s.doc_id is not null as has from qrels q left join bm25 b on b.item_id = q.item_id and b.doc_id = q.doc_id left join sparse s on s.item_id = q.item_id and s.doc_id = q.doc_id)
select item_id, count(*) as targets, count(*) filter (where has and not had) as gained, count(*) filter (where had and not has) as lost, bool_and(has) as passes from j group by item_id"""

for _name, _f in list(globals().items()):
    if _name[:1] == "q" and _name[1:3].isdigit():
        QUERIES[_name] = _f
