"""Queries over texts: extraction, sentences, containment, statements, numbers, routing, page markup."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics, quotes, verify
from ..sources.tables import table
from .ranking import _CONTENT, _FIRSTS, TOKENS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def q16_canonical_dedupe(spark, sf_dir):
    """The best row of each text (most words, most letters, longest, smallest id), with how many it stands for."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    words = F.size(X.tokens(F.col("text")))
    letters = F.char_length(F.regexp_replace("text", "[^A-Za-z]", ""))
    rows = docs.select(F.md5("text").alias("key"), "doc_id", "source", words.alias("n_words"), letters.alias("n_letters"), F.char_length("text").alias("n"))
    best = rows.groupBy("key").agg(F.max_by(F.struct("doc_id", "source", "n_words"), F.struct("n_words", "n_letters", "n", -F.col("doc_id"))).alias("x"), F.count("*").alias("n_same"))
    return best.select("x.doc_id", "x.source", F.col("x.n_words").cast("long").alias("n_words"), "n_same")


SQL["q16_canonical_dedupe"] = f"""with r as (select md5(text) as key, doc_id, source, len({TOKENS.format("text")}) as n_words,
 length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as n_letters, length(text) as n from documents where text is not null)
select doc_id, source, n_words::bigint as n_words, n_same from (select *, count(*) over (partition by key) as n_same,
 row_number() over (partition by key order by n_words desc, n_letters desc, n desc, doc_id) as k from r) where k = 1"""


def q17_id_suffix(spark, sf_dir):
    """Ids from the first words of texts; only repeats get a suffix."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    base = docs.select("doc_id", X.slug(F.substring("text", 1, 12)).alias("base"))
    k = F.row_number().over(W.partitionBy("base").orderBy("doc_id")) - 1
    return base.withColumn("k", k).select("doc_id", F.when(F.col("k") == 0, F.col("base")).otherwise(F.concat_ws("_", "base", "k")).alias("unique_id"))


SQL["q17_id_suffix"] = """with b as (select doc_id, regexp_replace(lower(substring(text, 1, 12)), '[^a-z0-9]+', '-', 'g') as base from documents where text is not null)
select doc_id, case when k = 0 then base else base || '_' || k end as unique_id from (select *, row_number() over (partition by base order by doc_id) - 1 as k from b)"""


def q21_ref_extraction(spark, sf_dir):
    """Numbers named in user names and texts: lists and ranges spread out, counted for each document that has any."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"(\d{1,6}(?:(?:, | and | through | to )\d{1,6})*)"), F.lit(1)).alias("groups"))
    numbers = docs.filter(F.size("groups") > 0).select("doc_id", F.size("groups").cast("long").alias("n_groups"), F.array_sort(F.array_distinct(F.flatten(F.transform("groups", X.number_list)))).alias("numbers"))
    return numbers.select("doc_id", "n_groups", F.size("numbers").cast("long").alias("n_numbers"), F.array_min("numbers").cast("long").alias("least"), F.array_max("numbers").cast("long").alias("most"))


SQL["q21_ref_extraction"] = r"""with g as (select doc_id, regexp_extract_all(text, '\d{1,6}(?:(?:, | and | through | to )\d{1,6})*') as groups from documents),
p as (select doc_id, len(groups) as n_groups, unnest(groups) as grp from g where len(groups) > 0),
q as (select doc_id, n_groups, unnest(regexp_extract_all(grp, '\d{1,6}(?: (?:through|to) \d{1,6})?')) as part from p),
r as (select doc_id, n_groups, regexp_extract(part, '^\d+')::int as lo, regexp_extract(part, '\d+$')::int as hi from q),
s as (select distinct doc_id, n_groups, unnest(case when hi >= lo then range(lo, hi + 1) else [lo] end) as num from r)
select doc_id, n_groups::bigint as n_groups, count(*) as n_numbers, min(num)::bigint as least, max(num)::bigint as most from s group by doc_id, n_groups"""


def q22_sentences(spark, sf_dir):
    """Sentences of each document, how many are informative (three content words), at most six of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.sentences(F.coalesce("text", F.lit(""))).alias("s"))
    return docs.select(
        "doc_id",
        F.size("s").cast("long").alias("n_sentences"),
        F.coalesce(F.array_max(F.transform("s", F.char_length)), F.lit(0)).cast("long").alias("longest"),
        F.size(F.filter("s", lambda x: F.size(X.content_words(X.tokens(x))) >= 3)).cast("long").alias("n_informative"),
        F.md5(F.array_join(X.informative(F.col("s"), 6), "|")).alias("chosen"),
    )


SQL["q22_sentences"] = f"""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\n]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') as s from documents),
i as (select doc_id, s, list_filter(s, lambda x: len({_CONTENT.format("x")}) >= 3) as f from s)
select doc_id, len(s)::bigint as n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::bigint as longest, len(f)::bigint as n_informative,
 md5(array_to_string(case when len(f) <= 1 then [] when len(f) > 6 then list_concat(f[1:5], f[-1:]) else f end, '|')) as chosen from i"""


def q23_content_words_jaccard(spark, sf_dir):
    """Near-duplicates inside a source: pairs of distinct word sets whose likeness is 0.8 or more.

    Pairs meet on prefix words, the rarest of a set: two sets of likeness t share one of the first n - ceil(t n) + 1.
    """
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.array_distinct(X.content_words(X.tokens(F.col("text")))).alias("ws"))
    return verify.similar_sets(docs, by="source", key="doc_id", words="ws", least=0.8).select("source", "doc_a", "doc_b", F.round("likeness", 6).alias("likeness"))


SQL["q23_content_words_jaccard"] = f"""with w as (select source, doc_id, list_distinct({_CONTENT.format("text")}) as ws from documents),
r as (select source, min(doc_id) as doc_id, ws from (select source, doc_id, list_sort(ws) as ws from w where len(ws) > 0) group by source, ws),
p as (select a.source, a.doc_id as doc_a, b.doc_id as doc_b, len(list_intersect(a.ws, b.ws)) as i, len(a.ws) as na, len(b.ws) as nb
 from r a join r b on a.source = b.source and a.doc_id < b.doc_id and len(a.ws) >= 0.8 * len(b.ws) and len(b.ws) >= 0.8 * len(a.ws))
select source, doc_a, doc_b, round(i / (na + nb - i), 6) as likeness from p where i >= 0.8::double * (na + nb - i)"""


def q24_quote_verification(spark, sf_dir):
    """Which documents hold a benchmark text word for word; a quote is repairable if exactly one does."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = metrics.contains_qrels(docs, items, did="doc_id", dtext=F.col("text"), qid="item_id", qtext=F.col("text"))
    per = found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return items.select("item_id").join(per, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "first_doc", F.coalesce(F.col("n_docs") == 1, F.lit(False)).alias("repairable"))


SQL["q24_quote_verification"] = """with q as (select item_id, doc_id from documents d join benchmark b on contains(d.text, b.text) where b.text <> '')
select b.item_id, count(q.doc_id) as n_docs, min(q.doc_id) as first_doc, count(q.doc_id) = 1 as repairable from benchmark b left join q using (item_id) group by b.item_id"""


def _quotes(spark, sf_dir):
    """Sentences of the lines of each order as evidence, and a quote a line: whole, under a wrong id, altered, short, cut, turned round."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    number = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("The “part” no. "), number("p"), F.lit(" comes from the shop of supplier "), number("s"), F.lit(" — as ordered in line "), number("l_linenumber"))
    evidence = li.select(F.col("l_orderkey").alias("question"), F.concat(F.lit("e"), number("l_linenumber")).alias("id"), text.alias("text"), F.lit("piece").alias("kind"), F.lit(False).alias("image"))
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    first, last = F.concat(F.lit("the \"part\" no. "), number("p"), F.lit(" comes from")), F.concat(F.lit("shop of supplier "), number("s"), F.lit(" - as ordered"))
    quote = (
        F.when(k == 0, F.upper(text)).when(k == 1, F.concat(first, F.lit(" the "), last)).when(k == 2, F.concat(first, F.lit(" a "), last))
        .when(k == 3, F.lit("comes from the shop")).when(k == 4, F.concat(first, F.lit(" … "), last)).otherwise(F.concat(last, F.lit(" [...] "), first))
    )
    source = F.when(k == 1, F.lit("[e99]")).otherwise(F.concat(F.lit("e"), number("l_linenumber")))
    return li.select(F.col("l_orderkey").alias("question"), F.col("l_linenumber").alias("quote_id"), quote.alias("quote"), source.alias("source")), evidence


def q108_quotes_put_right(spark, sf_dir):
    """Whether quotes stand word for word in the evidence of their order, and under which id."""
    return quotes.verify(*_quotes(spark, sf_dir))


SQL["q108_quotes_put_right"] = """with l as (select l_orderkey as q, l_linenumber as n, min(l_partkey) as p, min(l_suppkey) as s from lineitem group by all),
k as (select *, (q + n) % 6 as k, count(*) over (partition by q, p, s) as same from l)
select q as question, n as quote_id, case when k in (0, 4) or k = 1 and same = 1 then 'text' else 'no' end as verified, case when k = 1 and same > 1 then 'e99' else 'e' || n end as id,
 case when k in (0, 4) then '' when k = 1 then case when same = 1 then 'found under e' || n || ', not e99' else 'this id is missing from the evidence' end when k = 3 then 'quote too short' else 'the quote is not in this piece' end as why from k"""


def q25_statements(spark, sf_dir):
    """Lines of conversations as statements: numbered, with their place and the last user line as heading."""
    turns = table(spark, sf_dir, "conversations")
    return verify.statements(turns, by="conv_id", order="turn", text="text", heading=F.col("role") == "user").select(
        "conv_id", "turn", F.col("line").cast("long").alias("line"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("n").cast("long").alias("n"), F.md5("heading").alias("heading")
    )


SQL["q25_statements"] = """with l as (select conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) as ls from conversations),
x as (select conv_id, turn, role, generate_subscripts(ls, 1) - 1 as line, unnest(ls) as s, ls from l),
y as (select *, coalesce(list_sum(list_transform(ls[1:line], lambda z: length(z) + 1)), 0) as start from x),
z as (select *, case when role = 'user' then s end as head from y where trim(s) <> '')
select conv_id, turn, line::bigint as line, start::bigint as start, (start + length(s))::bigint as end,
 row_number() over (partition by conv_id order by turn, line) as n,
 md5(last_value(head ignore nulls) over (partition by conv_id order by turn, line rows between unbounded preceding and current row)) as heading from z"""


def q26_number_provenance(spark, sf_dir):
    """Numbers in assistant turns that neither the user nor the system turns of the conversation have."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\d+)"), F.lit(1)).alias("ns"))
    said = turns.select("conv_id", (F.col("role") == "assistant").alias("claim"), F.explode_outer("ns").alias("num"))
    per = said.groupBy("conv_id", "num").agg(F.max("claim").alias("claimed"), F.max(~F.col("claim")).alias("given"))
    return per.groupBy("conv_id").agg(F.count_if(F.col("claimed") & F.col("num").isNotNull()).alias("n_claimed"), F.count_if(F.col("claimed") & ~F.col("given") & F.col("num").isNotNull()).alias("n_unsupported"))


SQL["q26_number_provenance"] = r"""with s as (select conv_id, role = 'assistant' as claim, unnest(case when len(ns) = 0 then [null] else ns end) as num from (select conv_id, role, regexp_extract_all(coalesce(text, ''), '\d+') as ns from conversations)),
p as (select conv_id, num, bool_or(claim) as claimed, bool_or(not claim) as given from s group by all)
select conv_id, count(*) filter (where claimed and num is not null) as n_claimed, count(*) filter (where claimed and not given and num is not null) as n_unsupported from p group by conv_id"""


def q27_router(spark, sf_dir):
    """Whether a user turn wants a picture: an ordered ladder of cues, else a score from a prior; yes from 0.5."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    long_share = turns.groupBy("conv_id").agg(F.avg((F.char_length("text") > 300).cast("double")).alias("prior"))
    t = F.lower(F.coalesce("text", F.lit("")))
    explicit, verb, textual, noun, place = t.rlike(r"\d{3,}"), t.rlike("thion([^a-z]|$)|shwh"), t.rlike("(^|[^a-z])(the|und|que|les)([^a-z]|$)"), t.rlike("tion|keit|mente|ment"), t.rlike("(^|[^a-z])(on|in|en|an)([^a-z]|$)")
    score = 0.45 * verb.cast("int") + 0.30 * noun.cast("int") - 0.35 * textual.cast("int") + 0.15 * place.cast("int") + 0.35 * F.col("prior")
    way = F.when(explicit, "explicit").when(verb & ~textual, "verb").when(textual & ~noun, "textual").otherwise("score")
    rows = turns.join(long_share, "conv_id").select("conv_id", "turn", way.alias("way"), score.alias("score"))
    yes = F.when(F.col("way").isin("explicit", "verb"), True).when(F.col("way") == "textual", False).otherwise(F.round("score", 9) >= 0.5)
    sure = F.when(F.col("way") == "explicit", 0.99).when(F.col("way") == "verb", 0.95).when(F.col("way") == "textual", 0.9).otherwise(F.least(F.lit(0.9), 0.5 + F.abs(F.col("score") - 0.5)))
    return rows.select("conv_id", "turn", "way", yes.alias("wants"), F.round(sure, 6).alias("confidence"))


SQL["q27_router"] = r"""with t as (select conv_id, turn, lower(coalesce(text, '')) as t, avg((length(text) > 300)::int::double) over (partition by conv_id) as prior from conversations where role = 'user'),
f as (select *, regexp_matches(t, '\d{3,}') as ex, regexp_matches(t, 'thion([^a-z]|$)|shwh') as ve, regexp_matches(t, '(^|[^a-z])(the|und|que|les)([^a-z]|$)') as te, regexp_matches(t, 'tion|keit|mente|ment') as no, regexp_matches(t, '(^|[^a-z])(on|in|en|an)([^a-z]|$)') as pl from t),
s as (select conv_id, turn, case when ex then 'explicit' when ve and not te then 'verb' when te and not no then 'textual' else 'score' end as way,
 0.45::double * ve::int + 0.30::double * no::int - 0.35::double * te::int + 0.15::double * pl::int + 0.35::double * prior as score from f)
select conv_id, turn, way, case when way in ('explicit', 'verb') then true when way = 'textual' then false else round(score, 9) >= 0.5 end as wants,
 round(case way when 'explicit' then 0.99 when 'verb' then 0.95 when 'textual' then 0.9 else least(0.9::double, 0.5::double + abs(score - 0.5::double)) end::double, 6) as confidence from s"""


def q28_json_props(spark, sf_dir):
    """Typed extraction from a JSON column, with unreadable rows counted."""
    ev = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").alias("p"), F.col("props").isNull().alias("none"))
    k = F.col("p.k")
    return ev.groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"), F.count_if(k.isNull() & ~F.col("none")).alias("n_bad"))


SQL["q28_json_props"] = """with e as (select event_type, props, try_cast(json_extract_string(props, '$.k') as bigint) as k from events)
select event_type, count(k) as n, sum(k)::bigint as sum_k, max(k) as max_k, count(*) filter (where k is null and props is not null) as n_bad from e group by event_type"""


def q54_html_links(spark, sf_dir):
    """Links, headings and paragraphs of pages, added up by host."""
    pages = table(spark, sf_dir, "pages").select(F.parse_url("url", F.lit("HOST")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    per = pages.select("host", F.size(links).alias("n_links"), F.size(F.regexp_extract_all("html", F.lit("<h[1-6]>"), F.lit(0))).alias("n_heads"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).alias("n_p"))
    return per.groupBy("host").agg(F.count("*").alias("n_pages"), F.sum("n_links").alias("n_links"), F.sum("n_heads").alias("n_heads"), F.sum("n_p").alias("n_paragraphs"))


SQL["q54_html_links"] = """select regexp_extract(url, '://([^/:?#]+)', 1) as host, count(*) as n_pages, sum(len(regexp_extract_all(coalesce(html, ''), '<a href="([^"]*)"')))::bigint as n_links,
 sum(len(regexp_extract_all(coalesce(html, ''), '<h[1-6]>')))::bigint as n_heads, sum(len(regexp_extract_all(coalesce(html, ''), '<p>')))::bigint as n_paragraphs from pages group by 1"""


def q57_evidence_order(spark, sf_dir):
    """Evidence blocks: for each source the documents that hold a benchmark text, grouped by type in fixed order."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    used = metrics.contains_qrels(docs, items, did="doc_id", dtext=F.col("text"), qid="item_id", qtext=F.col("text")).select("doc_id").distinct()
    rows = docs.select("doc_id", "source", "lang").join(used, "doc_id").withColumn("place", F.pmod("doc_id", F.lit(4)))
    name = F.element_at(F.array(*(F.lit(x) for x in ("Standard", "Guidance", "Option", "Support"))), (F.col("place") + 1).cast("int"))
    line = F.format_string("[%s] %s: document %d", name, "lang", "doc_id")
    return rows.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("evidence"))


SQL["q57_evidence_order"] = """with u as (select distinct doc_id from documents d join benchmark b on contains(d.text, b.text) where b.text <> ''),
r as (select doc_id, source, doc_id % 4 as place, '[' || (['Standard', 'Guidance', 'Option', 'Support'])[(doc_id % 4 + 1)::int] || '] ' || lang || ': document ' || doc_id as line from documents join u using (doc_id))
select source, string_agg(line, chr(10) order by place, doc_id) as evidence from r group by source"""


def q58_arith_recheck(spark, sf_dir):
    """Products recomputed for all order lines, and stated sums that hold within tolerance."""
    li = table(spark, sf_dir, "lineitem")
    stated = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 1)
    exact = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    ok = F.abs(stated - exact) <= F.greatest(F.lit(0.5 * 10**-1), 0.005 * F.abs(exact)) + 1e-9
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_hold"), F.round(F.sum(exact), 2).alias("revenue"))


SQL["q58_arith_recheck"] = """with x as (select l_returnflag, l_linestatus, l_extendedprice * (1 - l_discount) as exact, round(l_extendedprice * (1 - l_discount), 1) as stated from lineitem)
select l_returnflag, l_linestatus, count(*) as n, count(*) filter (where abs(stated - exact) <= greatest(0.05::double, 0.005::double * abs(exact)) + 1e-9) as n_hold, round(sum(exact), 2) as revenue from x group by all"""


def q59_page_context(spark, sf_dir):
    """Turns with their neighbours, as long as the texts so far fit in 1,200 characters."""
    turns = table(spark, sf_dir, "conversations").withColumn("size", F.coalesce(F.char_length("text"), F.lit(0)))
    w = W.partitionBy("conv_id").orderBy("turn", "role", F.md5(F.coalesce("text", F.lit(""))))
    rows = turns.select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"), F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    return rows.filter("upto <= 1200")


SQL["q59_page_context"] = """select * from (select conv_id, turn, role, lag(role) over w as before, lead(role) over w as after,
 (sum(coalesce(length(text), 0)) over (partition by conv_id order by turn, role, md5(coalesce(text, '')) rows between unbounded preceding and current row))::bigint as upto
 from conversations window w as (partition by conv_id order by turn, role, md5(coalesce(text, '')))) where upto <= 1200"""

for _name, _f in list(globals().items()):
    if _name[:1] == "q" and _name[1:3].isdigit():
        QUERIES[_name] = _f
