"""Queries over runs and their evaluation: relevance, calibration, bootstrap, breakdowns, logs, composites."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import metrics, replies, runs
from ..sources.tables import table
from ..streaming.runs import windowed_state
from .ranking import BM25, QRELS, SPARSE, _bm25, _qrels, _round, _sparse

QUERIES: dict = {}
SQL: dict[str, str] = {}


def q15_qrels_reasons(spark, sf_dir):
    """Relevant documents of each item by page, section range or contained text, with all reasons.

    An item's gold is a page and a section range such as src3-src5; the range is spread over the sections there are.
    The alternatives are equi-joins whose rows are united, not one join with OR.
    """
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    gold = items.select("item_id", F.pmod("item_id", F.lit(997)).alias("page"), F.pmod("item_id", F.lit(18)).cast("int").alias("lo"))
    d = docs.select("doc_id", F.pmod("doc_id", F.lit(997)).alias("page"), F.regexp_extract("source", "^([a-z]+)([0-9]+)$", 2).try_cast("int").alias("no"))
    by_page = gold.join(d, "page").select("item_id", "doc_id", F.lit("page").alias("reason"))
    spread = gold.select("item_id", F.explode(F.sequence("lo", F.col("lo") + 2)).alias("no"))
    by_section = spread.join(d, "no").select("item_id", "doc_id", F.lit("section").alias("reason"))
    by_text = _qrels(spark, sf_dir).withColumn("reason", F.lit("text"))
    rows = by_page.unionByName(by_section).unionByName(by_text)
    return rows.groupBy("item_id", "doc_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


SQL["q15_qrels_reasons"] = f"""with {QRELS},
g as (select item_id, item_id % 997 as page, item_id % 18 as lo from benchmark),
d as (select doc_id, doc_id % 997 as page, try_cast(regexp_extract(source, '^([a-z]+)([0-9]+)$', 2) as int) as num from documents),
r as (select item_id, doc_id, 'page' as reason from g join d using (page) union select item_id, doc_id, 'section' from g join d on num between lo and lo + 2 union select item_id, doc_id, 'text' from qrels)
select item_id, doc_id, string_agg(reason, ',' order by reason) as reasons from r group by all"""


def q45_calibration(spark, sf_dir):
    """Brier score and expected calibration error of event values as confidences of purchases."""
    ev = table(spark, sf_dir, "events")
    return _round(metrics.calibration(ev, confidence=F.least(F.lit(1.0), F.col("value") / 100), outcome=F.col("event_type") == "purchase"))


SQL["q45_calibration"] = """with r as (select least(1.0::double, value / 100) as p, (event_type = 'purchase')::int::double as y from events where value is not null),
b as (select least(floor(p * 10), 9) as bin, count(*) as n, avg(p) as conf, avg(y) as acc, sum((p - y) ** 2) as se from r group by bin)
select sum(n)::bigint as n, round(sum(se) / sum(n), 6) as brier, round(sum(n * abs(acc - conf)) / sum(n), 6) as ece from b"""

REPLICATES = 800


def q46_bootstrap_ci(spark, sf_dir):
    """Mean difference of quality and toxicity labels with its bootstrap interval."""
    deltas = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).cast("double").alias("delta"))
    return _round(metrics.bootstrap(deltas, value="delta", order=["doc_id"], replicates=REPLICATES))


SQL["q46_bootstrap_ci"] = f"""with p as (select (quality - toxic)::double as delta, row_number() over (order by doc_id) - 1 as pos, count(*) over () as n from labels),
d as (select rep, ('0x' || substr(md5(rep || ':' || pos), 1, 6))::bigint % n as pos from p, range({REPLICATES}) r(rep)),
m as (select rep, avg(delta) as m from d join p using (pos) group by rep)
select round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high, (select count(*) from labels) as n, (select round(avg(quality - toxic), 6) from labels) as mean from m"""


def q47_breakdown_marginals(spark, sf_dir):
    """Documents by language, quality and toxicity with all marginals at once."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    sets = d.groupingSets([["lang", "quality", "toxic"], ["lang"], ["quality"], ["toxic"], []], "lang", "quality", "toxic")
    rows = sets.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("avg_chars"))
    return rows.select("lang", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"), F.col("level").cast("long").alias("level"), "n", "avg_chars")


SQL["q47_breakdown_marginals"] = """select lang, quality::bigint as quality, toxic::bigint as toxic, grouping(lang, quality, toxic)::bigint as level, count(*) as n, round(avg(n_chars), 6) as avg_chars
from documents join labels using (doc_id) group by grouping sets ((lang, quality, toxic), (lang), (quality), (toxic), ())"""


def q48_paired_delta(spark, sf_dir):
    """Questions that sparse search answers among its first ten and BM25 doesn't, and the other way round."""
    items, qrels = table(spark, sf_dir, "benchmark").select("item_id"), _qrels(spark, sf_dir)

    def passed(ranked):
        hit = ranked.join(qrels, ["item_id", "doc_id"], "left_semi").select("item_id").distinct().withColumn("passed", F.lit(True))
        return items.join(hit, "item_id", "left").select("item_id", F.coalesce("passed", F.lit(False)).alias("passed"))

    return runs.compare_runs(passed(_bm25(spark, sf_dir)), passed(_sparse(spark, sf_dir)), key="item_id")


SQL["q48_paired_delta"] = f"""with {BM25.format(k=10)}, {SPARSE.format(k=10)}, {QRELS},
p as (select item_id, item_id in (select item_id from bm25 semi join qrels using (item_id, doc_id)) as b, item_id in (select item_id from sparse semi join qrels using (item_id, doc_id)) as a from benchmark)
select count(*) filter (where b) as n_before, count(*) filter (where a) as n_after, count(*) filter (where a and not b) as n_gained, count(*) filter (where b and not a) as n_lost, 0::bigint as n_unmatched from p"""


def q49_coverage_census(spark, sf_dir):
    """Parts that orders mention against parts of the catalogue under 1,000, by brand."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_brand", "p_retailprice")
    said = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("part")).distinct().join(parts.select("part", "p_brand"), "part")
    return _round(runs.coverage(said, parts.filter("p_retailprice < 1000"), by="p_brand", key="part"))


SQL["q49_coverage_census"] = """with m as (select distinct p_brand, p_partkey as part from lineitem join part on l_partkey = p_partkey where l_quantity >= 49),
e as (select p_brand, p_partkey as part from part where p_retailprice < 1000)
select coalesce(m.p_brand, e.p_brand) as p_brand, count(m.part) as n_mentioned, count(e.part) as n_extracted, count(*) filter (where e.part is null) as n_missing, count(*) filter (where m.part is null) as n_extra,
 round(count(*) filter (where m.part is not null and e.part is not null) / nullif(count(m.part), 0), 6) as coverage from m full join e on m.p_brand = e.p_brand and m.part = e.part group by 1"""


def q50_latest_ok_resume(spark, sf_dir):
    """Events as a run log, keyed by user and hour: last success, and what is to be run again."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "purchase", "click")).withColumn("hour", F.hour("ts").cast("long"))
    return runs.resume_state(ev, key=["user_id", "hour"], order="event_id", ok=F.col("event_type") != "error")


SQL["q50_latest_ok_resume"] = """select user_id, hour(ts)::bigint as hour, count(*) as n_attempts, count(*) filter (where event_type <> 'error') as n_ok, max(event_id) filter (where event_type <> 'error') as last_ok,
 arg_max(event_type, event_id) = 'error' as last_failed, count(*) filter (where event_type <> 'error') = 0 as run_again from events where event_type in ('error', 'purchase', 'click') group by 1, 2"""


def q51_publish_state(spark, sf_dir):
    """A snapshot by hour of the log: keys done, failed and left, and whether the hour is complete."""
    state = q50_latest_ok_resume(spark, sf_dir)
    users = table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("n_users"))
    per = state.groupBy("hour").agg(F.count_if(~F.col("run_again")).alias("completed"), F.count_if("run_again").alias("failed"))
    return per.crossJoin(F.broadcast(users)).select("hour", "completed", "failed", (F.col("n_users") - F.col("completed")).alias("remaining"), (F.col("n_users") == F.col("completed")).alias("complete"))


SQL["q51_publish_state"] = f"""with s as ({SQL["q50_latest_ok_resume"]}), u as (select count(distinct user_id) as n from events)
select hour, count(*) filter (where not run_again) as completed, count(*) filter (where run_again) as failed, any_value(n) - count(*) filter (where not run_again) as remaining, any_value(n) = count(*) filter (where not run_again) as complete from s, u group by hour"""


def q52_stream_latest_state(spark, sf_dir):
    """The event log as a stream with a watermark and hourly windows, run through all there is."""
    return windowed_state(spark, f"{sf_dir}/events.parquet")


SQL["q52_stream_latest_state"] = """select event_type, time_bucket(interval '1 hour', ts) as since, count(*) as n, max(value) as most, arg_max(value, event_id) as latest from events group by 1, 2"""


def _parts_of_score(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    share = lambda c: F.avg(c.cast("double"))
    return d.groupBy("lang").agg(
        share(F.col("quality") == 1).alias("a"),
        share(F.col("toxic") == 0).alias("b"),
        share(F.col("n_chars") > 500).alias("c"),
        share(F.col("n_chars") < 5000).alias("d"),
        share((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("e"),
        share(F.col("doc_id") % 2 == 0).alias("f"),
    )


def q55_composite_scores(spark, sf_dir):
    """Retrieval, generation and reliability scores by language from shares of labelled documents, and the total of 100."""
    p = _parts_of_score(spark, sf_dir)
    c = {k: F.col(k) for k in "abcdef"}
    r = metrics.composites(recall=c["a"], mrr=c["b"], ndcg=c["c"], precision=c["d"], routing=c["e"], sufficiency=c["f"])
    g = metrics.generation_score(correctness=c["a"], completeness=c["b"], faithfulness=c["c"], citation=c["d"], visual=c["e"], unanswerable=c["f"])
    s = metrics.reliability_score(success=c["b"], brier=1 - c["a"], ece=1 - c["e"])
    return p.select("lang", F.round(r, 4).alias("retrieval"), F.round(g, 4).alias("generation"), F.round(s, 4).alias("reliability"), F.round((r + g + s) / 97 * 100, 4).alias("total"), F.round((r + g + s - 6 * (1 - (2 - c["a"] - c["e"]) / 2)) / 91 * 100, 4).alias("common"))


SQL["q55_composite_scores"] = """with p as (select lang, avg((quality = 1)::int) as a, avg((toxic = 0)::int) as b, avg((n_chars > 500)::int) as c, avg((n_chars < 5000)::int) as d, avg((quality = 1 and toxic = 0)::int) as e, avg((doc_id % 2 = 0)::int) as f from documents join labels using (doc_id) group by lang),
s as (select lang, 10 * a + 5 * (b + c) / 2 + 5 * d + 3 * e + 2 * f as r, 22 * a + 10 * b + 12 * c + 6 * d + 7 * e + 3 * f as g, 6 * b + 6 * (1 - ((1 - a) + (1 - e)) / 2) as s, 6 * (1 - (2 - a - e) / 2) as k from p)
select lang, round(r, 4) as retrieval, round(g, 4) as generation, round(s, 4) as reliability, round((r + g + s) / 97 * 100, 4) as total, round((r + g + s - k) / 91 * 100, 4) as common from s"""


def q56_msdi_bands(spark, sf_dir):
    """Difficulty of documents: five components from 0 to 2, their sum and its band."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    grade = lambda v, low, high: F.when(v >= high, 2).when(v >= low, 1).otherwise(0)
    n = F.char_length("text")
    lines = F.size(F.split("text", "\n"))
    digits = n - F.char_length(F.regexp_replace("text", "[0-9]", ""))
    commas = n - F.char_length(F.regexp_replace("text", ",", ""))
    total = grade(n, 1000, 4000) + grade(lines, 5, 20) + grade(digits, 1, 10) + grade(commas, 10, 50) + grade(F.char_length(F.regexp_replace("text", "[ -~\n]", "")), 1, 100)
    band = F.when(F.col("msdi") <= 3, "low").when(F.col("msdi") <= 6, "middle").otherwise("high")
    return d.select("lang", total.cast("long").alias("msdi")).groupBy("lang", "msdi", band.alias("band")).agg(F.count("*").alias("n"))


SQL["q56_msdi_bands"] = """with v as (select lang, length(text) as n, len(string_split(text, chr(10))) as l, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) as d, length(text) - length(replace(text, ',', '')) as c,
 length(regexp_replace(text, '[ -~\\n]', '', 'g')) as o from documents where text is not null),
m as (select lang, (case when n >= 4000 then 2 when n >= 1000 then 1 else 0 end + case when l >= 20 then 2 when l >= 5 then 1 else 0 end + case when d >= 10 then 2 when d >= 1 then 1 else 0 end
 + case when c >= 50 then 2 when c >= 10 then 1 else 0 end + case when o >= 100 then 2 when o >= 1 then 1 else 0 end)::bigint as msdi from v)
select lang, msdi, case when msdi <= 3 then 'low' when msdi <= 6 then 'middle' else 'high' end as band, count(*) as n from m group by all"""


def q60_run_merge(spark, sf_dir):
    """Order runs: the primary one covers even customers and is valid where finished, the retry those with a high total."""
    o = table(spark, sf_dir, "orders")
    primary = o.filter(F.col("o_custkey") % 2 == 0).select("o_orderkey", (F.col("o_orderstatus") == "F").alias("valid"), F.col("o_totalprice").alias("score"))
    retry = o.filter("o_totalprice > 200000").select("o_orderkey", F.lit(True).alias("valid"), (F.col("o_totalprice") / 2).alias("score"))
    merged = runs.merge_runs(primary, retry, key="o_orderkey", valid="valid", value="score")
    return merged.select("o_orderkey", F.round("score", 3).alias("score"), "source")


SQL["q60_run_merge"] = """with p as (select o_orderkey, o_orderstatus = 'F' as valid, o_totalprice as score from orders where o_custkey % 2 = 0), r as (select o_orderkey, o_totalprice / 2 as score from orders where o_totalprice > 200000)
select coalesce(p.o_orderkey, r.o_orderkey) as o_orderkey, round(case when coalesce(valid, false) or r.o_orderkey is null then p.score else r.score end, 3) as score,
 case when coalesce(valid, false) or r.o_orderkey is null then 'primary' else 'retry' end as source from p full join r on p.o_orderkey = r.o_orderkey"""

def q109_reply_streams(spark, sf_dir):
    """Replies of conversations put together from event streams: a reply a conversation, a chunk a turn, some broken off."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    delta = F.when(F.col("role") == "assistant", F.struct(F.col("text").alias("content"), F.lit(None).cast("string").alias("reasoning_content"))).otherwise(F.struct(F.lit(None).cast("string").alias("content"), F.col("text").alias("reasoning_content")))
    finish = F.when((F.col("turn") == F.col("last")) & (F.col("conv_id") % 5 != 0), "stop")
    line = F.concat(F.lit("data: "), F.to_json(F.struct(F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("id"), F.array(F.struct(delta.alias("delta"), finish.alias("finish_reason"))).alias("choices"))))
    lines = turns.join(last, "conv_id").select(F.col("conv_id").alias("reply"), F.col("turn").alias("seq"), line.alias("line"))
    lines = lines.unionByName(last.select(F.col("conv_id").alias("reply"), (F.col("last") + 1).alias("seq"), F.when(F.col("conv_id") % 7 == 0, F.lit('data: {"error": {"code": "Arrearage", "message": "overdue"}}')).otherwise("data: [DONE]").alias("line")))
    made = replies.assemble(lines)
    return made.select("reply", F.sha2("content", 256).alias("content"), F.char_length("reasoning").cast("long").alias("n_reasoning"), "finish_reason", "id", "events", "outcome")


SQL["q109_reply_streams"] = """with t as (select conv_id, coalesce(turn, -1) as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations)
select conv_id as reply, sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as content, coalesce(sum(length(text)) filter (where role <> 'assistant'), 0)::bigint as n_reasoning,
 case when conv_id % 5 <> 0 then 'stop' end as finish_reason, 'r' || conv_id as id, count(*) as events, case when conv_id % 7 = 0 then 'account' when conv_id % 5 <> 0 then 'complete' else 'broken' end as outcome from t group by conv_id"""


def q110_retry_plan(spark, sf_dir):
    """What follows a failed attempt, by its code, message and number, and how long the waits are in all."""
    k = F.col("event_id")
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (k % len(values) + 1).cast("int"))
    attempts = table(spark, sf_dir, "events").select((k % 9 + 1).cast("int").alias("attempt"), pick((429, 503, 400, 404, 200)).alias("http"), pick(("busy", "InvalidParameter", "Arrearage", "", "x", "timed out", "y")).alias("message"), pick((None, "7", "soon", "-1")).alias("retry_after"))
    return replies.decisions(attempts).groupBy("kind", "action").agg(F.count("*").alias("n"), F.sum("pause").alias("pause"))


SQL["q110_retry_plan"] = """with e as (select event_id % 9 + 1 as attempt, ([429, 503, 400, 404, 200])[(event_id % 5 + 1)::int] as http, (['passing', 'request', 'account', '', '', 'passing', ''])[(event_id % 7 + 1)::int] as kind, event_id % 4 as w from events),
d as (select *, case when kind in ('account', 'request') then 'stop: ' || kind when http in (429, 503) or kind = 'passing' then case when attempt <= 6 then 'retry' else 'give up' end else 'fail' end as action from e)
select kind, action, count(*) as n, sum(case when action = 'retry' then case w when 1 then 7 when 3 then 0 else least(120.0, 5.0 * 2 ** (attempt - 1)) end end)::double as pause from d group by all"""

for _name, _f in list(globals().items()):
    if _name[:1] == "q" and _name[1:3].isdigit():
        QUERIES[_name] = _f
