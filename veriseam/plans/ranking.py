"""Search, fusion and ranking queries over documents, benchmark items and vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics, rank
from ..session import cut_lineage
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")


def _bm25(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    docs, items = _inputs(spark, sf_dir)
    return rank.bm25(docs, items, did="doc_id", dtext=F.col("text"), qid="item_id", qtext=F.col("text"), k=k)


def _sparse(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    docs, items = _inputs(spark, sf_dir)
    return rank.sparse_dot(docs, items, did="doc_id", dtext=F.col("text"), qid="item_id", qtext=F.col("text"), k=k)


def _qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _inputs(spark, sf_dir)
    return metrics.contains_qrels(docs, items, did="doc_id", dtext=F.col("text"), qid="item_id", qtext=F.col("text"))


def _round(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


TOKENS = "list_transform(regexp_extract_all(coalesce({}, ''), '[A-Za-z0-9]+(?:[-.][A-Za-z0-9]+)*'), lambda t: lower(t))"
BM25 = f"""
words as (select doc_id, {TOKENS.format("text")} as ws from documents),
stats as (select count(*)::double as n, avg(len(ws)) as avgdl from words),
qt as (select item_id, term, count(*) as qtf from (select item_id, unnest({TOKENS.format("text")}) as term from benchmark) group by all),
tf as (select doc_id, term, count(*)::double as tf, any_value(dl) as dl
       from (select doc_id, len(ws) as dl, unnest(ws) as term from words) where term in (select term from qt) group by doc_id, term),
df as (select term, count(*) as df from tf group by term),
bm as (select item_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
       from tf join df using (term) join qt using (term), stats group by all),
bm25 as (select * from (select *, row_number() over (partition by item_id order by round(score, 9) desc, doc_id desc) as rank from bm where score > 0) where rank <= {{k}})"""
SPARSE = f"""
dw as (select doc_id, term, max(1 / (1 + floor((pos - 1) / 64))) as w
       from (select doc_id, unnest(ws) as term, generate_subscripts(ws, 1) as pos from (select doc_id, {TOKENS.format("text")} as ws from documents)) group by all),
qw as (select item_id, term, max(1 / (1 + floor((pos - 1) / 64))) as qw
       from (select item_id, unnest(ws) as term, generate_subscripts(ws, 1) as pos from (select item_id, {TOKENS.format("text")} as ws from benchmark)) group by all),
sp as (select item_id, doc_id, sum(w * qw) as score from dw join qw using (term) group by all),
sparse as (select * from (select *, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as rank from sp) where rank <= {{k}})"""
RRF = """
lists as (select item_id, doc_id, 1 / (60 + rank)::double as part, 0 as list, rank from bm25 union all
          select item_id, doc_id, 1 / (60 + rank)::double, 1, rank from sparse),
fu as (select item_id, doc_id, sum(part) as score, min((list, rank)) as first from lists group by all),
fused as (select * from (select item_id, doc_id, score, row_number() over (partition by item_id order by round(score, 12) desc, first) as rank from fu) where rank <= {k})"""
QRELS = """
qrels as (select item_id, doc_id from documents d join benchmark b on contains(d.text, b.text) where b.text <> '')"""


def q01_corpus_profile(spark, sf_dir):
    docs, _ = _inputs(spark, sf_dir)
    return docs.groupBy("lang", "source").agg(
        F.count("*").alias("n_docs"),
        F.round(F.avg("n_chars"), 6).alias("avg_chars"),
        F.median("n_chars").alias("median_chars"),
        F.count_distinct(F.md5("text")).alias("n_texts"),
    )


SQL["q01_corpus_profile"] = """select lang, source, count(*) as n_docs, round(avg(n_chars), 6) as avg_chars, median(n_chars)::double as median_chars,
 count(distinct md5(text)) as n_texts from documents group by lang, source"""


def q02_tokenize_df(spark, sf_dir):
    docs, _ = _inputs(spark, sf_dir)
    df = docs.select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.orderBy(F.col("df").desc(), "term").limit(50)


SQL["q02_tokenize_df"] = f"""select term, count(*) as df from (select unnest(list_distinct({TOKENS.format("text")})) as term from documents)
 group by term order by df desc, term limit 50"""


def q03_bm25_topk(spark, sf_dir):
    return _round(_bm25(spark, sf_dir))


SQL["q03_bm25_topk"] = f"with {BM25.format(k=10)} select item_id, doc_id, round(score, 6) as score, rank from bm25"


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v, v.filter(F.col("vec_id") % 100 == 0)


def cosine(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    return (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (d / np.linalg.norm(d, axis=1, keepdims=True)).T


def maxsim(q: np.ndarray, d: np.ndarray, width: int = 8) -> np.ndarray:
    """Late interaction: vectors are rows of patches; for each query patch the best dot product, added up."""
    asked, best = q.reshape(-1, width), None
    for at in range(0, d.shape[1], width):
        dots = asked @ d[:, at : at + width].T
        best = dots if best is None else np.maximum(best, dots, out=best)
    return best.reshape(len(q), -1, len(d)).sum(axis=1)


def hamming(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Minus the number of differing sign bits."""
    a, b = (np.packbits(x > 0, axis=1) for x in (q, d))
    return -np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2).astype(np.float64)


def q04_dense_topk(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return _round(rank.search_vectors(v, q, key="vec_id", vector="embedding", k=10, score=cosine))


PAIRS = "from embeddings q, embeddings d where q.vec_id % 100 = 0"
SQL["q04_dense_topk"] = f"""select query, item, round(score, 6) as score, rank from (
 select *, row_number() over (partition by query order by score desc, item) as rank from (
  select q.vec_id as query, d.vec_id as item, round(list_cosine_similarity(q.embedding::double[], d.embedding::double[]), 9) as score {PAIRS})) where rank <= 10"""


def q05_sparse_dot(spark, sf_dir):
    return _round(_sparse(spark, sf_dir))


SQL["q05_sparse_dot"] = f"with {SPARSE.format(k=10)} select item_id, doc_id, round(score, 6) as score, rank from sparse"


def _fused(spark, sf_dir, k=10):
    return rank.rrf([_bm25(spark, sf_dir), _sparse(spark, sf_dir)], qid="item_id", item="doc_id", k=k)


def q06_rrf_fusion(spark, sf_dir):
    return _round(_fused(spark, sf_dir))


SQL["q06_rrf_fusion"] = f"with {BM25.format(k=10)}, {SPARSE.format(k=10)}, {RRF.format(k=10)} select item_id, doc_id, round(score, 6) as score, rank from fused"

# Priors of content types.
TYPES = {"Standard": 1.2, "Guidance": 1.0, "Option": 0.9, "Support": 0.7}


def _typed(docs: DataFrame) -> DataFrame:
    names = F.array(*(F.lit(t) for t in TYPES))
    return docs.select("doc_id", "lang", "source", F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int")).alias("content_type"))


def _with_priors(spark, sf_dir, ranked: DataFrame) -> DataFrame:
    """Ranked rows with the payload of their documents, and how near they are to the best one."""
    typed = _typed(_inputs(spark, sf_dir)[0])
    hits = ranked.join(typed, "doc_id")
    best = hits.filter("rank = 1").select("item_id", F.col("lang").alias("best_lang"), F.col("source").alias("best_source"))
    hits = hits.join(best, "item_id")
    hier = F.when(F.col("lang") == F.col("best_lang"), 0.6).otherwise(0.0) + F.when(F.col("source") == F.col("best_source"), 0.6).otherwise(0.0)
    near = F.when(F.col("rank") == 1, 1.0).when(F.col("source") == F.col("best_source"), 0.5).otherwise(F.lit(1) / 3)
    return hits.select("item_id", "doc_id", "score", "rank", "content_type", hier.alias("hier"), near.alias("near"))


PRIORS = """
typed as (select doc_id, lang, source, (['Standard', 'Guidance', 'Option', 'Support'])[(doc_id % 4 + 1)::int] as content_type from documents),
best as (select item_id, lang as best_lang, source as best_source from {ranked} join typed using (doc_id) where rank = 1),
hits as (select item_id, doc_id, score, rank, content_type,
  (case when lang = best_lang then 0.6 else 0 end + case when source = best_source then 0.6 else 0 end)::double as hier,
  (case when rank = 1 then 1.0 when source = best_source then 0.5 else 1.0::double / 3 end)::double as near
  from {ranked} join typed using (doc_id) join best using (item_id))"""


def q07_rescore_priors(spark, sf_dir):
    """Fused score + 0.4 nearness + 0.3 (type weight - 1) + 0.2 hierarchy; 6 are kept."""
    hits = _with_priors(spark, sf_dir, _fused(spark, sf_dir))
    w = F.create_map(*(F.lit(x) for t in TYPES.items() for x in t))[F.col("content_type")]
    scored = hits.withColumn("final", F.col("score") + 0.4 * F.col("near") + 0.3 * (w - 1) + 0.2 * F.col("hier")).withColumnRenamed("rank", "old_rank")
    kept = rank.top(scored, ["item_id"], [F.round("final", 9).desc(), F.col("old_rank").asc()], 6)
    return _round(kept.select("item_id", "doc_id", "final", "rank"))


SQL["q07_rescore_priors"] = f"""with {BM25.format(k=10)}, {SPARSE.format(k=10)}, {RRF.format(k=10)}, {PRIORS.format(ranked="fused")},
scored as (select item_id, doc_id, rank as old_rank, score + 0.4::double * near + 0.3::double * (case content_type when 'Standard' then 1.2 when 'Guidance' then 1.0 when 'Option' then 0.9 else 0.7 end::double - 1) + 0.2::double * hier as final from hits)
select item_id, doc_id, round(final, 6) as final, rank from (select *, row_number() over (partition by item_id order by round(final, 9) desc, old_rank) as rank from scored) where rank <= 6"""


def q08_rescore_normalised(spark, sf_dir):
    """BM25 over its best + 0.4 nearness + 0.2 capped hierarchy + 0.3 rule strength; ties by document descending."""
    hits = _with_priors(spark, sf_dir, _bm25(spark, sf_dir))
    rule = F.create_map(*(F.lit(x) for t in {"Standard": 1.0, "Guidance": 2 / 3, "Option": 1 / 3, "Support": 0.0}.items() for x in t))[F.col("content_type")]
    base = F.col("score") / F.max("score").over(W.partitionBy("item_id"))
    scored = hits.withColumn("final", base + 0.4 * F.col("near") + 0.2 * F.least(F.lit(1.0), F.col("hier") / 1.2) + 0.3 * rule).drop("rank")
    kept = rank.top(scored, ["item_id"], [F.round("final", 9).desc(), F.col("doc_id").desc()], 6)
    return _round(kept.select("item_id", "doc_id", "final", "rank"))


SQL["q08_rescore_normalised"] = f"""with {BM25.format(k=10)}, {PRIORS.format(ranked="bm25")},
scored as (select item_id, doc_id, score / max(score) over (partition by item_id) + 0.4::double * near + 0.2::double * least(1.0::double, hier / 1.2::double)
 + 0.3::double * (case content_type when 'Standard' then 1::double when 'Guidance' then 2::double / 3 when 'Option' then 1::double / 3 else 0 end) as final from hits)
select item_id, doc_id, round(final, 6) as final, rank from (select *, row_number() over (partition by item_id order by round(final, 9) desc, doc_id desc) as rank from scored) where rank <= 6"""


def q09_maxsim(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return _round(rank.search_vectors(v, q, key="vec_id", vector="embedding", k=10, score=maxsim))


SQL["q09_maxsim"] = f"""with patches as (select vec_id, p, embedding[p * 8 + 1 : p * 8 + 8]::double[] as x from embeddings, range(8) r(p)),
best as (select q.vec_id as query, d.vec_id as item, q.p, max(list_dot_product(q.x, d.x)) as s from patches q, patches d where q.vec_id % 100 = 0 group by all),
scored as (select query, item, round(sum(s), 9) as score from best group by all)
select query, item, round(score, 6) as score, rank from (select *, row_number() over (partition by query order by score desc, item) as rank from scored) where rank <= 10"""


def q10_binary_hamming(spark, sf_dir):
    """50 by sign bits, of which the 10 best by cosine stay."""
    v, q = _vectors(spark, sf_dir)
    coarse = rank.search_vectors(v, q, key="vec_id", vector="embedding", k=50, score=hamming)
    side = lambda n: v.select(F.col("vec_id").alias(n), F.col("embedding").cast("array<double>").alias(f"{n}_v"))
    both = coarse.select("query", "item", (-F.col("score")).cast("long").alias("bits")).join(side("item"), "item").join(side("query"), "query")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    exact = both.withColumn("score", F.round(dot("query_v", "item_v") / F.sqrt(dot("query_v", "query_v") * dot("item_v", "item_v")), 9))
    return _round(rank.top(exact.select("query", "item", "bits", "score"), ["query"], [F.col("score").desc(), F.col("item").asc()], 10))


SQL["q10_binary_hamming"] = f"""with signs as (select vec_id, embedding, list_transform(embedding, lambda x: x > 0) as b from embeddings),
coarse as (select * from (select *, row_number() over (partition by query order by bits, item) as r from (
 select q.vec_id as query, d.vec_id as item, list_sum(list_transform(list_zip(q.b, d.b), lambda z: (z[1] <> z[2])::int))::bigint as bits,
  round(list_cosine_similarity(q.embedding::double[], d.embedding::double[]), 9) as score from signs q, signs d where q.vec_id % 100 = 0)) where r <= 50)
select query, item, bits, round(score, 6) as score, rank from (select *, row_number() over (partition by query order by score desc, item) as rank from coarse) where rank <= 10"""


def q11_tfidf_sections(spark, sf_dir):
    docs, items = _inputs(spark, sf_dir)
    return _round(rank.tfidf_sections(docs, items, section="source", dtext=F.col("text"), qid="item_id", qtext=F.col("text"), k=3))


SQL["q11_tfidf_sections"] = f"""with tf as (select source, term, count(*) as tf from (select source, unnest({TOKENS.format("text")}) as term from documents where source is not null) group by all),
n as (select count(distinct source)::double as n from documents),
idf as (select term, ln((1 + any_value(n)) / (1 + count(*))) + 1 as idf from tf, n group by term having count(*) >= 2),
d as (select source, term, (1 + ln(tf)) * idf as w from tf join idf using (term)),
dn as (select source, sqrt(sum(w * w)) as norm from d group by source),
qt as (select item_id, term, count(*) as qtf from (select item_id, unnest({TOKENS.format("text")}) as term from benchmark) group by all),
q as (select item_id, term, (1 + ln(qtf)) * idf as qw from qt join idf using (term)),
qn as (select item_id, sqrt(sum(qw * qw)) as qnorm from q group by item_id),
sc as (select item_id, source, sum(w * qw) as dot from d join q using (term) group by all)
select item_id, source, round(score, 6) as score, rank from (
 select item_id, source, dot / (norm * qnorm) as score, row_number() over (partition by item_id order by round(dot / (norm * qnorm), 9) desc, source) as rank
 from sc join dn using (source) join qn using (item_id)) where rank <= 3"""


def q12_ranking_metrics(spark, sf_dir):
    items = _inputs(spark, sf_dir)[1]
    return _round(metrics.at_rank(_bm25(spark, sf_dir), _qrels(spark, sf_dir), items, qid="item_id", item="doc_id", k=10))


METRICS = """
n as (select item_id, count(*) as n_relevant from qrels group by item_id),
h as (select item_id, count(*) as n_hit, min(rank) as first_rank, sum(1 / log2(rank + 1)) as dcg from {ranked} semi join qrels using (item_id, doc_id) group by item_id),
m as (select item_id, coalesce(n_relevant, 0)::bigint as n_relevant,
  case when n_relevant > 0 then (case when n_hit > 0 then 1.0 else 0.0 end)::double end as hit_at_k,
  case when n_relevant > 0 then coalesce(n_hit / n_relevant, 0)::double end as recall_set_at_k,
  case when n_relevant > 0 then coalesce(1 / first_rank, 0)::double end as mrr_at_k,
  case when n_relevant > 0 then coalesce(dcg / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda i: 1 / log2(i + 1))), 0)::double end as ndcg_at_k
  from benchmark left join n using (item_id) left join h using (item_id))"""
SQL["q12_ranking_metrics"] = f"""with {BM25.format(k=10)}, {QRELS}, {METRICS.format(ranked="bm25")}
select item_id, n_relevant, hit_at_k, round(recall_set_at_k, 6) as recall_set_at_k, round(mrr_at_k, 6) as mrr_at_k, round(ndcg_at_k, 6) as ndcg_at_k from m"""


def q13_ranking_metrics_hit_style(spark, sf_dir):
    items = _inputs(spark, sf_dir)[1]
    return _round(metrics.hit_style(_bm25(spark, sf_dir), _qrels(spark, sf_dir), items, qid="item_id", item="doc_id"))


SQL["q13_ranking_metrics_hit_style"] = f"""with {BM25.format(k=10)}, {QRELS},
j as (select b.item_id, b.rank, (q.doc_id is not null)::int::double as rel from bm25 b left join qrels q on b.item_id = q.item_id and b.doc_id = q.doc_id where b.rank <= 6),
s as (select item_id, max(case when rank <= 5 then rel else 0 end) as hit, sum(rel / log2(rank + 1)) as dcg, sum(rel) as n, avg(rel) as precision from j group by item_id),
f as (select distinct item_id from qrels)
select b.item_id, case when f.item_id is not null then coalesce(hit, 0) end::double as hit_at_5,
 case when f.item_id is not null then round(coalesce(case when n > 0 then dcg / list_sum(list_transform(range(1, n::bigint + 1), lambda i: 1 / log2(i + 1))) end, 0), 6) end::double as ndcg_retrieved_at_6,
 case when f.item_id is not null then round(coalesce(precision, 0), 6) end::double as context_precision_at_6
from benchmark b left join f on f.item_id = b.item_id left join s on s.item_id = b.item_id"""


def q14_method_summary(spark, sf_dir):
    """Macro means over questions with relevant documents, micro recall, and how many questions can't be judged."""
    # each list is used more than once and has few rows, so it is found once
    items, qrels, lexical, sparse = _inputs(spark, sf_dir)[1], cut_lineage(_qrels(spark, sf_dir)), cut_lineage(_bm25(spark, sf_dir)), cut_lineage(_sparse(spark, sf_dir))
    out = None
    for name, ranked in (("bm25", lexical), ("rrf", rank.rrf([lexical, sparse], qid="item_id", item="doc_id", k=10)), ("sparse", sparse)):
        m = metrics.at_rank(ranked, qrels, items, qid="item_id", item="doc_id", k=10)
        row = m.agg(
            F.lit(name).alias("method"),
            F.count_if(F.col("n_relevant") > 0).alias("n_judged"),
            F.count_if(F.col("n_relevant") == 0).alias("n_unjudged"),
            F.avg("hit_at_k").alias("hit"),
            F.avg("recall_set_at_k").alias("macro_recall"),
            (F.sum(F.col("recall_set_at_k") * F.col("n_relevant")) / F.sum("n_relevant")).alias("micro_recall"),
            F.avg("mrr_at_k").alias("mrr"),
            F.avg("ndcg_at_k").alias("ndcg"),
        )
        out = row if out is None else out.unionByName(row)
    return _round(out)


_SUMMARY = "select '{m}' as method, count(*) filter (where n_relevant > 0) as n_judged, count(*) filter (where n_relevant = 0) as n_unjudged, round(avg(hit_at_k), 6) as hit, round(avg(recall_set_at_k), 6) as macro_recall, round(sum(recall_set_at_k * n_relevant) / sum(n_relevant), 6) as micro_recall, round(avg(mrr_at_k), 6) as mrr, round(avg(ndcg_at_k), 6) as ndcg from (with {c} select * from m)"
SQL["q14_method_summary"] = f"with {BM25.format(k=10)}, {SPARSE.format(k=10)}, {RRF.format(k=10)}, {QRELS} " + " union all ".join(_SUMMARY.format(m=m, c=METRICS.format(ranked=r)) for m, r in (("bm25", "bm25"), ("rrf", "fused"), ("sparse", "sparse")))


def q18_take_turns(spark, sf_dir):
    return rank.take_turns(_bm25(spark, sf_dir), _sparse(spark, sf_dir), qid="item_id", item="doc_id", want=8)


_FREE = "list_filter({xs}, lambda v: not list_contains(taken, v))[1]"
SQL["q18_take_turns"] = f"""with recursive {BM25.format(k=10)}, {SPARSE.format(k=10)},
ids as (select item_id from bm25 union select item_id from sparse), la as (select item_id, list(doc_id order by rank) as xs from bm25 group by 1), lb as (select item_id, list(doc_id order by rank) as xs from sparse group by 1),
turns as (select ids.item_id, 0 as t, coalesce(la.xs, []) as a, coalesce(lb.xs, []) as b, []::bigint[] as taken from ids left join la using (item_id) left join lb using (item_id)
 union all select item_id, t + 1, a, b, case when x is null then taken else list_append(taken, x) end
 from (select *, case when t % 2 = 0 then coalesce({_FREE.format(xs="a")}, {_FREE.format(xs="b")}) else coalesce({_FREE.format(xs="b")}, {_FREE.format(xs="a")}) end as x from turns where t < 8))
select item_id, unnest(taken) as doc_id, generate_subscripts(taken, 1)::int as rank from turns where t = 8"""


def q19_round_robin_budget(spark, sf_dir):
    """Documents of each language from all sources in turns, the longest first, 60 a language."""
    docs = _inputs(spark, sf_dir)[0].select("lang", "source", "doc_id", "n_chars")
    kept = rank.round_robin(docs, by=["lang"], group="source", order=[F.col("n_chars").desc(), F.col("doc_id")], group_order=[F.col("source")], room=60)
    return kept.select("lang", "source", "doc_id", F.col("depth").cast("long").alias("depth"), F.col("turn").cast("long").alias("turn"))


SQL["q19_round_robin_budget"] = """with d as (select lang, source, doc_id, row_number() over (partition by lang, source order by n_chars desc, doc_id) as depth from documents)
select * from (select *, row_number() over (partition by lang order by depth, source) as turn from d) where turn <= 60"""


def q20_reserved_slots(spark, sf_dir):
    kept = rank.reserve_slots(_bm25(spark, sf_dir, 20), _sparse(spark, sf_dir, 20), qid="item_id", item="doc_id", k=20, slots=5)
    return _round(kept)


SQL["q20_reserved_slots"] = f"""with {BM25.format(k=20)}, {SPARSE.format(k=20)},
e as (select item_id, doc_id, 1 as side, row_number() over (partition by item_id order by rank, doc_id) as place from sparse anti join bm25 using (item_id, doc_id)),
b as (select item_id, doc_id, 0 as side, rank as place from bm25 union all select * from e),
c as (select *, count(*) filter (where side = 0) over (partition by item_id) as n0, count(*) filter (where side = 1) over (partition by item_id) as n1 from b),
s as (select *, least(n0, 20 - least(5, 10, n1)) as share0 from c)
select item_id, doc_id, side::bigint as side, row_number() over (partition by item_id order by side, place) as rank
from s where place <= case when side = 0 then share0 else least(n1, 20 - share0) end"""


def q53_figure_filter(spark, sf_dir):
    """Hits whose words overlap with the question's; those without overlap go only where some hit has one. Named ones stay."""
    docs, items = _inputs(spark, sf_dir)
    hits = _bm25(spark, sf_dir).select("item_id", "doc_id", "rank")
    head = docs.select("doc_id", F.array_distinct(X.content_words(X.tokens(F.col("text")))).alias("d"))
    q = items.select("item_id", F.array_distinct(X.content_words(X.tokens(F.col("text")))).alias("q"))
    both = hits.join(head, "doc_id").join(q, "item_id")
    scored = both.select("item_id", "doc_id", "rank", F.size(F.array_intersect("d", "q")).alias("overlap"), F.size("d").alias("n"))
    kept = scored.withColumn("most", F.max("overlap").over(W.partitionBy("item_id"))).filter((F.col("overlap") > 0) | (F.col("most") == 0) | (F.col("rank") == 1))
    kept = kept.withColumn("place", F.row_number().over(W.partitionBy("item_id").orderBy((F.col("rank") != 1).cast("int"), F.round(F.col("overlap") / F.greatest("n", F.lit(1)), 9).desc(), "rank")))
    return kept.select("item_id", "doc_id", F.col("overlap").cast("long").alias("overlap"), F.col("place").cast("long").alias("place"))


_WORDS = ", ".join(f"'{w}'" for w in X.FUNCTION_WORDS)
_CONTENT = f"list_filter({TOKENS}, lambda w: len(w) > 1 and w not in ({_WORDS}))"
_FIRSTS = "list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: list_position(ws, z[1]) = z[2]), lambda z: z[1])"
SQL["q53_figure_filter"] = f"""with {BM25.format(k=10)},
dw as (select doc_id, list_distinct(ws) as d from (select doc_id, {_CONTENT.format("text")} as ws from documents where doc_id in (select doc_id from bm25))),
qq as (select item_id, list_distinct({_CONTENT.format("text")}) as q from benchmark),
s as (select item_id, doc_id, rank, len(list_intersect(d, q)) as overlap, len(d) as n from bm25 join dw using (doc_id) join qq using (item_id)),
k as (select *, max(overlap) over (partition by item_id) as most from s)
select item_id, doc_id, overlap::bigint as overlap, row_number() over (partition by item_id order by (rank <> 1)::int, round(overlap / greatest(n, 1), 9) desc, rank) as place
from k where overlap > 0 or most = 0 or rank = 1"""

for _name, _f in list(globals().items()):
    if _name[:1] == "q" and _name[1:3].isdigit():
        QUERIES[_name] = _f
