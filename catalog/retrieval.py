"""Search, fusion and reranking on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from catalog.data import (
    BM25, DENSE, TRIGRAM_RECALL, benchmark_queries, best, fuse, hybrid_corpus, hybrid_ctes, table, text_corpus,
    vector_corpus, vector_queries,
)
from corpusloom import rules
from corpusloom.operators import ranking as R
from corpusloom.operators import search as S
from corpusloom.operators import vector_index as I
from corpusloom.operators.keyword_index import build_keyword_index
from corpusloom.plans.ask import prepare_contexts as ask_contexts
from corpusloom.session import materialize, scratch_path


@register(f"with {BM25}, {best('bm25_all', 30)} select query_id, chunk_id, score, rank::int as rank from ranked")
def bm25_search(spark, sf):
    return S.bm25_search(benchmark_queries(spark, sf), text_corpus(spark, sf), 30)


@register(f"with {DENSE}, {best('dense_all', 3)} select query_id, chunk_id, score, rank::int as rank from ranked")
def vector_search(spark, sf):
    return S.vector_search(vector_queries(spark, sf), vector_corpus(spark, sf))


@register()
def lsh_candidates(spark, sf):
    """Approximate; its recall against the exact search is tested."""
    return S.lsh_candidates(vector_queries(spark, sf), vector_corpus(spark, sf), k=10)


def _indexed(spark, sf):
    return I.build_vector_index(vector_corpus(spark, sf), scratch_path(spark, "vector-index"))


@register(f"with {DENSE}, {best('dense_all', 10)} select query_id, chunk_id, score, rank::int as rank from ranked")
def ivf_search(spark, sf):
    """Exact top 10 through the inverted file: probed lists for a floor, then every block whose bound reaches it."""
    corpus = vector_corpus(spark, sf)
    return I.search_vector_index(vector_queries(spark, sf), _indexed(spark, sf), corpus, 10, exact=True)


@register("select count(*) as n_vectors, count(distinct vec_id) as n_ids, true as within_bound, true as codes_whole from embeddings where embedding is not null")
def ivf_lists(spark, sf):
    """The written lists hold every vector once, in bounded blocks with one code for each component."""
    index = _indexed(spark, sf)
    n = F.size("ids")
    ids = index.blocks().select(n.alias("n"), F.explode("ids").alias("id"), (F.octet_length("codes") == n * index.dim).alias("whole"))
    return ids.agg(
        F.count("*").alias("n_vectors"), F.countDistinct("id").alias("n_ids"), (F.max("n") <= I.BLOCK_ROWS).alias("within_bound"), F.bool_and("whole").alias("codes_whole")
    )


# --- filters -------------------------------------------------------------------------------------

_SLOTS = """slots as (select b.item_id as query_id, d.lang, case when length(b.text) > 200 then d.source end as source
  from benchmark b left join documents d on d.doc_id = b.item_id)"""


def _slotted(spark, sf, missing=False):
    """Passages with the language, and for long ones the source, of the document with their id as slots."""
    slots = table(spark, sf, "documents", "doc_id", "lang", "source").withColumnRenamed("doc_id", "query_id")
    source = F.when(F.char_length("text") > 200, F.concat("source", F.lit("-gone")) if missing else F.col("source"))
    return vector_queries(spark, sf).join(slots, "query_id", "left").withColumn("source", source)


@register(
    f"""with {_SLOTS}, {BM25}, {DENSE},
    s_all as (select a.query_id, a.chunk_id, a.score from bm25_all a join slots s on s.query_id = a.query_id
      and (s.lang is null or s.lang = a.lang) and (s.source is null or s.source = a.source)),
    d_all as (select a.query_id, a.chunk_id, a.score from dense_all a join documents d on d.doc_id = a.chunk_id join slots s on s.query_id = a.query_id
      and (s.lang is null or s.lang = d.lang) and (s.source is null or s.source = d.source)),
    {best('d_all', 30, name='dense')}, {best('s_all', 30, name='sparse')}, {fuse('0.6', 30)}
    select query_id, chunk_id, score, rank::int as rank from fused"""
)
def metadata_filter(spark, sf):
    return S.hybrid_search(_slotted(spark, sf), hybrid_corpus(spark, sf), 30, filters=("lang", "source"))


@register(
    f"""with {_SLOTS}, {BM25},
    filtered as (select a.query_id, a.chunk_id, a.score from bm25_all a join slots s on s.query_id = a.query_id
      and s.source is null and (s.lang is null or s.lang = a.lang)),
    unanswered as (select query_id from slots where (lang is not null or source is not null) and query_id not in (select query_id from filtered)),
    s_all as (select *, false as fallback from filtered
      union all select query_id, chunk_id, score, true from bm25_all where query_id in (select query_id from unanswered)),
    {best('s_all', 10)} select query_id, chunk_id, score, rank::int as rank, fallback from ranked"""
)
def filter_fallback(spark, sf):
    """Long passages ask for a source that does not exist and fall back to an open search."""
    slots = ("lang", "source")
    index = build_keyword_index(text_corpus(spark, sf), scratch_path(spark, "postings"), slots)
    return S.filter_fallback(_slotted(spark, sf, missing=True), lambda q: S.bm25_search(q, index, 10, filters=slots), slots)


@register(
    f"""with {_SLOTS}, {BM25},
    s_all as (select a.query_id, a.chunk_id, a.score from bm25_all a join slots s on s.query_id = a.query_id
      and s.source is null and (s.lang is null or s.lang = a.lang)),
    {best('s_all', 10)}, n as (select query_id, count(*) as n from ranked group by 1)
    select b.item_id as query_id, case when n is null then '{rules.NO_CONTEXT_ANSWER}' end as answer, coalesce(n, 0) as n_sources
    from benchmark b left join n on n.query_id = b.item_id"""
)
def no_context_gate(spark, sf):
    queries = _slotted(spark, sf, missing=True)
    hits = S.bm25_search(queries, text_corpus(spark, sf), 10, filters=("lang", "source"))
    return S.no_context_gate(queries, hits)


# --- fusion --------------------------------------------------------------------------------------


def branches(spark, sf, k):
    queries, corpus = vector_queries(spark, sf), hybrid_corpus(spark, sf)
    return S.vector_search(queries, corpus, k), S.bm25_search(queries, text_corpus(spark, sf), k)


@register(f"with {hybrid_ctes(30)}, {fuse('0.6', 30)} select query_id, chunk_id, score, rank::int as rank from fused")
def weighted_rrf(spark, sf):
    return R.weighted_rrf(*branches(spark, sf, 30))


@register(
    """select source, doc_id, n_chars, rank::int as rank from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents)
    where rank <= 3"""
)
def top_k(spark, sf):
    docs = table(spark, sf, "documents", "source", "doc_id", "n_chars")
    return R.top_k(docs, 3, by=("source",), score="n_chars", ties=("doc_id",))


ALPHAS = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::double[]"

SWEEP = f"""{hybrid_ctes(50)}, grid as (select unnest({ALPHAS}) as alpha),
swept_all as (
  select alpha, query_id, chunk_id, round(sum(w), 9) as score from (
    select alpha, query_id, chunk_id, alpha / (60 + rank) as w from dense, grid
    union all select alpha, query_id, chunk_id, (1 - alpha) / (60 + rank) from sparse, grid) where w > 0
  group by all),
{best('swept_all', 50, by='alpha, query_id', name='swept')}"""


@register(f"with {SWEEP} select alpha, query_id, chunk_id, score, rank::int as rank from swept")
def alpha_sweep(spark, sf):
    return R.alpha_sweep(*branches(spark, sf, 50))


@register(f"with {SWEEP} select distinct query_id, chunk_id from swept where rank <= 30 and chunk_id in (select doc_id from labels)")
def pool(spark, sf):
    """The pool over all weights, restricted to labelled documents."""
    known = table(spark, sf, "labels", "doc_id").withColumnRenamed("doc_id", "chunk_id")
    return R.pool(R.alpha_sweep(*branches(spark, sf, 50)), known)


@register(f"with {SWEEP} select distinct query_id, chunk_id from swept where rank <= 30 and chunk_id in (select doc_id from documents)")
def pool_documents(spark, sf):
    """The pool over all weights and all documents."""
    corpus = table(spark, sf, "documents", "doc_id").withColumnRenamed("doc_id", "chunk_id")
    return R.pool(R.alpha_sweep(*branches(spark, sf, 50)), corpus)


# --- reranking and context -----------------------------------------------------------------------

RERANKED = f"""{hybrid_ctes(30)}, {fuse('0.6', 30)}, {TRIGRAM_RECALL},
pair_scores as (select f.query_id, f.chunk_id, coalesce(r.recall, 0) as score from fused f left join recalls r using (query_id, chunk_id)),
{best('pair_scores', 6, name='reranked')}"""


def reranked(spark, sf, k=30, top_n=6):
    found = S.hybrid_search(vector_queries(spark, sf), hybrid_corpus(spark, sf), k)
    scores = S.trigram_scores(found, benchmark_queries(spark, sf), text_corpus(spark, sf))
    return R.rerank(found, scores, top_n)


@register(f"with {RERANKED} select query_id, chunk_id, score, rank::int as rank from reranked")
def rerank(spark, sf):
    return reranked(spark, sf)


_SOURCES = f"""{RERANKED}, sources as (
  select r.query_id, r.rank::int as source_index, r.chunk_id, r.chunk_id as document_id, case when d.lang <> 'en' then d.source end as filename,
    case when d.lang <> 'en' then d.source else 'tài liệu #' || r.chunk_id end as label, left(trim(d.text), 500) as snippet, r.score, trim(d.text) as text
  from reranked r join documents d on d.doc_id = r.chunk_id)"""


def _sources(spark, sf):
    corpus = text_corpus(spark, sf).select(
        "chunk_id", F.col("chunk_id").alias("document_id"), F.when(F.col("lang") != "en", F.col("source")).otherwise("").alias("filename"), "text"
    )
    return S.source_list(materialize(reranked(spark, sf), "reranked"), corpus)


@register(f"with {_SOURCES} select query_id, source_index, chunk_id, document_id, filename, label, snippet, score from sources")
def source_list(spark, sf):
    return _sources(spark, sf).drop("text")


@register(
    f"""with {_SOURCES} select query_id, string_agg('[' || source_index || '] (nguồn: ' || label || ')' || chr(10) || text, chr(10) || chr(10) order by source_index) as context
    from sources group by query_id"""
)
def context_block(spark, sf):
    return S.context_block(_sources(spark, sf))


@register(
    f"""with {RERANKED} select b.item_id as query_id, count(r.chunk_id) as n_sources, null::varchar as answer,
      coalesce(string_agg('[' || r.rank || '] (nguồn: tài liệu #' || r.chunk_id || ')' || chr(10) || trim(d.text), chr(10) || chr(10) order by r.rank), '') as context
    from benchmark b left join reranked r on r.query_id = b.item_id left join documents d on d.doc_id = r.chunk_id group by 1"""
)
def prepare_contexts(spark, sf):
    """The whole batch answer preparation: hybrid search, rerank, numbered context."""
    corpus = hybrid_corpus(spark, sf).withColumn("document_id", F.col("chunk_id"))
    return ask_contexts(vector_queries(spark, sf), corpus)


@register(
    f"""with {hybrid_ctes(6)},
    l as (select query_id, 0 as list_no, rank as pos, chunk_id, score from dense
      union all select query_id, 1, rank, chunk_id, case when rank <= 3 then score / 100 end from sparse),
    firsts as (select query_id, chunk_id, arg_min(list_no, (list_no, pos)) as list_no, arg_min(pos, (list_no, pos)) as pos,
      arg_min(coalesce(score, -1), (list_no, pos)) as s from l group by 1, 2),
    r as (select *, row_number() over (partition by query_id order by case when s = -1 then 0 else s end desc, list_no, pos) as rank from firsts)
    select query_id, chunk_id, rank::int as rank, list_no, round(case when s <> -1 then s end, 9) as score from r where rank <= 10"""
)
def merge_subqueries(spark, sf):
    """Vector and keyword lists of a passage as two sub-query lists; the end of the second has no scores."""
    dense, sparse = branches(spark, sf, 6)
    as_list = lambda df, no, score: df.select("query_id", F.lit(no).alias("list_no"), F.col("rank").alias("pos"), "chunk_id", score.alias("score"))
    weak = F.when(F.col("rank") <= 3, F.col("score") / 100)
    merged = R.merge_subqueries(as_list(dense, 0, F.col("score")).unionByName(as_list(sparse, 1, weak)))
    return merged.select("query_id", "chunk_id", "rank", "list_no", F.round("score", 9).alias("score"))


@register(
    """with p as (select conv_id * 1000 + turn as query_id, text, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') as parts
      from conversations where role = 'user'),
    c as (select query_id, case when len(parts) > 0 then parts[1:3] else [text] end as parts from p)
    select query_id, generate_subscripts(parts, 1)::int - 1 as sub_no, unnest(parts) as subquery from c"""
)
def explode_subqueries(spark, sf):
    """User turns with their sentences as proposed sub-queries."""
    turns = table(spark, sf, "conversations").filter("role = 'user'")
    plans = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text", F.split("text", r"\.").alias("parts"))
    return S.explode_subqueries(plans)


_REFINED_BM25 = BM25.replace("from benchmark)", "from final_queries)")


@register(
    f"""with final_queries as (select item_id, case when length(text) > 150 and string_split(text, '.')[1] not in ('', text) then trim(string_split(text, '.')[1]) else text end as text,
      case when length(text) > 150 and string_split(text, '.')[1] not in ('', text) then 2 else 1 end as rounds from benchmark),
    {_REFINED_BM25}, {best('bm25_all', 5)}
    select r.query_id, chunk_id, score, rank::int as rank, q.rounds from ranked r join final_queries q on q.item_id = r.query_id"""
)
def refine_rounds(spark, sf):
    """Long passages are graded insufficient and searched again with their first sentence."""
    queries = benchmark_queries(spark, sf)
    index = build_keyword_index(text_corpus(spark, sf), scratch_path(spark, "postings"))
    grades = queries.select(
        "query_id", F.lit(1).alias("round"), (F.char_length("text") <= 150).alias("sufficient"), F.get(F.split("text", r"\."), F.lit(0)).alias("refined_query")
    )
    return S.refine_rounds(queries, lambda q: S.bm25_search(q, index, 5), grades)
