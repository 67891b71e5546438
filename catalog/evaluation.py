"""Relevance labels and retrieval evaluation on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from catalog.data import (
    DENSE, TRIGRAM_RECALL, benchmark_queries, best, hybrid_corpus, norm, table, text_corpus, vector_corpus, vector_queries,
)
from catalog.retrieval import RERANKED, SWEEP, branches
from corpusloom import rules
from corpusloom.functions import text as T
from corpusloom.operators import evaluation as E
from corpusloom.operators import ranking as R
from corpusloom.operators import relevance as L
from corpusloom.operators import search as S
from corpusloom.plans.sweep import retrieval_sweep as whole_sweep
from corpusloom.session import materialize, scratch_path
from corpusloom.sources import tables as A

# --- text ----------------------------------------------------------------------------------------


@register(f"select doc_id, {norm('text')} as text from documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", T.normalize_text("text").alias("text"))


@register(f"with {TRIGRAM_RECALL} select chunk_id as doc_id, count(*)::int as n_grams, sum(length(gram))::bigint as n_chars from doc_grams group by 1")
def word_trigrams(spark, sf):
    grams = table(spark, sf, "documents", "doc_id", "text").select("doc_id", T.word_trigrams("text").alias("g"))
    chars = F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))
    return grams.select("doc_id", F.size("g").alias("n_grams"), chars.alias("n_chars"))


def _items(spark, sf):
    """Passages as evaluation items: keywords are their words of at least eleven characters."""
    text = F.col("text")
    return benchmark_queries(spark, sf).select(
        "query_id",
        text.alias("reference"),
        F.filter(F.split(text, r"\s+"), lambda w: F.char_length(w) >= 11).alias("keywords"),
        F.when(F.char_length(text) < 100, rules.NO_SOURCE).otherwise("some").alias("source_doc"),
    )


_ITEM_KEYWORDS = f"""item_kw as (select distinct query_id, keyword from (
  select item_id as query_id, {norm('kw')} as keyword from (select item_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) >= 11)) as kw from benchmark)) where keyword <> ''),
bodies as (select doc_id as chunk_id, {norm('text')} as body from documents),
kw_hits as (select k.keyword, b.chunk_id from (select distinct keyword from item_kw) k, bodies b
  where contains(b.body, k.keyword) and regexp_matches(b.body, '(^|[^a-z0-9])' || regexp_escape(k.keyword) || '($|[^a-z0-9])')),
kw_df as (select k.keyword, count(h.chunk_id) as df from (select distinct keyword from item_kw) k left join kw_hits h using (keyword) group by 1),
rare_hits as (
  select i.query_id, h.chunk_id from item_kw i join kw_hits h using (keyword) join kw_df d using (keyword)
  group by 1, 2 having count(*) = (select count(*) from item_kw x where x.query_id = i.query_id) and bool_or(d.df <= 3))"""

AUTO = f"""{TRIGRAM_RECALL}, {_ITEM_KEYWORDS},
labels_all as (
  select query_id, chunk_id from recalls where recall >= 0.5 union select query_id, chunk_id from rare_hits),
auto as (select l.query_id, l.chunk_id from labels_all l join benchmark b on b.item_id = l.query_id where length(b.text) >= 100)"""


@register(f"with {TRIGRAM_RECALL} select query_id, chunk_id, recall from recalls")
def trigram_recall(spark, sf):
    return L.shared_trigrams(_items(spark, sf), text_corpus(spark, sf))


_LANGUAGE_WORDS = {"en": "that", "es": "que", "de": "der", "fr": "des"}


@register(
    f"""select doc_id, regexp_matches({norm('text')}, '(^|[^a-z0-9])' || case lang when 'en' then 'that' when 'es' then 'que' when 'de' then 'der' else 'des' end || '($|[^a-z0-9])') as present
    from documents"""
)
def keyword_present(spark, sf):
    word = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in _LANGUAGE_WORDS.items()])
    docs = table(spark, sf, "documents", "doc_id", "text", "lang")
    return docs.select("doc_id", T.keyword_present(word, T.normalize_text("text")).alias("present"))


@register(f"with {_ITEM_KEYWORDS} select keyword, df from kw_df")
def keyword_df(spark, sf):
    return L.keyword_df(L.item_keywords(_items(spark, sf)), text_corpus(spark, sf))


@register(f"with {_ITEM_KEYWORDS} select query_id, chunk_id from rare_hits")
def rare_keyword_hit(spark, sf):
    return L.rare_keyword_hit(L.item_keywords(_items(spark, sf)), text_corpus(spark, sf))


@register(f"with {AUTO} select query_id, chunk_id from auto")
def auto_relevant(spark, sf):
    return L.auto_relevant(_items(spark, sf), text_corpus(spark, sf))


@register(
    f"""with {AUTO} select case when item_id in (select query_id from auto) then 'answerable' when length(text) < 100 then 'negative' else 'unlabeled' end as coverage,
      count(*) as n_items from benchmark group by 1"""
)
def label_coverage(spark, sf):
    items = _items(spark, sf)
    return L.label_coverage(items, L.auto_relevant(items, text_corpus(spark, sf)))


@register(f"with {AUTO} select query_id, count(*) as n_relevant from auto group by 1")
def relevant_counts(spark, sf):
    return L.relevant_counts(L.auto_relevant(_items(spark, sf), text_corpus(spark, sf)))


# --- metrics: vector search, a vector of the same class is relevant ---------------------------------

_JUDGED = f"""{DENSE}, {best('dense_all', 50, name='top50')},
judged as (select r.query_id, r.rank, (e.label = q.label)::int as rel from top50 r join embeddings e on e.vec_id = r.chunk_id join vec_q q on q.query_id = r.query_id),
totals as (select q.query_id, case when q.label = 0 then 0 else count(*) end as n from vec_q q join embeddings e on e.label = q.label group by q.query_id, q.label)"""


def _judged(spark, sf):
    """Ranked vectors with ``rel``, and the number of relevant ones (class 0 counts as having none)."""
    queries, corpus = vector_queries(spark, sf), vector_corpus(spark, sf)
    classes = queries.select("query_id", F.col("label").alias("wanted")).filter("wanted is not null")
    ranked = S.vector_search(queries, corpus, 50).join(corpus.select("chunk_id", "label"), "chunk_id").join(classes, "query_id")
    sizes = corpus.groupBy(F.col("label").alias("wanted")).agg(F.count(F.lit(1)).alias("n"))
    totals = classes.join(sizes, "wanted").select("query_id", F.when(F.col("wanted") == 0, 0).otherwise(F.col("n")).alias("n_relevant"))
    return ranked.select("query_id", "rank", (F.col("label") == F.col("wanted")).cast("int").alias("rel")), totals


_HITS = "sum(rel) filter (rank <= 10)"


@register(f"with {_JUDGED} select query_id, round({_HITS} / 10, 6) as precision from judged group by 1")
def precision_at_k(spark, sf):
    return E.precision_at_k(_judged(spark, sf)[0], 10)


@register(f"with {_JUDGED} select query_id, case when n > 0 then round({_HITS} / n, 6) end as recall from judged join totals using (query_id) group by query_id, n")
def recall_at_k(spark, sf):
    return E.recall_at_k(*_judged(spark, sf), 10)


@register(
    f"""with {_JUDGED}, p as (select query_id, n, {_HITS} / 10 as p, case when n > 0 then {_HITS} / n end as r from judged join totals using (query_id) group by query_id, n)
    select query_id, case when r is null then null when p + r = 0 then 0.0 else round(2 * p * r / (p + r), 6) end as f1 from p"""
)
def f1_at_k(spark, sf):
    return E.f1_at_k(*_judged(spark, sf), 10)


@register(f"with {_JUDGED} select query_id, max(case when rank <= 2 and rank > 0 then rel else 0 end)::double as hit from judged group by 1")
def hit_at_k(spark, sf):
    return E.hit_at_k(_judged(spark, sf)[0], 2)


@register(f"with {_JUDGED} select query_id, coalesce(round(1.0 / min(rank) filter (rel = 1), 6), 0.0)::double as reciprocal_rank from judged group by 1")
def reciprocal_rank(spark, sf):
    return E.reciprocal_rank(_judged(spark, sf)[0])


@register(f"with {_JUDGED} select query_id, round(sum(rel / log2(rank + 1)) filter (rank <= 10), 6) as dcg from judged group by 1")
def dcg_at_k(spark, sf):
    return E.dcg_at_k(_judged(spark, sf)[0], 10)


@register(
    f"""with {_JUDGED} select query_id, case when n > 0 then round(sum(rel / log2(rank + 1)) filter (rank <= 10) / (select sum(1 / log2(i + 1)) from range(1, 11) t(i) where i <= n), 6) end as ndcg
    from judged join totals using (query_id) group by query_id, n"""
)
def ndcg_at_k(spark, sf):
    return E.ndcg_at_k(*_judged(spark, sf), 10)


@register("select event_type, round(avg(case when value > 5 then value end), 6) as mean_value from events group by 1")
def mean_defined(spark, sf):
    """Small values count as undefined: half as null, half as NaN."""
    value = F.when(F.col("value") > 5, F.col("value")).when(F.col("value") > 2, F.lit(float("nan")))
    return E.mean_defined(table(spark, sf, "events").withColumn("value", value), "value", ["event_type"])


# --- sweep ---------------------------------------------------------------------------------------


def _grid_sql(ranked, by, ks, cut=False):
    """Metric grid over ``ranked`` (columns ``by``, query_id, chunk_id, rank) and ``auto``, per query."""
    reciprocal = "min(r.rank) filter (a.chunk_id is not null and r.rank <= k.k)" if cut else "min(r.rank) filter (a.chunk_id is not null)"
    keys = ", ".join(f"c.{b}" for b in by)
    on = " and ".join(f"r.{b} = c.{b}" for b in by)
    return f"""rel_n as (select query_id, count(*) as n from auto group by 1), ks as (select unnest({list(ks)})::int as k),
    cells as (
      select {keys}, k.k, t.query_id, t.n,
        count(a.chunk_id) filter (r.rank <= k.k) as h,
        coalesce(sum(1 / log2(r.rank + 1)) filter (r.rank <= k.k and a.chunk_id is not null), 0) as dcg,
        coalesce(1.0 / {reciprocal}, 0) as rr
      from combos c cross join ks k cross join rel_n t
      left join {ranked} r on {on} and r.query_id = t.query_id
      left join auto a on a.query_id = r.query_id and a.chunk_id = r.chunk_id
      group by {keys}, k.k, t.query_id, t.n),
    measured as (
      select *, h / k as precision, h / n as recall, case when h > 0 then 2 * (h / k) * (h / n) / ((h / k) + (h / n)) else 0 end as f1,
        (h > 0)::int as hit, dcg / (select sum(1 / log2(i + 1)) from range(1, 51) t(i) where i <= least(cells.n, cells.k)) as ndcg from cells)"""


_MEANS = """round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1, round(avg(hit), 6) as hit,
  round(avg(ndcg), 6) as ndcg, round(avg(rr), 6) as mrr, count(*) as n"""

_SWEEP_GRID = f"{SWEEP}, {AUTO}, combos as (select alpha from grid), {_grid_sql('swept', ['alpha'], rules.K_GRID)}"


def _weights(spark):
    return spark.createDataFrame([(float(a),) for a in rules.ALPHA_GRID], "alpha double")


def _splits(spark, sf):
    text = F.col("text")
    return benchmark_queries(spark, sf).select(
        "query_id",
        F.when(F.char_length(text) > 200, "long").otherwise("short").alias("favors"),
        F.when(F.contains(text, F.lit("\n")), "lines").alias("category"),
    )


def _grid(spark, sf, splits=False):
    ranked = R.alpha_sweep(*branches(spark, sf, 50))
    labels = materialize(L.auto_relevant(_items(spark, sf), text_corpus(spark, sf)), "labels")  # read twice
    return E.metric_grid(ranked, labels, grid=_weights(spark), splits=_splits(spark, sf) if splits else None)


@register(
    f"""with {_SWEEP_GRID}, s as (select m.*, case when length(b.text) > 200 then 'long' else 'short' end as favors,
      case when contains(b.text, chr(10)) then 'lines' else '?' end as category from measured m join benchmark b on b.item_id = m.query_id)
    select case when grouping(favors) = 0 then 'favors' when grouping(category) = 0 then 'category' else 'overall' end as split_by,
      case when grouping(favors) = 0 then favors when grouping(category) = 0 then category else 'all' end as split_value, alpha, k, {_MEANS}
    from s group by grouping sets ((alpha, k), (alpha, k, favors), (alpha, k, category))"""
)
def metric_grid(spark, sf):
    return _grid(spark, sf, splits=True)


@register(f"with {_SWEEP_GRID}, g as (select alpha, k, {_MEANS} from measured group by 1, 2) select arg_max(alpha, (recall, f1, -alpha)) as alpha from g where k = 10")
def pick_alpha(spark, sf):
    return E.pick_alpha(_grid(spark, sf))


@register(
    f"""with {_SWEEP_GRID}, g as (select alpha, k, {_MEANS} from measured group by 1, 2)
    select alpha, coalesce((select min(k) from g x where x.alpha = m.alpha and m.recall > 0 and x.recall >= 0.99 * m.recall), 50)::int as saturation_k from g m where k = 50"""
)
def saturation_k(spark, sf):
    return E.saturation_k(_grid(spark, sf))


@register(
    f"""with {_SWEEP_GRID}, g as (select alpha, k, {_MEANS} from measured group by 1, 2)
    select alpha, max(mrr) as mrr, max(n) as n, string_agg(k::varchar, ',' order by k) as ks, max(recall) as best_recall, arg_max(precision, -k) as first_precision from g group by alpha"""
)
def sweep_document(spark, sf):
    """The grid as nested documents, written as JSON and read back."""
    path = scratch_path(spark, "sweep")
    A.write_results(A.sweep_document(_grid(spark, sf)), path)
    each = "k int, precision double, recall double, f1 double, hit double, ndcg double"
    rows = spark.read.schema(f"alpha double, per_k array<struct<{each.replace(' ', ':').replace(',:', ',')}>>, mrr double, n bigint").json(path)
    return rows.select(
        "alpha", "mrr", "n",
        F.array_join(F.transform("per_k", lambda x: x["k"].cast("string")), ",").alias("ks"),
        F.array_max(F.transform("per_k", lambda x: x["recall"])).alias("best_recall"),
        F.element_at("per_k", 1)["precision"].alias("first_precision"),
    )


@register(f"with {_SWEEP_GRID} select alpha, k, {_MEANS} from measured group by 1, 2")
def retrieval_sweep(spark, sf):
    """The sweep as one plan, with its stages written to the shared folder."""
    queries, corpus = vector_queries(spark, sf), text_corpus(spark, sf)
    vectors = vector_corpus(spark, sf).select("chunk_id", "embedding")
    return whole_sweep(_items(spark, sf), queries, corpus.join(vectors, "chunk_id", "left"))["grid"]


# --- reranking -----------------------------------------------------------------------------------

_AUTO_ONLY = AUTO[len(TRIGRAM_RECALL) + 2 :]
_RERANK_50 = f"""{RERANKED.replace("<= 30", "<= 50")}"""
_FULL_RERANK = f"""{_RERANK_50}, {_AUTO_ONLY},
full_rerank as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from pair_scores)"""


def _hybrid_and_rerank(spark, sf):
    """Hybrid order of 50 candidates and their full rerank."""
    hybrid = S.hybrid_search(vector_queries(spark, sf), hybrid_corpus(spark, sf), 50)
    scores = S.trigram_scores(hybrid, benchmark_queries(spark, sf), text_corpus(spark, sf))
    return hybrid, materialize(R.rerank(hybrid, scores, 50), "reranked")


def _labels(spark, sf):
    return materialize(L.auto_relevant(_items(spark, sf), text_corpus(spark, sf)), "labels")


@register(
    f"""with {_FULL_RERANK}, combos as (select unnest(['rerank', 'baseline']) as variant),
    both_lists as (select 'rerank' as variant, query_id, chunk_id, rank from full_rerank union all select 'baseline', query_id, chunk_id, rank from fused),
    {_grid_sql('both_lists', ['variant'], range(1, 16))} select variant, k, {_MEANS} from measured group by 1, 2"""
)
def rerank_curve(spark, sf):
    hybrid, reranked = _hybrid_and_rerank(spark, sf)
    return E.rerank_curve(reranked, hybrid, _labels(spark, sf))


@register(
    f"""with {_FULL_RERANK}, combos as (select unnest(['rerank']) as variant),
    both_lists as (select 'rerank' as variant, query_id, chunk_id, rank from full_rerank),
    {_grid_sql('both_lists', ['variant'], range(1, 16))}, curve as (select k, {_MEANS} from measured group by 1)
    select arg_max(k, (f1, -k))::int as n from curve"""
)
def pick_n(spark, sf):
    """Number of reranked chunks with the best mean f1."""
    hybrid, reranked = _hybrid_and_rerank(spark, sf)
    return E.pick_n(E.rerank_curve(reranked, hybrid, _labels(spark, sf)))


_DEPTHS = f"""{_FULL_RERANK}, depths as (select unnest({list(rules.TOPK_GRID)})::int as top_k), combos as (select top_k, unnest(['rerank', 'baseline']) as variant from depths),
both_lists as (
  select d.top_k, 'rerank' as variant, f.query_id, f.chunk_id, row_number() over (partition by d.top_k, f.query_id order by r.rank) as rank
  from depths d join fused f on f.rank <= d.top_k join full_rerank r on r.query_id = f.query_id and r.chunk_id = f.chunk_id
  union all select d.top_k, 'baseline', query_id, chunk_id, rank from depths d join fused f on f.rank <= d.top_k),
{_grid_sql('both_lists', ['top_k', 'variant'], rules.TOPN_GRID, cut=True)}"""


@register(f"with {_DEPTHS} select top_k, variant, k as top_n, {_MEANS} from measured group by 1, 2, 3")
def depth_simulation(spark, sf):
    hybrid, reranked = _hybrid_and_rerank(spark, sf)
    return E.depth_simulation(hybrid, reranked, _labels(spark, sf))


@register(
    f"""with {_DEPTHS}, simulated as (select top_k, variant, k as top_n, {_MEANS} from measured group by 1, 2, 3)
    select arg_max(top_k, (f1, recall, -top_k))::int as top_k from simulated where variant = 'rerank' and top_n = {rules.TOPN_FOCUS}"""
)
def pick_depth(spark, sf):
    """Depth of the candidate list with the best mean f1 and recall at the focus length."""
    hybrid, reranked = _hybrid_and_rerank(spark, sf)
    return E.pick_depth(E.depth_simulation(hybrid, reranked, _labels(spark, sf)))



@register(f"with {_FULL_RERANK} select distinct query_id, true as match from fused")
def simulation_check(spark, sf):
    """A real rerank of the first 30 candidates against the restricted full one; they must agree."""
    hybrid, reranked = _hybrid_and_rerank(spark, sf)
    first = hybrid.filter("rank <= 30")
    real = R.rerank(first, S.trigram_scores(first, benchmark_queries(spark, sf), text_corpus(spark, sf)), 5)
    inside = reranked.join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    simulated = R.top_k(inside.select("query_id", "chunk_id", (-F.col("rank")).alias("score")), 5)
    return E.simulation_check(real, simulated)


@register(
    f"""with {_FULL_RERANK},
    inside as (select d.depth, r.query_id, r.chunk_id, row_number() over (partition by d.depth, r.query_id order by r.score desc, r.chunk_id) as pos
      from full_rerank r join fused f using (query_id, chunk_id), (values (8), (30)) d(depth) where f.rank <= d.depth),
    heads as (select query_id, depth, list(chunk_id order by pos) as ids from inside where pos <= 5 group by all)
    select a.query_id, a.ids = b.ids as match from heads a join heads b using (query_id) where a.depth = 8 and b.depth = 30"""
)
def simulation_check_depths(spark, sf):
    """A rerank of the first 8 candidates against one simulated for 30: they differ where a better one comes later."""
    hybrid, reranked = _hybrid_and_rerank(spark, sf)
    few, many = hybrid.filter("rank <= 8"), hybrid.filter("rank <= 30")
    real = R.rerank(few, S.trigram_scores(few, benchmark_queries(spark, sf), text_corpus(spark, sf)), 5)
    inside = reranked.join(many.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    return E.simulation_check(real, R.top_k(inside.select("query_id", "chunk_id", (-F.col("rank")).alias("score")), 5))


# --- agreement and score tables ------------------------------------------------------------------

_AGREE = """a as (select avg((quality = toxic)::int) as po, avg(quality) as pa, avg(toxic) as pb, count(*) as n from labels),
k as (select *, pa * pb + (1 - pa) * (1 - pb) as pe from a)"""


def _pairs(spark, sf):
    labels = table(spark, sf, "labels")
    return labels.select("doc_id", F.col("quality").alias("a"), F.col("toxic").alias("b"))


@register(f"with {_AGREE} select round(case when pe >= 1 then (po >= 1)::int else (po - pe) / (1 - pe) end, 6) as kappa from k")
def cohen_kappa(spark, sf):
    return E.cohen_kappa(_pairs(spark, sf))


@register(
    f"""with {_AGREE} select round(case when pe >= 1 then (po >= 1)::int else (po - pe) / (1 - pe) end, 6) as kappa, n as n_pairs, round(po, 6) as raw_agreement,
      round(pa, 6) as a_pos_rate, round(pb, 6) as b_pos_rate from k"""
)
def agreement_report(spark, sf):
    """Quality and toxicity labels as two judges, paired by document with a check for missing keys."""
    labels = table(spark, sf, "labels")
    pairs = E.label_pairs(
        labels.select("doc_id", F.col("quality").alias("a")), labels.select("doc_id", F.col("toxic").alias("b")), ["doc_id"]
    )
    return E.agreement_report(pairs)


@register(
    """select event_id, case event_type when 'purchase' then null when 'error' then true when 'view' then false
       else json_extract(props, '$.k')::int <> 0 end as label from events"""
)
def parse_label_json(spark, sf):
    """Event properties as judge replies: bare, inside prose, as a literal, with another field, and broken."""
    kind, props = F.col("event_type"), F.col("props")
    reply = (
        F.when(kind == "click", F.concat(F.lit("Sure:\n"), props, F.lit(" done")))
        .when(kind == "error", 'I say "K": true.')
        .when(kind == "view", F.replace(props, F.lit('"k"'), F.lit('"other"')))
        .when(kind == "purchase", "no idea")
        .otherwise(props)
    )
    return table(spark, sf, "events").select("event_id", E.parse_label_json(reply, "k").alias("label"))


@register(
    f"""with {SWEEP}, {AUTO}, pooled as (select distinct query_id, chunk_id from swept where rank <= 30)
    select p.query_id, p.chunk_id, (a.query_id is not null)::int as a, l.quality::int as b from pooled p join labels l on l.doc_id = p.chunk_id
    left join auto a on a.query_id = p.query_id and a.chunk_id = p.chunk_id where p.query_id not in (select item_id from benchmark where length(text) < 100)"""
)
def pool_pairs(spark, sf):
    """Automatic labels next to the documents' quality labels over the pool, without the short (negative) passages."""
    known = table(spark, sf, "documents", "doc_id").withColumnRenamed("doc_id", "chunk_id")
    pooled = R.pool(R.alpha_sweep(*branches(spark, sf, 50)), known)
    quality = table(spark, sf, "labels", "doc_id", "quality").select(F.col("doc_id").alias("chunk_id"), (F.col("quality") == 1).alias("relevant"))
    judged = pooled.select("query_id", "chunk_id").join(quality, "chunk_id")
    negative = benchmark_queries(spark, sf).where(F.char_length("text") < 100)
    return E.pool_pairs(pooled.select("query_id", "chunk_id"), _labels(spark, sf), judged, negative)


@register("select doc_id from documents where doc_id not in (select doc_id from labels)")
def pending_pairs(spark, sf):
    return E.pending_pairs(table(spark, sf, "documents", "doc_id"), table(spark, sf, "labels", "doc_id"), ["doc_id"])


@register("select doc_id, relevant from (select doc_id, quality = 1 as relevant from labels union all select doc_id, true from documents where lang = 'fr' and doc_id not in (select doc_id from labels)) where doc_id in (select vec_id from embeddings)")
def merge_judgments(spark, sf):
    """Labels as cache, French documents judged now (others failed), vector documents requested."""
    cache = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("relevant"))
    todo = E.pending_pairs(table(spark, sf, "documents", "doc_id", "lang"), cache, ["doc_id"])
    now = todo.select("doc_id", F.when(F.col("lang") == "fr", True).alias("relevant"))
    wanted = table(spark, sf, "embeddings", "vec_id").withColumnRenamed("vec_id", "doc_id")
    return E.merge_judgments(cache, now, wanted, ["doc_id"])[1]


_RUNS = "r as (select case when ts < '2024-01-16' then 'before' else 'after' end as run_id, event_type as metric, case when value > 1 then value end as score from events)"


def _summary(spark, sf):
    run = F.when(F.col("ts") < "2024-01-16", "before").otherwise("after")
    score = F.when(F.col("value") > 1, F.col("value")).otherwise(F.lit(float("nan")))
    return E.score_summary(table(spark, sf, "events").select(run.alias("run_id"), F.col("event_type").alias("metric"), score.alias("score")))


@register(f"with {_RUNS} select run_id, metric, round(avg(score), 6) as mean_score, count(score) as n_scores from r group by 1, 2")
def score_summary(spark, sf):
    return _summary(spark, sf)


@register(
    f"""with {_RUNS}, s as (select run_id, metric, round(avg(score), 6) as m from r group by 1, 2)
    select a.metric, a.m as score_a, b.m as score_b, round(b.m - a.m, 6) as delta from s a join s b on b.metric = a.metric and a.run_id = 'before' and b.run_id = 'after'"""
)
def run_compare(spark, sf):
    return E.run_compare(_summary(spark, sf), "before", "after")


@register(
    """select case when toxic = 1 then 'direct' else 'search' end as predicted, count(*) as n, round(count(*) / (select count(*) from labels), 6) as share,
      count(*) filter (toxic = 1 and quality = 1) as false_direct from labels group by 1"""
)
def route_tally(spark, sf):
    routes = table(spark, sf, "labels").select(
        F.when(F.col("toxic") == 1, "direct").otherwise("search").alias("predicted"), (F.col("quality") == 1).alias("needs_search")
    )
    return E.route_tally(routes)
