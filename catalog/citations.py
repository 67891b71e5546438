"""Citation checking and highlighting on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from catalog.data import TRIGRAM_RECALL, benchmark_queries, table, text_corpus
from corpusloom.functions import citations as C
from corpusloom.operators import citations as V
from corpusloom.operators import relevance as L

# Assistant turns as answers: sentences that end a line cite [9] (no such source), the others [2].
_ANSWERS = r"""
a as (select conv_id * 1000 + turn as answer_id, turn,
  regexp_replace(regexp_replace(text, '\.(\n|$)', ' [9].\1', 'g'), '\. ', ' [2]. ', 'g') as answer from conversations where role = 'assistant'),
pieces as (select answer_id, turn, answer, generate_subscripts(p, 1) - 1 as i, unnest(p) as piece from (
  select *, string_split(regexp_replace(regexp_replace(answer, '(\n+)', '\1@@', 'g'), '([.!?…] )', '\1@@', 'g'), '@@') as p from a)),
raw as (select *, regexp_extract(piece, '(\s+)$', 1) as delim, regexp_replace(piece, '\s+$', '') as text from pieces),
sentences as (select answer_id, turn, answer, row_number() over (partition by answer_id order by i) - 1 as id, text, delim,
  list_transform(regexp_extract_all(text, '\[(\d+)\]', 1), lambda x: x::int) as cited from raw where text <> '')"""


def _answers(spark, sf):
    turns = table(spark, sf, "conversations").filter("role = 'assistant'")
    text = F.regexp_replace(F.regexp_replace("text", r"\.(\n|\z)", " [9].$1"), r"\. ", " [2]. ")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "turn", text.alias("answer"))


@register(f"with {_ANSWERS} select answer_id, id::int as id, text, delim from sentences")
def split_sentences(spark, sf):
    return _answers(spark, sf).select("answer_id", F.explode_outer(C.split_sentences("answer")).alias("s")).select("answer_id", "s.id", "s.text", "s.delim")


@register(f"with {_ANSWERS} select answer_id, len(regexp_extract_all(answer, '\\[(\\d+)\\]'))::int as n, array_to_string(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), ',') as cited from a")
def cited_indices(spark, sf):
    found = C.cited_indices("answer")
    return _answers(spark, sf).select("answer_id", F.size(found).alias("n"), F.array_join(found.cast("array<string>"), ",").alias("cited"))


_BARE = r"regexp_replace(text, '\[\d+\]', '', 'g')"
_RECITED = rf"""case when regexp_matches({_BARE}, '[.!?…]+\s*$')
  then rtrim(regexp_replace({_BARE}, '[.!?…]+\s*$', '')) || ' [3][1]' || regexp_extract({_BARE}, '([.!?…]+)\s*$', 1)
  else rtrim({_BARE}) || ' [3][1]' end"""


@register(
    rf"""with {_ANSWERS} select answer_id, id::int as id, {_RECITED} as recited, rtrim(regexp_replace({_BARE}, '\s\s+', ' ', 'g')) as bare from sentences"""
)
def recite(spark, sf):
    rows = _answers(spark, sf).select("answer_id", F.explode_outer(C.split_sentences("answer")).alias("s"))
    return rows.select(
        "answer_id", "s.id", C.recite("s.text", F.array(F.lit(3), F.lit(1))).alias("recited"), C.recite("s.text", F.array().cast("array<int>")).alias("bare")
    )


# Verdict replies: per sentence number keep, recite or drop; turn 3 is broken JSON, turn 5 drops all,
# sentence 0 of turn 1 lacks a field, and every answer has a verdict for a sentence that does not exist.
_VERDICTS = """
v as (select *, turn = 3 as broken,
  case when turn = 5 then 'drop' when turn = 1 and id = 0 then null when id % 3 = 0 then 'keep' when id % 3 = 1 then 'recite' else 'drop' end as action,
  case when turn = 5 or id % 3 = 2 then []::int[] when id % 3 = 0 then [2] else [1, 3, 7] end as attributed,
  case when id % 3 = 0 then 'Quote A' when id % 3 = 1 then 'Quote B' else '' end as quote from sentences),
judged as (select *, coalesce(action, '') <> 'drop' as kept,
  case when action is not null and len(list_filter(attributed, lambda i: i <= 3)) > 0 then list_filter(attributed, lambda i: i <= 3) else list_filter(cited, lambda i: i <= 3) end as indices from v)"""


def _replies(spark, sf):
    answers = _answers(spark, sf)
    turn, ids = F.col("turn"), F.concat(F.transform(C.split_sentences("answer"), lambda s: s["id"]), F.array(F.lit(999)))
    numbers = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")

    def verdict(i):
        gone = (turn == 5) | (i % 3 == 2)
        return F.struct(
            i.alias("sentence_id"),
            F.when(gone, numbers()).when(i % 3 == 0, numbers(2)).otherwise(numbers(1, 3, 7)).alias("attributed_indices"),
            F.when(i % 3 == 0, " Quote A ").when(i % 3 == 1, "Quote B").otherwise("").alias("supporting_quote"),
            F.lit(True).alias("supported"),
            F.when((turn == 1) & (i == 0), F.lit(None).cast("boolean")).otherwise(~gone).alias("in_scope"),
            F.when(gone, "drop").when(i % 3 == 0, "keep").otherwise("recite").alias("action"),
        )

    body = F.to_json(F.struct(F.transform(ids, verdict).alias("verdicts")))
    reply = F.when(turn == 3, F.substring(body, 1, 30)).when(turn == 7, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), body))
    source = lambda n: F.struct(F.lit(n).alias("index"), F.concat(F.lit("doc"), F.lit(str(n))).alias("filename"))
    return answers.withColumn("verdict_json", reply).withColumn("sources", F.array(source(1), source(2), source(3)))


@register(
    f"with {_ANSWERS}, {_VERDICTS} select answer_id, id::int as sentence_id, action, len(attributed)::int as n_attributed, trim(quote) as quote from v where not broken and action is not null"
)
def parse_verdicts(spark, sf):
    rows = V.verdict_rows(V.parse_verdicts(_replies(spark, sf)))
    return rows.select("answer_id", "sentence_id", "action", F.size("attributed").alias("n_attributed"), F.trim("quote").alias("quote"))


_FIXED = _RECITED.replace("' [3][1]'", "' ' || array_to_string(list_transform(indices, lambda i: '[' || i || ']'), '')")
_REBUILT = rf"""{_ANSWERS}, {_VERDICTS},
fixed as (select *, case when action = 'recite' and len(indices) > 0 then {_FIXED} else text end as out from judged),
rebuilt as (select answer_id, any_value(turn) as turn, any_value(answer) as answer, any_value(broken) as broken,
  coalesce(trim(string_agg(out || delim, '' order by id) filter (kept), ' ' || chr(10)), '') as new_answer, count(*) filter (not kept) as dropped,
  coalesce(list_sort(list_distinct(flatten(list(indices) filter (kept)))), []) as cited from fixed group by answer_id)"""


@register(f"with {_REBUILT} select answer_id, new_answer, dropped::int as dropped_count from rebuilt where not broken")
def apply_verdicts(spark, sf):
    parsed = V.parse_verdicts(_replies(spark, sf)).filter(~F.col("verdict_error"))
    return V.apply_verdicts(parsed).select("answer_id", "new_answer", "dropped_count")


_SPANS = """spans as (select answer_id, idx, list_distinct(list(trim(quote)) filter (quote <> '' and action is not null)) as quotes
  from (select *, unnest(indices) as idx from judged where kept) group by 1, 2)"""


@register(
    f"with {_REBUILT}, {_SPANS} select answer_id, idx as index, coalesce(array_to_string(list_sort(quotes), '|'), '') as quotes from spans join rebuilt using (answer_id) where not broken"
)
def cited_sets(spark, sf):
    parsed = V.parse_verdicts(_replies(spark, sf)).filter(~F.col("verdict_error"))
    rows = V.cited_sets(V.apply_verdicts(parsed)).select("answer_id", F.explode_outer("cited_spans").alias("c")).filter("c is not null")
    return rows.select("answer_id", "c.index", F.array_join(F.array_sort("c.quotes"), "|").alias("quotes"))


# All answers: a broken reply has no verdicts, so its sentences stay as they are.
_WHOLE = _REBUILT.replace("case when turn = 5 then 'drop'", "case when turn = 3 then null when turn = 5 then 'drop'")


@register(f"with {_WHOLE} select answer_id, broken, new_answer, dropped::int as dropped_count from rebuilt")
def apply_verdicts_all(spark, sf):
    applied = V.apply_verdicts(V.parse_verdicts(_replies(spark, sf)))
    return applied.select("answer_id", F.col("verdict_error").alias("broken"), "new_answer", "dropped_count")


@register(f"with {_WHOLE}, {_SPANS} select answer_id, idx as index, coalesce(array_to_string(list_sort(quotes), '|'), '') as quotes from spans")
def cited_sets_all(spark, sf):
    cited = V.cited_sets(V.apply_verdicts(V.parse_verdicts(_replies(spark, sf))))
    rows = cited.select("answer_id", F.explode_outer("cited_spans").alias("c")).filter("c is not null")
    return rows.select("answer_id", "c.index", F.array_join(F.array_sort("c.quotes"), "|").alias("quotes"))


_FINAL = f"""{_REBUILT}, {_SPANS},
final as (select answer_id, turn, broken or new_answer = '' as failed, case when broken or new_answer = '' then answer else new_answer end as final_answer,
  case when broken or new_answer = '' then [1, 2, 3] else cited end as cited, case when broken or new_answer = '' then 0 else dropped end as dropped from rebuilt)"""


@register(f"with {_FINAL} select answer_id, not failed as ok, final_answer, array_to_string(cited, ',') as cited, dropped::int as dropped_count from final")
def verification_failsafe(spark, sf):
    checked = V.verification_failsafe(V.cited_sets(V.apply_verdicts(V.parse_verdicts(_replies(spark, sf)))))
    cited = F.array_join(F.col("cited_indices").cast("array<string>"), ",")
    return checked.select("answer_id", "ok", "final_answer", cited.alias("cited"), "dropped_count")


@register(
    f"""with {_FINAL}, s as (select *, unnest([1, 2, 3]) as index from final)
    select s.answer_id, s.index, 'doc' || s.index as filename, case when failed then null else coalesce(array_to_string(list_sort(p.quotes), '|'), '') end as cited_spans
    from s left join spans p on p.answer_id = s.answer_id and p.idx = s.index where failed or list_contains(cited, s.index)"""
)
def filter_sources(spark, sf):
    rows = V.verify_answers(_replies(spark, sf)).select("answer_id", F.explode_outer("sources").alias("s")).filter("s is not null")
    return rows.select("answer_id", "s.index", "s.filename", F.array_join(F.array_sort("s.cited_spans"), "|").alias("cited_spans"))


@register(f"with {_FINAL} select answer_id, (not failed and dropped > 0 and turn < 7) as revise from final")
def revision_decision(spark, sf):
    """Answers of turn 7 have used up their revision."""
    checked = V.verify_answers(_replies(spark, sf))
    used = F.when(F.col("turn") >= 7, 1).otherwise(0)
    return V.revision_decision(checked, used).select("answer_id", "revise")


@register(
    """with s as (select label as answer_id, vec_id as index, case when label < 5 then vec_id // 10 end as document_id, case when label < 8 then 'f' || (vec_id // 20) end as filename, 'ID' || (vec_id // 2) as vid from embeddings),
    k as (select *, coalesce('d' || document_id, filename, 'i' || index) as group_key, coalesce(filename, 'Tài liệu #' || document_id, 'Tài liệu') as label from s)
    select answer_id, group_key, min(index) as first_index, any_value(label) as label, arg_min('snippet ' || index, index) as snippet,
      count(distinct vid)::int as n_ids, count(*)::int as n_quotes from k group by 1, 2"""
)
def group_sources_by_document(spark, sf):
    """Vectors as sources: the class is the answer, blocks of ids are documents or files."""
    e = table(spark, sf, "embeddings", "vec_id", "label")
    tens = lambda n: F.floor(F.col("vec_id") / n)
    sources = e.select(
        F.col("label").alias("answer_id"),
        F.col("vec_id").alias("index"),
        F.when(F.col("label") < 5, tens(10)).alias("document_id"),
        F.when(F.col("label") < 8, F.concat(F.lit("f"), tens(20).cast("string"))).alias("filename"),
        F.concat(F.lit("snippet "), F.col("vec_id").cast("string")).alias("snippet"),
        F.concat(F.lit("ID"), tens(2).cast("string")).alias("vector_id"),
        F.array(F.lit("q")).alias("cited_spans"),
    )
    out = V.group_sources_by_document(sources)
    n_quotes = F.aggregate("quotes", F.lit(0), lambda a, q: a + F.size(q["quotes"]))
    return out.select("answer_id", "group_key", "first_index", "label", "snippet", F.size("cited_ids").alias("n_ids"), n_quotes.alias("n_quotes"))


@register(
    """with l as (select l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') as cited from lineitem group by 1, 2),
    p as (select *, row_number() over (partition by l_orderkey order by l_linenumber) as pos from l)
    select l_orderkey as document_id, count(*) as total, count(*) filter (cited) as n_cited, case when count(*) filter (cited) = 1 then min(pos) filter (cited) end as position from p group by 1"""
)
def citation_position(spark, sf):
    """Orders as documents, their line numbers as chunks, returned lines as cited."""
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    chunks = lines.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index")).distinct()
    cited = lines.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"))
    return V.citation_position(chunks, cited)


# --- highlighting --------------------------------------------------------------------------------

_PAIRS = rf"""{TRIGRAM_RECALL},
pairs as (select r.query_id, r.chunk_id, d.text as content, lower(replace(d.text, chr(10), ' ')) as body, lower(replace(trim(b.text), chr(10), ' ')) as quote
  from recalls r join documents d on d.doc_id = r.chunk_id join benchmark b on b.item_id = r.query_id where r.recall >= 0.5),
gaps as (select query_id, chunk_id, content, length(quote) as n, generate_subscripts(g, 1) as i, unnest(g) as gap from (select *, string_split(body, quote) as g from pairs)),
spans as (select query_id, chunk_id, content, n, i, sum(length(gap)) over (partition by query_id, chunk_id order by i) + (i - 1) * n as start,
  count(*) over (partition by query_id, chunk_id) as total from gaps)"""


def _quoted(spark, sf):
    """Passages as quotes of the documents that share at least half of their trigrams."""
    items = benchmark_queries(spark, sf).withColumnRenamed("text", "reference")
    pairs = L.shared_trigrams(items, text_corpus(spark, sf)).filter("recall >= 0.5").select("query_id", "chunk_id")
    texts = text_corpus(spark, sf).select("chunk_id", F.col("text").alias("content"))
    return pairs.join(texts, "chunk_id").join(items, "query_id")


@register(f"with {_PAIRS} select query_id, chunk_id, start::int as start, (start + n)::int as \"end\" from spans where i < total")
def quote_spans(spark, sf):
    return V.quote_spans(_quoted(spark, sf), ["query_id", "chunk_id"], quote="reference")


@register(
    f"""with {_PAIRS},
    marked as (select query_id, chunk_id, content, start as s, start + n as e from spans where i < total),
    cuts as (
      select query_id, chunk_id, content, coalesce(lag(e) over w, 0) as s, s as e, false as mark from marked window w as (partition by query_id, chunk_id order by s)
      union all select query_id, chunk_id, content, s, e, true from marked
      union all select query_id, chunk_id, any_value(content), max(e), length(any_value(content)), false from marked group by 1, 2
      union all select query_id, chunk_id, content, 0, length(content), true from pairs p where not exists (select 1 from marked m where m.query_id = p.query_id and m.chunk_id = p.chunk_id))
    select query_id, chunk_id, (row_number() over (partition by query_id, chunk_id order by s) - 1)::int as segment_no, substr(content, s::int + 1, (e - s)::int) as text, mark from cuts where e > s"""
)
def highlight_segments(spark, sf):
    chunks = _quoted(spark, sf).withColumn("quotes", F.array("reference"))
    return V.highlight_segments(chunks, ["query_id", "chunk_id"])


@register(
    """with r as (select l_suppkey, date_diff('day', date '1992-01-01', l_shipdate::date)::bigint as s, date_diff('day', date '1992-01-01', l_shipdate::date)::bigint + l_quantity::bigint as e from lineitem),
    o as (select *, max(e) over (partition by l_suppkey order by s, e rows between unbounded preceding and 1 preceding) as reach from r),
    i as (select *, sum((reach is null or s > reach)::int) over (partition by l_suppkey order by s, e rows unbounded preceding) as island from o)
    select l_suppkey, min(s) as start, max(e) as "end" from i group by l_suppkey, island"""
)
def merge_ranges(spark, sf):
    """Per supplier the merged spans of days from shipping on, as many days long as the quantity."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    ranges = table(spark, sf, "lineitem", "l_suppkey", "l_shipdate", "l_quantity").select(
        "l_suppkey", day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end")
    )
    return V.merge_ranges(ranges, ["l_suppkey"], width=1024)
