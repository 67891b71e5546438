"""Sources, blocks and chunks on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from catalog.data import CHUNKED, LINES, PATHS, PIECES, SEGMENTS, lined_documents, table
from corpusloom.functions import markup, text as T
from corpusloom.operators import blocks as B
from corpusloom.session import scratch_path
from corpusloom.sources import tables as A
from corpusloom.sources.snapshots import Snapshot

SEP = " > "


def _joined(column):
    return F.array_join(column, SEP)


# --- sources and sinks ---------------------------------------------------------------------------


@register("select event_id, ts, user_id from events")
def read_table(spark, sf):
    return A.read_table(spark, sf, "events", ["event_id", "ts", "user_id"], newest_by="ts")


def _parsed_pages(spark, sf):
    """Documents as parser output: ten lines per page, odd pages without a number, some empty items."""
    line = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(
            F.floor(i / 10).cast("int").alias("p"),
            F.when(i % 7 == 6, "image").otherwise("text").alias("type"),
            F.lit(None).cast("int").alias("lvl"),
            x.alias("value"),
            F.when(i % 3 == 0, "").otherwise(F.concat(F.lit(" "), x)).alias("md"),
            F.lit(None).cast(B.GRID).alias("rows"),
        ),
    )
    docs = table(spark, sf, "documents", "doc_id", "text").withColumn("l", line)
    last = F.array_max(F.transform("l", lambda x: x["p"]))
    pages = F.transform(
        F.sequence(F.lit(0), last),
        lambda p: F.struct(
            F.when(p % 2 == 0, p + 1).otherwise(0).alias("page"),
            F.element_at("l", 1)["value"].alias("md"),
            F.transform(
                F.filter("l", lambda x: x["p"] == p),
                lambda x: F.struct(*[x[f].alias(f) for f in ("type", "lvl", "value", "md", "rows")]),
            ).alias("items"),
        ),
    )
    return docs.select("doc_id", pages.alias("pages"))


_PAGE_LINES = """
with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i,
                  unnest(string_split(text, chr(10))) as line from documents)"""


@register(
    _PAGE_LINES
    + " select doc_id, (i // 10 + 1)::int as page_number, count(*) as n_items, sum(length(line))::bigint as n_chars from l group by 1, 2"
)
def read_parsed_pages(spark, sf):
    """Parser output written as JSON to the shared folder and read back with the explicit schema."""
    path = scratch_path(spark, "parsed-pages")
    _parsed_pages(spark, sf).write.json(path)
    docs = A.read_parsed_pages(spark, path, json_lines=True, keys="doc_id bigint")
    page = docs.select("doc_id", F.posexplode_outer("pages").alias("i", "p"))
    n = F.aggregate("p.items", F.lit(0), lambda a, x: a + F.char_length(x["value"]))
    return page.select(
        "doc_id",
        F.coalesce(F.nullif("p.page", F.lit(0)), F.col("i") + 1).alias("page_number"),
        F.size("p.items").cast("long").alias("n_items"),
        n.cast("long").alias("n_chars"),
    )


@register(
    """select item_id::varchar as id, text as question, case when length(text) > 200 then text else '' end as ground_truth,
       len(string_split(text, ' '))::int as n_keywords from benchmark"""
)
def read_eval_set(spark, sf):
    path = scratch_path(spark, "eval-set.jsonl")
    table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("id"),
        F.col("text").alias("question"),
        F.when(F.char_length("text") > 200, F.col("text")).otherwise("").alias("ground_truth"),
        F.split("text", " ").alias("expected_keywords"),
    ).write.json(path)
    rows = A.read_eval_set(spark, path, json_lines=True)
    return rows.select("id", "question", "ground_truth", F.size("expected_keywords").alias("n_keywords"))


@register("select event_type as metric, count(*) as n, round(avg(value), 6) as mean_value from events group by 1")
def write_results(spark, sf):
    path = scratch_path(spark, "results")
    rows = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value")
    )
    A.write_results(rows, path, ["metric"])
    return spark.read.schema("n bigint, mean_value double, metric string").json(path)


@register(
    """with incoming as (select d.doc_id + 1000000000 as doc_id, d.source, d.text from documents d join labels l using (doc_id) where l.quality = 0)
    select doc_id, source as filename, length(text) as n from documents where source not in (select source from incoming)
    union all select doc_id, source, length(text) from incoming"""
)
def replace_by_name(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "source", "text").withColumnRenamed("source", "filename")
    poor = table(spark, sf, "labels", "doc_id", "quality").filter("quality = 0").select("doc_id")
    incoming = docs.join(poor, "doc_id", "left_semi").withColumn("doc_id", F.col("doc_id") + 1000000000)
    return A.replace_by_name(docs, incoming).select("doc_id", "filename", F.char_length("text").cast("long").alias("n"))


@register(
    """with doomed as (select doc_id from labels where toxic = 1)
    select 'documents' as part, count(*) as n from documents where doc_id not in (select doc_id from doomed)
    union all select 'chunks', count(*) from embeddings where vec_id not in (select doc_id from doomed)
    union all select 'vectors', count(*) from embeddings where vec_id in (select doc_id from doomed) and label <> 0
    union all select 'deleted', count(*) from documents where doc_id in (select doc_id from doomed)"""
)
def delete_cascade(spark, sf):
    docs = table(spark, sf, "documents", "doc_id").withColumnRenamed("doc_id", "document_id")
    chunks = table(spark, sf, "embeddings", "vec_id", "label").select(
        F.col("vec_id").alias("document_id"), F.when(F.col("label") != 0, F.col("vec_id")).alias("vector_id")
    )
    doomed = table(spark, sf, "labels", "doc_id", "toxic").filter("toxic = 1").select(F.col("doc_id").alias("document_id"))
    out = A.delete_cascade(docs, chunks, doomed)
    count = lambda name: out[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    deleted = out["deleted"].select(F.lit("deleted").alias("part"), F.col("deleted").alias("n"))
    return count("documents").unionByName(count("chunks")).unionByName(count("vectors")).unionByName(deleted)


@register(
    CHUNKED
    + """ select doc_id as document_id, chunk_index::int as chunk_index, content, context,
      case when len(path) > 0 then to_json(path)::varchar end as heading_path, null::varchar as table_data,
      'text' as chunk_type from chunk_rows"""
)
def append_chunks(spark, sf):
    stored = A.append_chunks(B.build_chunks(lined_documents(spark, sf), filename="source"))
    return stored.select("document_id", "chunk_index", "content", "context", "heading_path", "table_data", "chunk_type")


# --- blocks --------------------------------------------------------------------------------------


@register(
    _PAGE_LINES
    + r""", items as (select doc_id, i, i // 10 + 1 as page_number, trim(line) as value from l where i % 7 <> 6 and regexp_matches(line, '\S'))
    select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as pos, page_number::int as page_number, 'text' as type, value, value as md
    from items"""
)
def normalize_blocks(spark, sf):
    docs = B.normalize_blocks(_parsed_pages(spark, sf))
    return docs.select("doc_id", F.posexplode_outer("blocks").alias("pos", "b")).select(
        "doc_id", "pos", "b.page_number", "b.type", "b.value", "b.md"
    )


@register(
    r"""with stripped as (
      select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', '', 'g'),
        '(?s)<!--.*?-->', '', 'g'), '(?is)<(nav|footer|head)\b.*?</(nav|footer|head)>', '', 'g') as body from pages),
    marked as (
      select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '\s+', ' ', 'g'),
        '<h1[^>]*>', '@@1@@', 'g'), '</?(h1|p|div|article|body|html|ul|li)( [^>]*)?>', '@@', 'g'), '<br[^>]*>', chr(10), 'g') as m from stripped),
    parts as (select page_id, generate_subscripts(string_split(m, '@@'), 1) as i, unnest(string_split(m, '@@')) as part from marked),
    flagged as (select page_id, i, part, lag(part) over (partition by page_id order by i) as prev from parts),
    cleaned as (
      select page_id, i, prev = '1' as heading,
        array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(
          regexp_replace(part, '<[^>]*>', '', 'g'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), chr(10)),
          lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as value
      from flagged where part <> '1' or prev is null or prev = '1')
    select page_id, (row_number() over (partition by page_id order by i) - 1)::int as pos,
      case when heading then 'heading' else 'text' end as type, case when heading then 1 end::int as level, value,
      case when heading then '# ' || value else value end as md
    from cleaned where value <> ''"""
)
def html_to_blocks(spark, sf):
    pages = table(spark, sf, "pages", "page_id", "html")
    return T.unnest(pages, ["page_id"], markup.html_blocks("html"), "pos", "b").select(
        "page_id", "pos", "b.type", "b.level", "b.value", "b.md"
    )


@register(
    f"with {LINES}, {PATHS} select doc_id, pos::int as pos, md, level::int as level, array_to_string(path, ' > ') as heading_path from paths"
)
def heading_path(spark, sf):
    return B.heading_path(lined_documents(spark, sf)).select("doc_id", "pos", "md", "level", _joined("heading_path").alias("heading_path"))


@register(
    f"with recursive {LINES}, {PATHS}, {SEGMENTS}"
    + """ select doc_id, seg::int as segment_index, max(seg_size)::int as n_blocks, sum(n)::int as tokens,
      array_to_string(any_value(seg_path), ' > ') as heading_path, 1 as page_number from seg_blocks group by doc_id, seg"""
)
def segment_blocks(spark, sf):
    return B.segment_blocks(lined_documents(spark, sf)).select(
        "doc_id", "segment_index", F.size("blocks").alias("n_blocks"), "tokens", _joined("heading_path").alias("heading_path"), "page_number"
    )


@register(
    f"with recursive {LINES}, {PATHS}, {SEGMENTS}, {PIECES}"
    + " select doc_id, seg::int as segment_index, piece::int as piece_index, content from pieces"
)
def merge_blocks(spark, sf):
    merged = B.merge_blocks(B.segment_blocks(lined_documents(spark, sf)))
    return merged.select("doc_id", "segment_index", "piece_index", "content")


@register(
    """with t as (
      select o_orderkey as doc_id, 0 as table_index, o_orderpriority as path, '| status | priority |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderstatus || ' | ' || o_orderpriority || ' |' as content,
        o_orderstatus as first_cell from orders
      union all
      select o_orderkey, 1, o_orderpriority || ' > ' || o_orderstatus, '| customer | status |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_custkey || ' | ' || o_orderstatus || ' |',
        o_custkey::varchar from orders)
    select doc_id, table_index, 'table' as chunk_type, true as has_table, (table_index + 1)::int as page_number, content,
      'Thuộc: ' || path || '. Dữ liệu dạng bảng.' as context, 2 as n_rows, first_cell from t"""
)
def table_chunks(spark, sf):
    """Each order as a parsed document: a heading, a table, text, a lower heading, a table, and one without content."""

    def grid(*heads_and_cells):
        half = len(heads_and_cells) // 2
        return F.array(*(F.array(*heads_and_cells[i : i + half]) for i in (0, half)))

    def md(first, second, a, b):
        return F.concat(F.lit(f"| {first} | {second} |\n| --- | --- |\n| "), a, F.lit(" | "), b, F.lit(" |"))

    def block(kind, value, rows=None, level=None, page=1):
        return F.struct(
            F.lit(page).alias("page_number"), F.lit(kind).alias("type"), F.lit(level).cast("int").alias("level"),
            value.alias("value"), value.alias("md"), (F.lit(None).cast(B.GRID) if rows is None else rows).alias("rows"),
        ).cast(markup.BLOCK)

    status, priority, customer = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey").cast("string")
    docs = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey").select(
        F.col("o_orderkey").alias("doc_id"),
        F.array(
            block("heading", priority),
            block("table", md("status", "priority", status, priority), grid(F.lit("status"), F.lit("priority"), status, priority)),
            block("text", F.concat(F.lit("Customer "), customer)),
            block("heading", status, level=2, page=2),
            block("table", F.lit(" "), page=2),
            block("table", md("customer", "status", customer, status), grid(F.lit("customer"), F.lit("status"), customer, status), page=2),
        ).alias("blocks"),
    )
    return B.table_chunks(docs).select(
        "doc_id", "table_index", "chunk_type", "has_table", "page_number", "content", "context",
        F.size("grid").alias("n_rows"), F.get(F.get("grid", F.lit(1)), F.lit(0)).alias("first_cell"),
    )


@register(
    """select doc_id, case when len(regexp_extract_all(replace(text, ' | ', chr(10) || '- '), '(?m)^- ')) >= 2
      then 'list' else 'text' end as chunk_type from documents"""
)
def chunk_type(spark, sf):
    bulleted = F.replace("text", F.lit(" | "), F.lit("\n- "))
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", T.chunk_type(bulleted).alias("chunk_type"))


@register(
    """select doc_id, 'Trích từ ' || source || '. Thuộc: ' || lang || ' > ' || source || '.' ||
      case when lang = 'en' then ' Dữ liệu dạng bảng.' else '' end as context from documents"""
)
def heading_context(spark, sf):
    extra = F.when(F.col("lang") == "en", "Dữ liệu dạng bảng.")
    return table(spark, sf, "documents", "doc_id", "lang", "source").select(
        "doc_id", T.heading_context(F.array("lang", "source"), F.lit(None).cast("string"), "source", extra).alias("context")
    )


@register("select doc_id, case when lang = 'en' then text else source || chr(10) || chr(10) || text end as text from documents")
def contextual_text(spark, sf):
    context = F.when(F.col("lang") != "en", F.col("source"))
    return table(spark, sf, "documents", "doc_id", "text", "lang", "source").select(
        "doc_id", T.contextual_text(context, "text").alias("text")
    )


@register(r"select doc_id, len(regexp_extract_all(text, '\S+'))::int as tokens from documents")
def count_tokens(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", T.count_tokens("text").alias("tokens"))


_UUID5 = """
  left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1))::int, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""


@register(
    f"""with h as (select doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('document:' || doc_id)) as h from documents)
    select doc_id, {_UUID5} as document_ref from h"""
)
def stable_ids(spark, sf):
    return table(spark, sf, "documents", "doc_id").select("doc_id", T.document_uuid("doc_id").alias("document_ref"))


# --- proposed groups -----------------------------------------------------------------------------


def _pairs(n, shift=0):
    """Blocks 0..n-1 in groups of two."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int")),
        lambda g: F.struct(
            F.sequence((g * 2 + shift).cast("int"), F.least(g * 2 + 1, n - 1).cast("int") + shift).alias("blocks"),
            F.array(F.lit(" "), F.lit("Group")).alias("heading_path"),
            F.lit("").alias("context"),
            F.when(g == 0, "mixed").otherwise("other").alias("chunk_type"),
        ).cast(B.GROUP),
    )


@register(
    f"""with {LINES}, s as (select doc_id, any_value(lang) as lang, count(*) as n from blocks group by doc_id)
    select doc_id, n::int as n_blocks,
      case lang when 'fr' then 'block out of range'
                when 'de' then case when n <= 2 then 'no groups' else 'blocks not covered' end
                when 'es' then 'block in several groups' end as problem,
      lang = 'en' as valid
    from s"""
)
def validate_partition(spark, sf):
    """Pairs of blocks per document; three languages get a broken proposal each."""
    n = F.size("blocks")
    pairs = _pairs(n)
    docs = lined_documents(spark, sf).select("doc_id", "lang", n.alias("n_blocks"), pairs.alias("pairs"), _pairs(n, 1).alias("late"))
    groups = (
        F.when(F.col("lang") == "en", F.col("pairs"))
        .when(F.col("lang") == "fr", F.col("late"))
        .when(F.col("lang") == "de", F.filter("pairs", lambda _, i: i > 0))
        .otherwise(F.concat("pairs", F.slice("pairs", 1, 1)))
    )
    return B.validate_partition(docs.withColumn("groups", groups)).select("doc_id", "n_blocks", "problem", "valid")


_ASSEMBLED = (
    f"with recursive {LINES}, {PATHS}, {SEGMENTS}, {PIECES}"
    + """, seg_stats as (select doc_id, seg, any_value(lang) as lang, any_value(seg_path) as path, count(*) > 1 and sum(n) > 400 as gate from seg_blocks group by doc_id, seg),
    grouped as (
      select b.doc_id, b.seg, b.spot // 2 as piece, string_agg(b.md, chr(10) || chr(10) order by b.spot) as content
      from seg_blocks b join seg_stats s using (doc_id, seg) where s.gate and s.lang in ('en', 'de') group by all)
    select doc_id, seg::int as segment_index, piece::int as piece_index, true as accepted, content, 'Group' as heading_path,
      'Thuộc: Group.' as context, case when piece = 0 then 'mixed' else 'text' end as chunk_type from grouped
    union all
    select p.doc_id, p.seg::int, p.piece::int, false, p.content, array_to_string(p.path, ' > '),
      case when len(p.path) > 0 then 'Thuộc: ' || array_to_string(p.path, ' > ') || '.' else '' end, 'text'
    from pieces p join seg_stats s using (doc_id, seg) where not (s.gate and s.lang in ('en', 'de'))"""
)


@register(_ASSEMBLED)
def assemble_groups(spark, sf):
    """Proposals are valid in two languages, and not covering or absent in the others."""
    docs = lined_documents(spark, sf)
    segments = B.segment_blocks(docs)
    n = F.size("blocks")
    langs = table(spark, sf, "documents", "doc_id", "lang").filter(F.col("lang") != "es")
    proposals = segments.join(langs, "doc_id").select(
        "doc_id", "segment_index",
        F.when(F.col("lang").isin("en", "de"), _pairs(n)).otherwise(F.filter(_pairs(n), lambda _, i: i > 0)).alias("groups"),
    )
    out = B.assemble_groups(segments, proposals)
    return out.select(
        "doc_id", "segment_index", "piece_index", "accepted", "content", _joined("heading_path").alias("heading_path"), "context", "chunk_type"
    )


@register("select p_partkey, case when p_size > 25 then p_brand || ' > ' || p_type when p_size > 10 then p_brand end as path from part")
def clean_path_list(spark, sf):
    raw = (
        F.when(F.col("p_size") > 25, F.array(F.concat(F.lit(" "), "p_brand"), F.lit(" "), F.concat("p_type", F.lit("\t"))))
        .when(F.col("p_size") > 10, F.array(F.lit(""), F.col("p_brand")))
        .otherwise(F.array(F.lit(" "), F.lit(None)))
    )
    return table(spark, sf, "part", "p_partkey", "p_size", "p_brand", "p_type").select("p_partkey", _joined(T.clean_path(raw)).alias("path"))


@register(
    f"with recursive {LINES}, {PATHS}, {SEGMENTS}"
    + " select doc_id, seg::int as segment_index, count(*) > 1 and sum(n) > 400 as use_groups from seg_blocks group by doc_id, seg"
)
def use_grouping_gate(spark, sf):
    return B.grouping_gate(B.segment_blocks(lined_documents(spark, sf))).select("doc_id", "segment_index", "use_groups")


@register(
    CHUNKED
    + r""" select doc_id, lang, chunk_index::int as chunk_index, content, context, array_to_string(path, ' > ') as heading_path, 'text' as chunk_type,
      false as has_table, 1 as page_number, context || chr(10) || chr(10) || content as text,
      len(regexp_extract_all(context || chr(10) || chr(10) || content, '\S+'))::int as token_count from chunk_rows"""
)
def build_chunks(spark, sf):
    chunks = B.build_chunks(lined_documents(spark, sf), filename="source", carry=("lang",))
    return chunks.select(
        "doc_id", "lang", "chunk_index", "content", "context", _joined("heading_path").alias("heading_path"), "chunk_type", "has_table",
        "page_number", "text", "token_count",
    )


@register(
    CHUNKED
    + r""" select doc_id, chunk_index::int as chunk_index, content, context, 1 as page_number, lang from chunk_rows"""
)
def chunk_block_rows(spark, sf):
    """The same documents as one row per block, walked in a sorted stream."""
    rows = T.unnest(lined_documents(spark, sf), ["doc_id", "lang", "source"], F.col("blocks"), "pos", "b").select("doc_id", "lang", "source", "pos", "b.*")
    return B.chunk_block_rows(rows, filename="source", carry=("lang",)).select("doc_id", "chunk_index", "content", "context", "page_number", "lang")


@register(
    CHUNKED
    + """, counted as (select doc_id, count(*) as n from chunk_rows where lang <> 'es' group by doc_id)
    select d.doc_id, case when d.lang = 'fr' or n is null then 'failed' else 'ready' end as status,
      case when d.lang <> 'fr' and n is not null then 1 end::int as page_count, case when d.lang <> 'fr' then n end as chunk_count,
      case when d.lang = 'fr' then 'no content' when n is null then 'no chunks' end as error_message
    from documents d left join counted c using (doc_id)"""
)
def ingest_summary(spark, sf):
    """One language counts as unreadable, another as giving no chunks."""
    docs = lined_documents(spark, sf)
    chunks = B.build_chunks(docs.filter(F.col("lang") != "es"), filename="source")
    state = docs.select("doc_id", F.lit(1).alias("page_count"), (F.col("lang") != "fr").alias("has_content"))
    return B.ingest_summary(state, chunks)


@register(
    """with incoming as (select d.doc_id + 1000000000 as doc_id, d.source, d.text from documents d join labels l using (doc_id) where l.quality = 0)
    select doc_id, source as filename, length(text) as n from documents where source not in (select source from incoming)
    union all select doc_id, source, length(text) from incoming"""
)
def stored_replace_by_name(spark, sf):
    """The same replacement on stored tables: documents, then the incoming ones under their names, then a compaction."""
    docs = table(spark, sf, "documents", "doc_id", "source", "text").withColumnRenamed("source", "filename")
    poor = table(spark, sf, "labels", "doc_id", "quality").filter("quality = 0").select("doc_id")
    incoming = docs.join(poor, "doc_id", "left_semi").withColumn("doc_id", F.col("doc_id") + 1000000000)
    store = Snapshot(spark, scratch_path(spark, "stored-documents"), "doc_id")
    for rows in (docs, incoming):
        store.replace_by("filename", {"documents": rows}, "documents")
    store.compact()
    return store.table("documents").select("doc_id", "filename", F.char_length("text").cast("long").alias("n"))


@register(
    """with kept as (select doc_id, length(text) as n from documents where doc_id not in (select doc_id from labels where toxic = 1))
    select doc_id, n, (select count(*) from embeddings where vec_id = doc_id) as vectors from kept"""
)
def stored_delete_cascade(spark, sf):
    """Documents and their vectors stored together; toxic ones leave both tables in one change, read while it is open."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    vectors = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    toxic = table(spark, sf, "labels", "doc_id", "toxic").filter("toxic = 1")
    store = Snapshot(spark, scratch_path(spark, "stored-corpus"), "doc_id")
    store.replace({"documents": docs, "vectors": vectors})
    store.compact()
    store.delete(toxic)
    n = store.table("vectors").groupBy("doc_id").agg(F.count(F.lit(1)).alias("vectors"))
    left = store.table("documents").select("doc_id", F.char_length("text").cast("long").alias("n")).join(n, "doc_id", "left")
    return left.select("doc_id", "n", F.coalesce("vectors", F.lit(0)).cast("long").alias("vectors"))
