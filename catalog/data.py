"""The test tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.markup import BLOCK, text_blocks
from corpusloom.functions.text import count_tokens
from corpusloom.sources.tables import read_table


TEXT_HEAVY = ("documents", "pages", "conversations")


def spread_small(rows: DataFrame) -> DataFrame:
    """Deal out a test table that is one file, so that a local run uses all cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    rows = read_table(spark, sf, name, columns or None)
    heavy = name in TEXT_HEAVY and (not columns or {"text", "html"} & set(columns))
    return spread_small(rows) if heavy else rows


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as queries: query_id, text."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def text_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks: chunk_id, text, lang, source."""
    return table(spark, sf, "documents", "doc_id", "text", "lang", "source").withColumnRenamed("doc_id", "chunk_id")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages with the vector stored under their id, and its class."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return benchmark_queries(spark, sf).join(vectors, "query_id", "left")


def vector_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors as chunks: chunk_id, embedding, label."""
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "chunk_id")


def hybrid_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the vector stored under their id (null without one)."""
    return text_corpus(spark, sf).join(vector_corpus(spark, sf).select("chunk_id", "embedding"), "chunk_id", "left")


def lined_blocks(text: Column) -> Column:
    """Lines as blocks; a line of at most eight words acts as a heading of level 1 to 3."""

    def one(b: Column) -> Column:
        n = count_tokens(b["md"])
        heading = n <= 8
        return F.struct(
            b["page_number"].alias("page_number"),
            F.when(heading, "heading").otherwise("text").alias("type"),
            F.when(heading, n % 3 + 1).alias("level"),
            b["value"].alias("value"),
            b["md"].alias("md"),
            b["rows"].alias("rows"),
        ).cast(BLOCK)

    return F.transform(text_blocks(text), one)


def lined_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    return docs.withColumn("blocks", lined_blocks(F.col("text"))).drop("text")


# --- SQL building blocks -------------------------------------------------------------------------

WORD_COUNT = r"len(regexp_extract_all({0}, '\S+'))"

LINES = r"""
lines as (
  select doc_id, lang, source, row_number() over (partition by doc_id order by i) - 1 as pos, line,
         len(regexp_extract_all(line, '\S+')) as n
  from (select doc_id, lang, source, unnest(string_split(text, chr(10))) as line,
               generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
  where regexp_matches(line, '\S')
),
blocks as (
  select doc_id, lang, source, pos, trim(line) as md, n, n <= 8 as heading,
         case when n <= 8 then n % 3 + 1 end as level
  from lines
)"""

PATHS = """
opened as (
  select *,
    max(case when level = 1 then pos end) over w as p1, max(case when level = 2 then pos end) over w as p2,
    max(case when level = 3 then pos end) over w as p3
  from blocks window w as (partition by doc_id order by pos)
),
paths as (
  select o.*,
    list_filter([b1.md,
      case when o.p2 > coalesce(o.p1, -1) then b2.md end,
      case when o.p3 > greatest(coalesce(o.p1, -1), coalesce(o.p2, -1)) then b3.md end], lambda x: x is not null) as path
  from opened o
  left join blocks b1 on b1.doc_id = o.doc_id and b1.pos = o.p1
  left join blocks b2 on b2.doc_id = o.doc_id and b2.pos = o.p2
  left join blocks b3 on b3.doc_id = o.doc_id and b3.pos = o.p3
)"""

SEGMENTS = """
walk as (
  select doc_id, pos, n as tokens, 0 as seg from blocks where pos = 0
  union all
  select b.doc_id, b.pos,
    case when b.heading and w.tokens >= 2500 then b.n else w.tokens + b.n end,
    case when b.heading and w.tokens >= 2500 then w.seg + 1 else w.seg end
  from walk w join blocks b on b.doc_id = w.doc_id and b.pos = w.pos + 1
),
seg_blocks as (
  select p.doc_id, p.lang, p.source, p.pos, p.md, p.n, p.path, w.seg,
    row_number() over (partition by p.doc_id, w.seg order by p.pos) - 1 as spot,
    count(*) over (partition by p.doc_id, w.seg) as seg_size,
    first_value(p.path) over (partition by p.doc_id, w.seg order by p.pos) as seg_path
  from paths p join walk w on w.doc_id = p.doc_id and w.pos = p.pos
)"""

PIECES = """
merge_walk as (
  select doc_id, seg, spot, n as tokens, 0 as piece from seg_blocks where spot = 0
  union all
  select b.doc_id, b.seg, b.spot,
    case when m.tokens + b.n > 512 then b.n else m.tokens + b.n end,
    case when m.tokens + b.n > 512 then m.piece + 1 else m.piece end
  from merge_walk m join seg_blocks b on b.doc_id = m.doc_id and b.seg = m.seg and b.spot = m.spot + 1
),
pieces as (
  select b.doc_id, any_value(b.lang) as lang, any_value(b.source) as source, b.seg, m.piece,
    string_agg(b.md, chr(10) || chr(10) order by b.spot) as content, any_value(b.seg_path) as path
  from seg_blocks b join merge_walk m on m.doc_id = b.doc_id and m.seg = b.seg and m.spot = b.spot
  group by b.doc_id, b.seg, m.piece
)"""

CHUNKS = """
chunk_rows as (
  select doc_id, lang, source, row_number() over (partition by doc_id order by seg, piece) - 1 as chunk_index, content, path,
    trim('Trích từ ' || source || '.' || case when len(path) > 0 then ' Thuộc: ' || array_to_string(path, ' > ') || '.' else '' end) as context
  from pieces
)"""

CHUNKED = f"with recursive {LINES}, {PATHS}, {SEGMENTS}, {PIECES}, {CHUNKS}"

BM25 = r"""
terms as (select doc_id as chunk_id, lang, source, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ts from documents),
size_stats as (select count(*)::double as n, avg(len(ts)) as avgdl from terms),
query_terms as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from benchmark),
postings as (select chunk_id, lang, source, dl, term, count(*) as tf
  from (select chunk_id, lang, source, len(ts) as dl, unnest(ts) as term from terms) group by all),
dfs as (select term, count(*)::double as df from postings group by term),
bm25_all as (
  select q.query_id, p.chunk_id, p.lang, p.source,
    round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.avgdl))), 6) as score
  from query_terms q join postings p using (term) join dfs d using (term), size_stats s
  group by q.query_id, p.chunk_id, p.lang, p.source
)"""


def best(source: str, k: int, by: str = "query_id", name: str = "ranked", where: str = "true") -> str:
    return f"""{name} as (select * from (select *, row_number() over (partition by {by} order by score desc, chunk_id) as rank
  from {source} where {where}) where rank <= {k})"""


DENSE = """
vec_q as (select b.item_id as query_id, e.embedding::double[] as v, e.label from benchmark b join embeddings e on e.vec_id = b.item_id),
dense_all as (
  select q.query_id, e.vec_id as chunk_id, round(list_cosine_similarity(q.v, e.embedding::double[]), 6) as score
  from vec_q q, embeddings e
)"""


def hybrid_ctes(k: int) -> str:
    """Both branches over documents, k deep: CTEs ``dense`` and ``sparse``."""
    return ",".join(
        [
            BM25,
            DENSE,
            best("dense_all", k, name="dense", where="chunk_id in (select doc_id from documents)"),
            best("bm25_all", k, name="sparse"),
        ]
    )


def fuse(alpha: str, k: int, dense: str = "dense", sparse: str = "sparse") -> str:
    return f"""fused_all as (
  select query_id, chunk_id, round(sum(w), 9) as score from (
    select query_id, chunk_id, {alpha} / (60 + rank) as w from {dense}
    union all select query_id, chunk_id, (1 - {alpha}) / (60 + rank) from {sparse}) where w > 0
  group by query_id, chunk_id), {best("fused_all", k, name="fused")}"""


NORM = r"trim(regexp_replace(lower(strip_accents(replace(replace({0}, 'đ', 'd'), 'Đ', 'D'))), '\s+', ' ', 'g'))"


def norm(column: str) -> str:
    return NORM.format(column)


TRIGRAM_RECALL = f"""
doc_words as (select doc_id as chunk_id, list_filter(string_split({norm('text')}, ' '), lambda w: w <> '') as w from documents),
ref_words as (select item_id as query_id, list_filter(string_split({norm('text')}, ' '), lambda w: w <> '') as w from benchmark),
ref_grams as (select query_id, unnest(case when len(w) < 3 then [array_to_string(w, ' ')] else
    list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) end) as gram from ref_words where len(w) > 0),
ref_sizes as (select query_id, count(*) as n from ref_grams group by query_id),
doc_grams as (select distinct chunk_id, unnest(case when len(w) < 3 then [array_to_string(w, ' ')] else
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) end) as gram from doc_words where len(w) > 0),
recalls as (select r.query_id, d.chunk_id, round(count(*) / any_value(s.n), 6) as recall
  from ref_grams r join doc_grams d using (gram) join ref_sizes s on s.query_id = r.query_id group by r.query_id, d.chunk_id)"""
