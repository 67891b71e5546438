"""Data quality checks on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from catalog.data import table
from corpusloom.functions.text import count_tokens
from corpusloom.operators import quality as H
from corpusloom.session import scratch_path

# Documents as chunks: language decides which parts are missing or wrong.
_FLAGGED = r"""
c as (select doc_id, lang, case when lang = 'de' and source in ('src1', 'src2') then ' ' else text end as content, source as context,
  lang in ('fr', 'es') as has_table, lang = 'fr' as has_grid, lang <> 'es' as has_id, len(regexp_extract_all(text, '\S+')) as tokens from documents),
flags as (select doc_id, list_filter([
  case when trim(content) = '' then 'EMPTY_CONTENT' end,
  case when has_table and not has_grid then 'TABLE_NO_DATA' when has_table and not contains(content, '|') then 'TABLE_MD_MISMATCH' end,
  case when contains(content, left(content, 5)) and lang = 'en' and trim(left(content, 5)) <> '' then 'CONTEXT_IN_CONTENT' end,
  case when tokens > 1536 then 'TOKEN_OUTLIER' end,
  case when not has_id then 'VECTOR_ID_NULL' end,
  case when not has_table and lang <> 'en' then 'HEADING_EMPTY' end], lambda x: x is not null) as flags from c)"""


def _flagged(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    lang = F.col("lang")
    blank = (lang == "de") & F.col("source").isin("src1", "src2")
    chunks = docs.select(
        "doc_id",
        F.when(blank, " ").otherwise(F.col("text")).alias("content"),
        F.when(lang == "en", F.substring("text", 1, 5)).alias("context"),
        lang.isin("fr", "es").alias("has_table"),
        F.when(lang == "fr", F.array(F.array(F.lit("x")))).alias("grid"),
        count_tokens("text").alias("token_count"),
        F.when(lang != "es", F.col("doc_id")).alias("vector_id"),
        F.when(lang == "en", F.array("source")).alias("heading_path"),
    )
    return H.chunk_flags(chunks)


@register(f"with {_FLAGGED} select doc_id, array_to_string(flags, ',') as flags from flags")
def chunk_flags(spark, sf):
    return _flagged(spark, sf).select("doc_id", F.array_join("flags", ",").alias("flags"))


@register("""select doc_id, source from documents order by md5('42/' || doc_id::varchar), doc_id limit 100""")
def seeded_sample(spark, sf):
    return H.seeded_sample(table(spark, sf, "documents", "doc_id", "source"), 100, 42, "doc_id")


@register(
    f"""with {_FLAGGED}, e as (select unnest(flags) as flag from flags)
    select flag, count(*) as n, (count(*) * 100 // (select count(*) from documents))::bigint as percent, flag in ('TABLE_NO_DATA', 'CONTEXT_IN_CONTENT') as heavy from e group by flag"""
)
def flag_report(spark, sf):
    return H.flag_report(_flagged(spark, sf))


@register(
    f"""with {_FLAGGED} select count(*) filter (list_has_any(flags, ['TABLE_NO_DATA', 'CONTEXT_IN_CONTENT'])) as heavy_rows,
      count(*) filter (list_has_any(flags, ['TABLE_NO_DATA', 'CONTEXT_IN_CONTENT'])) = 0 as passed from flags"""
)
def flag_gate(spark, sf):
    return H.passes_gate(_flagged(spark, sf))


@register(
    """select 'unique lineitem' as rule, l_orderkey || '/' || l_linenumber as key, count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1
    union all select 'unique customer name', c_name, count(*) from customer group by 1, 2 having count(*) > 1
    union all select 'unique vector', vec_id::varchar, count(*) from embeddings group by 1, 2 having count(*) > 1
    union all select 'rating', doc_id::varchar, 1 from labels where not (quality in (-1, 1))
    union all select 'stars', p_partkey::varchar, 1 from part where not (p_size between 1 and 48)
    union all select 'line has order', l_orderkey::varchar, count(*) from lineitem where l_orderkey not in (select o_orderkey from orders) group by 1, 2
    union all select 'vector has document', vec_id::varchar, count(*) from embeddings where vec_id not in (select doc_id from labels) group by 1, 2"""
)
def constraint_report(spark, sf):
    part, labels = table(spark, sf, "part", "p_partkey", "p_size"), table(spark, sf, "labels", "doc_id", "quality")
    return H.constraint_report(
        [
            H.unique_violations(table(spark, sf, "lineitem", "l_orderkey", "l_linenumber"), "unique lineitem", ["l_orderkey", "l_linenumber"]),
            H.unique_violations(table(spark, sf, "customer", "c_name"), "unique customer name", ["c_name"]),
            H.unique_violations(table(spark, sf, "embeddings", "vec_id"), "unique vector", ["vec_id"]),
            H.domain_violations(labels, "rating", "doc_id", F.col("quality").isin(-1, 1)),
            H.domain_violations(part, "stars", "p_partkey", F.col("p_size").between(1, 48)),
            H.foreign_key_violations(table(spark, sf, "lineitem", "l_orderkey"), table(spark, sf, "orders", "o_orderkey"), "line has order", "l_orderkey", "o_orderkey"),
            H.foreign_key_violations(table(spark, sf, "embeddings", "vec_id"), labels, "vector has document", "vec_id", "doc_id"),
        ]
    )


@register(
    """select 'unique line' as rule, l_orderkey || '/' || l_linenumber as key, count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1
    union all select 'unique delivery', l_partkey || '/' || l_suppkey || '/' || l_shipdate::date, count(*) from lineitem group by l_partkey, l_suppkey, l_shipdate having count(*) > 1
    union all select 'discount', l_orderkey || '/' || l_linenumber, count(*) from lineitem where not (l_discount < 0.1) group by l_orderkey, l_linenumber
    union all select 'shipped part', l_partkey::varchar, count(*) from lineitem where l_partkey not in (select p_partkey from part where p_size < 49) group by l_partkey
    union all select 'shipping supplier', l_suppkey::varchar, count(*) from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0) group by l_suppkey"""
)
def check_table(spark, sf):
    """Two uniqueness rules, one domain and two references of the line items from one scan of them."""
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_discount")
    parts = table(spark, sf, "part", "p_partkey", "p_size").filter("p_size < 49").select("p_partkey")
    suppliers = table(spark, sf, "supplier", "s_suppkey", "s_acctbal").filter("s_acctbal > 0").select("s_suppkey")
    return H.check_table(
        lines.withColumn("l_shipdate", F.col("l_shipdate").cast("date")),
        unique={"unique line": ["l_orderkey", "l_linenumber"], "unique delivery": ["l_partkey", "l_suppkey", "l_shipdate"]},
        domains={"discount": (["l_orderkey", "l_linenumber"], F.col("l_discount") < 0.1)},
        references={"shipped part": (["l_partkey"], parts), "shipping supplier": (["l_suppkey"], suppliers)},
    )


@register(
    """select 'rows' as rule, count(*) as n from documents union all select 'length', count(*) filter (not n_chars < 2000) from documents
    union all select 'language', count(*) filter (not lang in ('en', 'de')) from documents"""
)
def observe_rules(spark, sf):
    """Documents checked while they are written."""
    docs, seen = H.observe_rules(
        table(spark, sf, "documents", "doc_id", "lang", "n_chars"), {"length": F.col("n_chars") < 2000, "language": F.col("lang").isin("en", "de")}
    )
    docs.write.parquet(scratch_path(spark, "observed"))
    return spark.createDataFrame(list(seen.get.items()), "rule string, n long")


@register(
    """select lang as doc_id, count(*) as missing, 'failed' as status from documents where doc_id not in (select vec_id from embeddings) group by lang"""
)
def write_reconciliation(spark, sf):
    """Documents expected in the vector table, reported per language."""
    expected = table(spark, sf, "documents", "doc_id", "lang").select(F.col("lang").alias("doc_id"), F.col("doc_id").alias("vector_id"))
    return H.write_reconciliation(expected, table(spark, sf, "embeddings", "vec_id").withColumnRenamed("vec_id", "vector_id"))


@register(
    """select source as doc_id, count(*) as page_count, bool_or(lang = 'fr' or length(text) > 3000) as has_content from documents group by source"""
)
def content_presence_check(spark, sf):
    """Sources as documents: only French pages have text, only long ones blocks."""
    pages = table(spark, sf, "documents", "text", "lang", "source").select(
        F.col("source").alias("doc_id"), F.when(F.col("lang") == "fr", F.col("text")).otherwise("").alias("md"),
        F.when(F.char_length("text") > 3000, 1).alias("n_blocks"),
    )
    return H.content_presence(pages)
