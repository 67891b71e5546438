"""Header, title and slot extraction on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from catalog.data import benchmark_queries, table
from corpusloom.functions import metadata as M
from corpusloom.operators import metadata as C

# Headers and file names are composed from whole tables; the SQL sees the same compositions.
_HEADER = """h as (select o_orderkey as doc_id, 'ỦY BAN NHÂN DÂN ' || o_orderpriority || chr(10) || 'Số: ' || o_custkey || '/KH-' || o_orderstatus || ' end' || chr(10)
  || case o_orderstatus when 'F' then 'KẾ  HOẠCH' when 'O' then 'THÔNG TƯ về QUYẾT ĐỊNH' else 'BÁO CÁO' end || chr(10)
  || 'ngày ' || day(o_orderdate) || ' tháng ' || month(o_orderdate) || ' năm ' || year(o_orderdate) as header,
  o_orderstatus, o_custkey, o_orderdate, o_orderpriority from orders)"""


def _headers(spark, sf):
    rows = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    kind = F.when(F.col("o_orderstatus") == "F", "KẾ  HOẠCH").when(F.col("o_orderstatus") == "O", "THÔNG TƯ về QUYẾT ĐỊNH").otherwise("BÁO CÁO")
    text = F.concat(
        F.lit("ỦY BAN NHÂN DÂN "), "o_orderpriority", F.lit("\nSố: "), F.col("o_custkey").cast("string"), F.lit("/KH-"), "o_orderstatus",
        F.lit(" end\n"), kind, F.lit("\nngày "), F.day("o_orderdate").cast("string"), F.lit(" tháng "), F.month("o_orderdate").cast("string"),
        F.lit(" năm "), F.year("o_orderdate").cast("string"),
    )
    return rows.select(F.col("o_orderkey").alias("doc_id"), text.alias("header"))


_FILES = """f as (select o_orderkey as doc_id, 'Kế hoạch tuyển sinh ' || year(o_orderdate) || case o_orderstatus when 'F' then ' - ' when 'O' then ' ' else '' end
  || case when o_orderstatus = 'P' then '' else (year(o_orderdate) + 1)::varchar end || ' PHƯỜNG ' || lower(r_name) || ', NATION ' || n_name || '.pdf' as filename,
  o_orderstatus, o_orderdate, r_name, n_name from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
  join region on r_regionkey = n_regionkey)"""


def _files(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    y = F.year("o_orderdate")
    name = F.concat(
        F.lit("Kế hoạch tuyển sinh "), y.cast("string"),
        F.when(F.col("o_orderstatus") == "F", " - ").when(F.col("o_orderstatus") == "O", " ").otherwise(""),
        F.when(F.col("o_orderstatus") == "P", "").otherwise((y + 1).cast("string")),
        F.lit(" PHƯỜNG "), F.lower("r_name"), F.lit(", NATION "), "n_name", F.lit(".pdf"),
    )
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, n.n_nationkey == c.c_nationkey).join(r, r.r_regionkey == n.n_regionkey)
    return joined.select(F.col("o_orderkey").alias("doc_id"), name.alias("filename"))


def _regions(spark, sf):
    return table(spark, sf, "region").select(F.initcap("r_name").alias("name"))


@register(
    r"""select doc_id, replace(replace(regexp_replace('## ' || lang || chr(10) || '  # **' || text || '** __ok__', '(?m)^\s{0,3}#{1,6}\s+', '', 'g'), '**', ''), '__', '') as plain
    from documents"""
)
def strip_markdown(spark, sf):
    marked = F.concat(F.lit("## "), "lang", F.lit("\n  # **"), "text", F.lit("** __ok__"))
    return table(spark, sf, "documents", "doc_id", "text", "lang").select("doc_id", M.strip_markdown(marked).alias("plain"))


@register(
    r"""with p as (select source, text, row_number() over (partition by source order by doc_id) as n from documents)
    select source, trim(replace(replace(regexp_replace(string_agg('# ' || text, chr(10) order by n), '(?m)^\s{0,3}#{1,6}\s+', '', 'g'), '**', ''), '__', ''), ' ' || chr(10)) as header from p where n <= 2 group by source"""
)
def header_text(spark, sf):
    """Every source as one document whose pages are its rows."""
    pages = table(spark, sf, "documents", "doc_id", "text", "source").select("source", F.col("doc_id").alias("page_number"), F.concat(F.lit("# "), "text").alias("md"))
    return C.header_text(pages, key="source")


@register(
    r"""select doc_id, case when regexp_matches(text, '(?i)token = ') then 'secret' when regexp_matches(text, '(?i) that ') then 'english'
       when regexp_matches(text, '(?i) que ') then 'romance' else 'khac' end as doc_type from documents"""
)
def doc_type(spark, sf):
    words = (("secret", "(?iu)token = "), ("english", "(?iu) that "), ("romance", "(?iu) que "))
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", M.doc_type("text", words).alias("doc_type"))


@register(f"with {_HEADER} select doc_id, strftime(o_orderdate, '%d/%m/%Y') as issued_date from h")
def issued_date(spark, sf):
    return _headers(spark, sf).select("doc_id", M.issued_date("header").alias("issued_date"))


@register(f"with {_HEADER} select doc_id, 'ỦY BAN NHÂN DÂN ' || o_orderpriority as issuing_body from h")
def issuing_body(spark, sf):
    return _headers(spark, sf).select("doc_id", M.issuing_body("header").alias("issuing_body"))


@register(f"with {_HEADER} select doc_id, 'Số ' || o_custkey || '/KH-' || o_orderstatus as doc_name from h")
def doc_number(spark, sf):
    return _headers(spark, sf).select("doc_id", M.doc_number("header").alias("doc_name"))


@register(
    f"""with {_HEADER} select doc_id, case o_orderstatus when 'F' then 'ke_hoach' when 'O' then 'quyet_dinh' else 'khac' end as doc_type,
      strftime(o_orderdate, '%d/%m/%Y') as issued_date, 'ỦY BAN NHÂN DÂN ' || o_orderpriority as issuing_body,
      'Số ' || o_custkey || '/KH-' || o_orderstatus as doc_name from h"""
)
def header_metadata(spark, sf):
    return C.header_metadata(_headers(spark, sf))


@register(
    """select d.doc_id, case when d.lang = 'en' then 'ke_hoach' when l.doc_id is null then null when l.quality = 1 then 'thong_tu' else 'khac' end as doc_type,
       case when d.lang = 'fr' then case when l.doc_id is not null then 'toxic ' || l.toxic end else d.lang end as issued_date,
       d.source as doc_name
    from documents d left join labels l using (doc_id)"""
)
def fill_missing(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "lang", "source").select(
        "doc_id",
        F.when(F.col("lang") == "en", "ke_hoach").when(F.col("lang") == "de", " ").alias("doc_type"),
        F.when(F.col("lang") != "fr", F.col("lang")).otherwise("").alias("issued_date"),
        F.col("source").alias("doc_name"),
    )
    extra = table(spark, sf, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 1, "thong_tu").otherwise("unheard of").alias("doc_type"),
        F.concat(F.lit(" toxic "), F.col("toxic").cast("string")).alias("issued_date"),
        F.lit("ignored").alias("doc_name"),
    )
    return C.fill_missing(docs, extra, fields=("doc_type", "issued_date", "doc_name"))


_YEARS = "case when o_orderstatus = 'P' or year(o_orderdate) < 2000 then null else year(o_orderdate) || '-' || (year(o_orderdate) + 1) end"


@register(f"with {_FILES} select doc_id, {_YEARS} as school_year from f")
def parse_year(spark, sf):
    return _files(spark, sf).select("doc_id", M.parse_year("filename").alias("school_year"))


@register(f"with {_FILES} select doc_id, lower(r_name) as ward from f")
def parse_locality(spark, sf):
    return _files(spark, sf).select("doc_id", M.locality_name("filename").alias("ward"))


@register("select c_custkey, case when c_mktsegment = 'MACHINERY' then null else n_name end as nation from customer join nation on n_nationkey = c_nationkey")
def canonicalize(spark, sf):
    """Customers' nations in odd case and spacing, one segment unknown, looked up among the nations."""
    c, n = table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment"), table(spark, sf, "nation", "n_nationkey", "n_name")
    raw = F.when(F.col("c_mktsegment") == "MACHINERY", F.concat("n_name", F.lit("?"))).otherwise(F.concat(F.lit(" "), F.lower("n_name"), F.lit("\t")))
    names = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", raw.alias("raw"))
    out = C.canonicalize(names, n.select(F.col("n_name").alias("name")), "raw", "nation")
    return out.select("c_custkey", "nation")


_GAZETTEER = "g as (select n_name as name from nation union all select r_name from region)"


@register(
    f"""with {_GAZETTEER}, t as (select c_custkey, 'in ' || lower(n_name) || ' of ' || case when c_mktsegment = 'FURNITURE' then r_name else '' end as text
      from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey)
    select c_custkey, (select arg_min(name, (-length(name), name)) from g where contains(lower(t.text), lower(g.name))) as match from t"""
)
def gazetteer_match(spark, sf):
    """Customer notes against the names of nations and regions; NATION_1 is also inside NATION_12."""
    c, n, r = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region")
    text = F.concat(F.lit("in "), F.lower("n_name"), F.lit(" of "), F.when(F.col("c_mktsegment") == "FURNITURE", F.col("r_name")).otherwise(""))
    notes = c.join(n, c.c_nationkey == n.n_nationkey).join(r, r.r_regionkey == n.n_regionkey).select("c_custkey", text.alias("text"))
    names = n.select(F.col("n_name").alias("name")).unionByName(r.select(F.col("r_name").alias("name")))
    return C.gazetteer_match(notes, names, key="c_custkey").select("c_custkey", "match")


@register(
    r"""with w as (select distinct lower(regexp_extract(text, '^\S+\s+(\S+)', 1)) as name from benchmark),
    g as (select name from w where length(name) >= 3)
    select d.doc_id, (select arg_min(name, (-length(name), name)) from g where contains(lower(d.text), name)) as match from documents d"""
)
def gazetteer_match_large(spark, sf):
    """Second words of passages as names, found anywhere in documents."""
    second = F.lower(F.regexp_extract("text", r"^\S+\s+(\S+)", 1))
    names = table(spark, sf, "benchmark").select(second.alias("name")).distinct().filter(F.char_length("name") >= 3)
    docs = table(spark, sf, "documents", "doc_id", "text")
    return C.gazetteer_match(docs, names, key="doc_id").select("doc_id", "match")


@register(f"with {_FILES} select doc_id, {_YEARS} as school_year, upper(r_name[1]) || lower(r_name[2:]) as ward from f")
def title_metadata(spark, sf):
    regions = table(spark, sf, "region").select(F.concat(F.upper(F.substring("r_name", 1, 1)), F.lower(F.expr("substring(r_name, 2)"))).alias("name"))
    return C.title_metadata(_files(spark, sf), regions).select("doc_id", "school_year", "ward")


@register(
    """select o_orderkey,
      case left(o_orderpriority, 1) when '1' then 'pdf' when '2' then 'docx' when '3' then 'pdf' end as extension,
      case left(o_orderpriority, 1) when '1' then 'application/pdf' when '3' then 'application/pdf'
        when '2' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' else 'application/octet-stream' end as media_type,
      case when left(o_orderpriority, 1) not in ('1', '2', '3') then 'unsupported'
           when o_orderstatus = 'P' then 'empty' when round(o_totalprice * 100) > 26214400 then 'too large' end as problem
    from orders"""
)
def validate_uploads(spark, sf):
    """Orders as uploads: priority decides the file type, the price the size, one type only by MIME."""
    p = F.substring("o_orderpriority", 1, 1)
    name = F.when(p == "1", "a.b.PDF").when(p == "2", "plan.docx").when(p == "3", "scan.bin").when(p == "4", "notes.txt").otherwise("pdf")
    mime = F.when(p == "3", "application/pdf").otherwise("text/plain")
    size = F.when(F.col("o_orderstatus") == "P", 0).otherwise(F.round(F.col("o_totalprice") * 100)).cast("long")
    files = table(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice").select(
        "o_orderkey", name.alias("filename"), mime.alias("mime_type"), size.alias("file_size")
    )
    return C.validate_uploads(files).select("o_orderkey", "extension", "media_type", "problem")


@register(
    """with q as (select item_id, case when length(text) > 200 then '2026 – 2027 ' else '' end || text as text from benchmark),
    g as (select distinct lower(string_split(text, ' ')[3]) as name from benchmark where len(string_split(text, ' ')) >= 3)
    select item_id as query_id, case when length(text) > 212 then '2026-2027' end as school_year,
      (select arg_min(name, (-length(name), name)) from g where name <> '' and contains(lower(q.text), name)) as ward from q"""
)
def query_slots(spark, sf):
    """Year and locality slots of the passages; localities are the passages' third words."""
    queries = benchmark_queries(spark, sf).withColumn(
        "text", F.concat(F.when(F.char_length("text") > 200, "2026 – 2027 ").otherwise(""), "text")
    )
    third = F.lower(F.get(F.split("text", " "), F.lit(2)))
    names = benchmark_queries(spark, sf).select(third.alias("name")).distinct().filter("name is not null")
    return C.query_slots(queries, names).select("query_id", "school_year", "ward")
