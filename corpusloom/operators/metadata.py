"""Document metadata tables: headers, titles, gazetteer lookups, upload checks, query slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import rules
from corpusloom.functions import metadata as M
from corpusloom.functions.text import null_if_blank, py_strip
from corpusloom.operators.automaton import NAME_BYTES, blocks_of, longest_name


def localities(spark) -> DataFrame:
    """The built-in gazetteer as a table."""
    return spark.createDataFrame([(n,) for n in rules.LOCALITIES], "name string")


def header_text(pages: DataFrame, n: int = 2, key: str = "doc_id") -> DataFrame:
    """Text of the first ``n`` pages of each document without Markdown marks.

    ``pages(doc_id, page_number, md)``.  Only n rows per document and task survive the window's group
    limit before the shuffle.
    """
    order = Window.partitionBy(key).orderBy("page_number")
    head = pages.select(key, "page_number", "md").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n)
    parts = F.array_sort(F.collect_list(F.struct("_n", F.coalesce("md", F.lit("")).alias("md"))))
    joined = F.array_join(F.transform(parts, lambda p: p["md"]), "\n")
    return head.groupBy(key).agg(py_strip(M.strip_markdown(joined)).alias("header"))


def header_metadata(headers: DataFrame, key: str = "doc_id", filename: str | None = None) -> DataFrame:
    """Type, date, issuing body and name of each document; the name falls back to the file name."""
    fallback = F.col(filename) if filename else F.lit(None).cast("string")
    return headers.select(
        key,
        M.doc_type("header").alias("doc_type"),
        M.issued_date("header").alias("issued_date"),
        M.issuing_body("header").alias("issuing_body"),
        F.coalesce(M.doc_number("header"), fallback).alias("doc_name"),
    )


def fill_missing(
    base: DataFrame,
    extra: DataFrame,
    key: str = "doc_id",
    fields: tuple[str, ...] = ("doc_type", "issued_date", "issuing_body", "doc_name"),
    type_field: str = "doc_type",
    known_types: tuple[str, ...] | None = None,
) -> DataFrame:
    """Per field the base value, or the external one where the base is missing or blank.

    An external type outside the known ones counts as "other".
    """
    known = known_types or (*[label for label, _ in rules.DOC_TYPE_RULES], rules.DOC_TYPE_OTHER)
    outside = extra.select(key, *[F.col(f).cast("string").alias(f"_x_{f}") for f in fields])
    joined = base.join(outside, key, "left")
    out = []
    for f in fields:
        offered = null_if_blank(f"_x_{f}")
        if f == type_field:
            offered = F.when(F.col(f"_x_{f}").isNotNull(), F.when(offered.isin(*known), offered).otherwise(rules.DOC_TYPE_OTHER))
        out.append(F.coalesce(F.when(null_if_blank(f).isNotNull(), F.col(f)), offered).alias(f))
    return joined.select(key, *out)


def canonicalize(df: DataFrame, gazetteer: DataFrame, column: str, out: str, keep_unknown: bool = False) -> DataFrame:
    """Look the name up in the gazetteer by trimmed lower case; null (or the name itself) if unknown.

    A plain equi-join on the key: broadcast by size when the gazetteer is small, otherwise shuffled with
    AQE splitting an over-frequent name.
    """
    lookup = gazetteer.select(M.lookup_key("name").alias("_key"), F.col("name").alias("_name"))
    lookup = lookup.groupBy("_key").agg(F.min("_name").alias("_name"))
    joined = df.withColumn("_key", M.lookup_key(column)).join(lookup, "_key", "left")
    value = F.coalesce("_name", F.col(column)) if keep_unknown else F.col("_name")
    return joined.withColumn(out, value).drop("_key", "_name")


def gazetteer_match(
    texts: DataFrame, gazetteer: DataFrame, column: str = "text", out: str = "match", key: str = "query_id",
    small: int = NAME_BYTES,
) -> DataFrame:
    """Longest gazetteer name contained in the text, ignoring case; equal lengths give the smallest name.

    Every text is read once by an automaton of all names, where it lies and without a join; names beyond ``small``
    bytes are read by further automata in the same plan.  Each row gets one answer, whatever its key.
    """
    names = gazetteer.select(F.char_length("name").alias("n"), F.col("name"), F.lower("name").alias("low")).filter(F.col("low") != "").distinct()
    low, found = F.lower(F.col(column)), []
    for block in blocks_of(names, lambda r: len(r.low.encode()), small):
        found.append(longest_name([tuple(r) for r in block])(low))
    if not found:
        return texts.withColumn(out, F.lit(None).cast("string"))
    best = found[0] if len(found) == 1 else F.array_min(F.filter(F.array(*found), lambda f: f["n"].isNotNull()))
    return texts.withColumn(out, best["name"])


def title_metadata(files: DataFrame, gazetteer: DataFrame, column: str = "filename") -> DataFrame:
    """School year and locality from the file title; unknown localities are kept as written."""
    stem = M.file_stem(column)
    parsed = files.withColumn("school_year", M.parse_year(stem)).withColumn("_locality", M.locality_name(stem))
    return canonicalize(parsed, gazetteer, "_locality", "ward", keep_unknown=True).drop("_locality")


def query_slots(queries: DataFrame, gazetteer: DataFrame, column: str = "text") -> DataFrame:
    """Filter slots of each question: school year and locality, null where not mentioned."""
    with_year = queries.withColumn("school_year", M.parse_year(column))
    return gazetteer_match(with_year, gazetteer, column, "ward")


def validate_uploads(files: DataFrame, filename: str = "filename", mime_type: str = "mime_type", size: str = "file_size") -> DataFrame:
    """Add extension, media type and problem (null when accepted)."""
    return files.withColumn("_c", M.upload_check(filename, mime_type, size)).select(*files.columns, "_c.*")
