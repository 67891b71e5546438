"""Documents to stored chunks, header and title metadata, and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import metadata as M
from corpusloom.functions.text import py_strip
from corpusloom.operators.blocks import build_chunks, ingest_summary, normalize_blocks
from corpusloom.operators.metadata import title_metadata
from corpusloom.sources.tables import append_chunks


def ingest_parsed(documents: DataFrame, gazetteer: DataFrame, key: str = "doc_id", filename: str = "filename") -> dict[str, DataFrame]:
    """``documents(doc_id, filename, pages)`` to ``documents``, ``chunks`` (stored form) and ``status``."""
    parsed = normalize_blocks(documents)
    header = py_strip(M.strip_markdown(F.array_join(F.transform(F.slice("page_texts", 1, 2), lambda p: p["md"]), "\n")))
    described = (
        title_metadata(parsed, gazetteer, filename)
        .withColumn("_header", header)
        .withColumn("doc_type", M.doc_type("_header"))
        .withColumn("issued_date", M.issued_date("_header"))
        .withColumn("issuing_body", M.issuing_body("_header"))
        .withColumn("doc_name", F.coalesce(M.doc_number("_header"), F.col(filename)))
        .drop("_header")
    )
    carry = (filename, "doc_name", "doc_type", "issued_date", "issuing_body", "school_year", "ward")
    chunks = build_chunks(described, key, filename, "doc_name", carry)
    has_text = F.exists("page_texts", lambda p: p["md"] != "") | (F.size("blocks") > 0)
    counted = described.select(key, F.size("page_texts").alias("page_count"), has_text.alias("has_content"))
    return {
        "documents": described.select(key, *carry),
        "search_chunks": chunks,
        "chunks": append_chunks(chunks, key),
        "status": ingest_summary(counted, chunks, key),
    }
