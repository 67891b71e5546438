"""Readers, writers and table maintenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.blocks import GRID, ITEM_IN


PAGES_SCHEMA = f"pages array<struct<page:int,md:string,items:array<{ITEM_IN}>>>"
EVAL_SCHEMA = (
    "id string, question string, ground_truth string, reference_context string, "
    "expected_keywords array<string>, source_doc string, favors string, category string, "
    "answer string, contexts array<string>"
)


def read_table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None, newest_by: str | None = None) -> DataFrame:
    """A Parquet table, pruned to ``columns`` and, on request, ordered with the newest rows first."""
    table = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    if columns:
        table = table.select(*columns)
    return table.orderBy(F.col(newest_by).desc()) if newest_by else table


def read_parsed_pages(spark: SparkSession, path: str, json_lines: bool = False, keys: str = "") -> DataFrame:
    """Parser output with an explicit schema: one document per JSON file, or per line with ``json_lines``.

    ``keys`` is DDL of further top-level fields to keep, such as ``"doc_id bigint"``.
    """
    schema = f"{keys}, {PAGES_SCHEMA}" if keys else PAGES_SCHEMA
    raw = spark.read.schema(schema).option("multiLine", str(not json_lines).lower()).json(path)
    none = F.array().cast(PAGES_SCHEMA.split(" ", 1)[1])
    kept = [c for c in raw.columns if c != "pages"]
    return raw.select(*kept, F.col("_metadata.file_path").alias("path"), F.coalesce("pages", none).alias("pages"))


def read_eval_set(spark: SparkSession, path: str, json_lines: bool | None = None) -> DataFrame:
    """Evaluation questions from a JSON array or from JSON lines (blank lines are skipped)."""
    lines = path.rstrip("/").endswith(".jsonl") if json_lines is None else json_lines
    return spark.read.schema(EVAL_SCHEMA).option("multiLine", str(not lines).lower()).json(path)


def write_results(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "json") -> None:
    """Write a result table, partitioned (for example by label source)."""
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def sweep_document(grid: DataFrame, by: str = "alpha") -> DataFrame:
    """A metric grid as one nested JSON-ready row per parameter value (bounded by the k grid)."""
    measures = [c for c in grid.columns if c not in (by, "k", "mrr", "n")]
    per_k = F.array_sort(F.collect_list(F.struct("k", *measures)))
    return grid.groupBy(by).agg(per_k.alias("per_k"), F.max("mrr").alias("mrr"), F.max("n").alias("n"))


def replace_by_name(existing: DataFrame, incoming: DataFrame, name: str = "filename") -> DataFrame:
    """Re-ingestion: everything stored under an incoming name is dropped, then the new rows are added."""
    names = incoming.select(name).distinct()
    return existing.join(names, name, "left_anti").select(*existing.columns).unionByName(incoming.select(*existing.columns))


def delete_cascade(
    documents: DataFrame, chunks: DataFrame, doomed: DataFrame | None, key: str = "document_id", vector: str = "vector_id"
) -> dict[str, DataFrame]:
    """Remove documents (all when ``doomed`` is None) with their chunks.

    Returns the remaining ``documents`` and ``chunks``, the ``vectors`` to drop (non-null ids only) and
    the ``deleted`` count.
    """
    if doomed is None:
        gone_docs, gone_chunks = documents, chunks
        left_docs, left_chunks = documents.limit(0), chunks.limit(0)
    else:
        ids = doomed.select(key).distinct()
        gone_docs, left_docs = documents.join(ids, key, "left_semi"), documents.join(ids, key, "left_anti")
        gone_chunks, left_chunks = chunks.join(ids, key, "left_semi"), chunks.join(ids, key, "left_anti")
    return {
        "documents": left_docs,
        "chunks": left_chunks,
        "vectors": gone_chunks.filter(F.col(vector).isNotNull()).select(vector),
        "deleted": gone_docs.agg(F.count(F.lit(1)).alias("deleted")),
    }


def append_chunks(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunk rows in their stored form: JSON heading list (null if empty) and wrapped grid (null if empty).

    ``chunk_index`` is the 0-based place of the chunk within its document row, fixed when the document
    was cut, so storing needs no numbering shuffle.
    """
    path = F.when(F.size("heading_path") > 0, F.to_json("heading_path"))
    grid = F.when(F.size("grid") > 0, F.to_json(F.struct(F.col("grid").cast(GRID).alias("grid"))))
    return chunks.select(
        F.col(key).alias("document_id"),
        "chunk_index",
        "content",
        F.col("chunk_id").alias("vector_id"),
        "token_count",
        path.alias("heading_path"),
        F.nullif("context", F.lit("")).alias("context"),
        "chunk_type",
        "has_table",
        "page_number",
        grid.alias("table_data"),
    )
