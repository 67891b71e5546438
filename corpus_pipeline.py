"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, tokenizing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, jaccard, lines, mixing, quality
from corpusloom.llm.common import free_name, tokenizer_file
from corpusloom.session import broadcast_if_small, materialize

#: Keys of equal rows that are broadcast; more are joined by shuffle.
EQUAL_ROWS = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more documents hold; n_chars follows the text."""
    return lines.without_repeated_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates; null ids come last.

    Rows are told apart by id and hash of the text.  Of rows equal in both, one stays.  Rows without words are like
    no other and all stay.
    """
    name = free_name(docs, "_row")
    keyed = docs.withColumn(name, F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("hash")))
    classes = materialize(jaccard.similarity_classes(keyed.select(F.col(name).alias("doc_id"), "text")), "classes")
    stay = classes.where((F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id")))
    equal = ((F.max("n_shingles") > 0) & (F.count("*") > 1)).alias("equal")
    rows = materialize(stay.groupBy(F.col("doc_id").alias(name)).agg(equal), "rows")
    kept = keyed.join(rows.where("not equal").select(name), name, "left_semi")
    if rows.where("equal").take(1):
        some = keyed.join(broadcast_if_small(rows.where("equal").select(name), EQUAL_ROWS), name, "left_semi")
        kept = kept.unionByName(some.dropDuplicates([name]))
    return kept.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    return mixing.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document of the mix, with the proof that they decode to its text."""
    path = tokenizer_file("byte_bpe_50k.json")
    both = bpe.decode_documents(bpe.encode_documents(docs, path), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("BPE encoding", token_stage),
]

#: Tokenizing and the quality verdict have no SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
