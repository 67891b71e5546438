"""Line deduplication over a corpus.

Lines (text split at the line end) are normalised to keys, keys are hashed, and the documents that hold a
key are counted, each once.  Lines whose key at least ``min_docs`` documents hold are dropped in every
document; the others are put together again by position.

Defined cases: a null or empty text is one empty line.  Every row counts as a document of its own, so
repeated rows count each; rows with equal id and text get the same result.  Keys shorter than
``min_points`` code points are never dropped.  Other columns are not looked at.

Keys are compared by two hashes, 96 bits in all.  The hashes of each document's lines are written once, as
counting and dropping both read them.  A line that a third of all documents hold is counted by partial
sums; finding its documents again is a semi-join, whose large side the adaptive plan can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACES, ascii_lower, free_name
from corpusloom.session import materialize

MIN_DOCS = 10
MIN_POINTS = 1


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _deduplicated(docs: DataFrame, min_docs: int, min_points: int) -> tuple[DataFrame, str, str]:
    """The rows of ``docs`` with the kept lines as text, and the names of two more columns: lines before, lines dropped."""
    version, split, gone, n_lines, n_dropped = (free_name(docs, x) for x in ("_version", "_lines", "_dropped", "_n_lines", "_n_dropped"))

    def hashes(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.char_length(key) >= min_points, F.struct(F.xxhash64(key).alias("h1"), F.hash(key).alias("h2")))

    keyed = docs.select("doc_id", F.xxhash64("text").alias("version"), F.transform(lines_of(F.col("text")), hashes).alias("keys"))
    keyed = materialize(keyed, "line-keys")
    held = keyed.select(F.explode(F.array_distinct("keys")).alias("key")).where("key is not null").select("key.h1", "key.h2")
    repeated = held.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")
    placed = keyed.select("doc_id", "version", F.posexplode("keys").alias("pos", "key")).where("key is not null")
    dropped = (
        placed.select("doc_id", "version", "pos", "key.h1", "key.h2")
        .join(repeated, ["h1", "h2"], "left_semi")
        .groupBy("doc_id", "version")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    d, x = docs.withColumn(version, F.xxhash64("text")).alias("d"), dropped.alias("x")
    same = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col(f"d.{version}") == F.col("x.version"))
    others = [F.col(f"d.`{c}`") for c in docs.columns if c != "text"]
    joined = d.join(x, same, "left").select(*others, lines_of(F.col("d.text")).alias(split), F.coalesce("x.dropped", F.array().cast("array<int>")).alias(gone))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    text = F.array_join(F.transform(kept, lambda i: F.get(F.col(split), i)), "\n")
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, F.size(split).cast("long").alias(n_lines), F.size(gone).cast("long").alias(n_dropped)), n_lines, n_dropped


def without_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_points: int = MIN_POINTS) -> DataFrame:
    """The rows of ``docs`` with all columns, text replaced by the kept lines."""
    return _deduplicated(docs, min_docs, min_points)[0].select(*docs.columns)


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_points: int = MIN_POINTS) -> DataFrame:
    """doc_id, text (of the kept lines), n_lines (before dropping) and n_dropped of each row of ``docs``."""
    found, n_lines, n_dropped = _deduplicated(docs.select("doc_id", "text"), min_docs, min_points)
    return found.select("doc_id", "text", F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"))
