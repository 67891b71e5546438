"""Many queries against a whole corpus: keyword search, vector search, filters and fallbacks.

Both searches have the same shape.  A block of queries (its size checked) travels to the tasks, every
task scores its own part of the corpus (texts through their postings, see ``keyword_index``) and keeps k
rows per query, and only those rows and the queries' postings are shuffled.  The corpus itself is never
shuffled and no query x corpus pair leaves a task.  More queries than one block holds are answered block
by block.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpusloom import rules
from corpusloom.functions.text import rounded, search_terms, word_trigrams
from corpusloom.operators.keyword_index import KeywordIndex, bm25_idf, build_keyword_index
from corpusloom.operators.ranking import top_k, weighted_rrf
from corpusloom.operators.task_search import QUERY_BLOCK, _Best, query_blocks
from corpusloom.session import broadcast_if_small, materialize, scratch_path

# Task code travels with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYWORD_BLOCK = 32_768  # keyword queries answered in one pass over the corpus's terms
PASS_BYTES = 64 << 20  # query vectors that one pass over the corpus answers
_CELLS = 1 << 18  # scores held at once by a task


# --- per-task scoring ----------------------------------------------------------------------------


class _Group:
    """Queries with the same filter values: rows are tested once for all of them and only rows that fit are scored."""

    def __init__(self, part: pd.DataFrame, filters: Sequence[str]) -> None:
        self.ids = part["query_id"].to_numpy()
        self.matrix = _unit_rows(np.stack([np.asarray(v, dtype=np.float64) for v in part["vec"]]))
        first = part.iloc[0]
        self.wanted = [(f, first[f]) for f in filters if not pd.isna(first[f])]

    def rows(self, batch: pa.RecordBatch) -> np.ndarray:
        """Places of the rows that have the filter values."""
        fits = np.ones(batch.num_rows, bool)
        for name, value in self.wanted:
            column = batch.column(name)
            fits &= pc.equal(column, pa.scalar(value, column.type)).fill_null(False).to_numpy(zero_copy_only=False)
        return np.flatnonzero(fits)


def _vector_pass(corpus: DataFrame, groups: list[_Group], k: int, id_type: ST.DataType) -> DataFrame:
    """One pass over the corpus for all groups: k rows per query and task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = [_Best(len(g.ids), k) for g in groups], None
        for batch in batches:
            kind = batch.schema.field("chunk_id").type
            units, ids = _batch_units(batch, groups[0].matrix.shape[1]), batch.column("chunk_id").to_numpy(zero_copy_only=False)
            for group, found in zip(groups, best):
                rows, step = group.rows(batch), max(1, _CELLS // len(group.ids))
                for part in (rows[i : i + step] for i in range(0, len(rows), step)):
                    scores = np.round(units[part] @ group.matrix.T, 6)
                    found.add(scores, np.ones(scores.shape, bool), ids[part])
        for group, found in zip(groups, best):
            yield from found.result(group.ids, kind)

    return corpus.mapInArrow(task, _hit_schema(corpus, id_type))


def _hit_schema(corpus: DataFrame, id_type: ST.DataType) -> ST.StructType:
    return ST.StructType([ST.StructField("query_id", id_type), corpus.schema["chunk_id"], ST.StructField("score", ST.DoubleType())])


def _no_hits(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    fields = [queries.schema["query_id"], corpus.schema["chunk_id"]]
    schema = ST.StructType([*fields, ST.StructField("score", ST.DoubleType())])
    return queries.sparkSession.createDataFrame([], schema)


# --- keyword search ------------------------------------------------------------------------------


def bm25_search(
    queries: DataFrame,
    corpus: DataFrame | KeywordIndex,
    k: int = rules.CANDIDATES,
    k1: float = rules.BM25_K1,
    b: float = rules.BM25_B,
    filters: Sequence[str] = (),
    block_size: int = KEYWORD_BLOCK,
) -> DataFrame:
    """Okapi BM25 over ``text``: ``queries(query_id, text, *filters)`` x ``corpus(chunk_id, text, *filters)``.

    Distinct query terms count once.  The corpus is read and tokenized once and its postings are written; after that
    only the queries' postings are read.  A ``KeywordIndex`` stands for a corpus whose postings are there already.
    Without one, and with queries of one block, only the postings of their terms are written.
    """
    asked = queries.select("query_id", *filters, F.array_distinct(search_terms("text")).alias("terms"))
    blocks = query_blocks(asked, ["query_id", *filters, "terms"], block_size)
    first = next(blocks, None)
    if first is None:
        return top_k(_no_hits(queries, corpus.documents() if isinstance(corpus, KeywordIndex) else corpus), k)
    second = next(blocks, None)
    if isinstance(corpus, KeywordIndex):
        index = corpus
    else:
        words = {t for terms in first["terms"] for t in terms} if second is None else None
        index = build_keyword_index(corpus, scratch_path(queries.sparkSession, "postings"), filters, vocabulary=words)
    every = chain([first], [] if second is None else [second], blocks)
    found = [index.search(block, filters, k, k1, b, queries.schema["query_id"].dataType) for block in every]
    return top_k(reduce(DataFrame.unionByName, found), k)


# --- vector search -------------------------------------------------------------------------------


def vector_search(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = rules.VECTOR_TOP_K,
    filters: Sequence[str] = (),
    vector: str = "embedding",
    block_size: int = QUERY_BLOCK,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Exact cosine top-k: ``queries(query_id, embedding)`` x ``corpus(chunk_id, embedding)``.

    Blocks of queries are fetched one by one and answered together, up to ``pass_bytes`` of query vectors in one pass over
    the corpus.  Queries of equal filter values share one test of the rows.  A corpus vector of another length than
    the queries' stops the search with an error.
    """
    rows = corpus.filter(F.col(vector).isNotNull()).select("chunk_id", *filters, F.col(vector).alias("vec"))
    asked = queries.filter(F.col(vector).isNotNull()).select("query_id", *filters, F.col(vector).alias("vec"))
    id_type = queries.schema["query_id"].dataType
    found, groups, held = [], [], 0
    for block in query_blocks(asked, ["query_id", *filters, "vec"], block_size):
        parts = [part for _, part in block.groupby(list(filters), dropna=False, sort=False)] if filters else [block]
        groups += [_Group(part, filters) for part in parts]
        held += sum(g.matrix.nbytes for g in groups[-len(parts) :])
        if held >= pass_bytes:
            found.append(_vector_pass(rows, groups, k, id_type))
            groups, held = [], 0
    if groups:
        found.append(_vector_pass(rows, groups, k, id_type))
    hits = reduce(DataFrame.unionByName, found) if found else _no_hits(queries, corpus)
    return top_k(hits, k)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm > 0, norm, 1.0)


def _batch_units(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    lengths = pc.list_value_length(batch.column("vec"))
    if batch.num_rows and pc.any(pc.not_equal(lengths, dim)).as_py():
        raise ValueError(f"vectors of other lengths than the queries' {dim}")
    return _unit_rows(batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dim))


def _signature_udf(dim: int, bits: int, tables: int, seed: int):
    planes = np.random.default_rng(seed).standard_normal((dim, bits * tables))
    powers = 2 ** np.arange(bits)

    @F.pandas_udf("array<int>")
    def signature(vectors: pd.Series) -> pd.Series:
        matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
        side = (matrix @ planes > 0).reshape(len(matrix), tables, bits)
        return pd.Series(list((side * powers).sum(axis=2).astype(np.int32)))

    return signature


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors on one row."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(d(x), d(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def lsh_candidates(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = rules.VECTOR_TOP_K,
    bits: int = 6,
    tables: int = 12,
    dim: int = 64,
    seed: int = 7,
    vector: str = "embedding",
) -> DataFrame:
    """Approximate vector search: equal random-hyperplane signatures in any table, then exact scores.

    An equi-join on (table, bucket) finds the candidates.  A pair that agrees in several tables is kept
    only for the first of them, which needs no de-duplicating shuffle.  Query signatures are broadcast
    after a check of their number; beyond it both sides are shuffled by bucket and AQE splits the
    partitions of over-full buckets.
    """
    sign = _signature_udf(dim, bits, tables, seed)

    def bucketed(df: DataFrame, key: str, prefix: str) -> DataFrame:
        rows = df.filter(F.col(vector).isNotNull()).select(
            key, F.col(vector).alias(f"{prefix}vec"), sign(vector).alias(f"{prefix}sig")
        )
        return rows.select("*", F.posexplode_outer(f"{prefix}sig").alias("table", "bucket"))

    asked = broadcast_if_small(bucketed(queries, "query_id", "q"), QUERY_BLOCK * tables)
    pairs = bucketed(corpus, "chunk_id", "c").join(asked, ["table", "bucket"])
    agree = F.zip_with("qsig", "csig", lambda x, y: x == y)
    first = pairs.filter(F.array_position(agree, True) == F.col("table") + 1)
    return top_k(first.select("query_id", "chunk_id", rounded(cosine(F.col("qvec"), F.col("cvec"))).alias("score")), k)


# --- compositions --------------------------------------------------------------------------------


def hybrid_search(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = rules.CANDIDATES,
    alpha: float | None = None,
    filters: Sequence[str] = (),
) -> DataFrame:
    """Both branches with the same filters, fused by weighted reciprocal rank.

    The result (at most k rows per query) is written to the shared folder: later steps read it several
    times, and its true size lets them broadcast it instead of shuffling the corpus.
    """
    dense = vector_search(queries, corpus, k, filters)
    sparse = bm25_search(queries, corpus, k, filters=filters)
    return materialize(weighted_rrf(dense, sparse, alpha, k), "hybrid-hits")


def filter_fallback(
    queries: DataFrame, search: Callable[[DataFrame], DataFrame], filters: Sequence[str]
) -> DataFrame:
    """Search with filters; queries that had a filter and found nothing are searched again without.

    The first result (at most k rows per query) is written to the shared folder, so that finding the
    unanswered queries does not repeat the search.  Adds ``fallback``.
    """
    first = materialize(search(queries), "filtered-hits")
    has_slot = reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in filters])
    unanswered = queries.filter(has_slot).join(first.select("query_id").distinct(), "query_id", "left_anti")
    open_queries = unanswered.select(
        *[F.lit(None).cast(unanswered.schema[c].dataType).alias(c) if c in filters else F.col(c) for c in unanswered.columns]
    )
    second = search(open_queries)
    return first.withColumn("fallback", F.lit(False)).unionByName(second.withColumn("fallback", F.lit(True)))


def no_context_gate(queries: DataFrame, ranked: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """One row per query: its answer, or the fixed reply when nothing was retrieved."""
    hits = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sources"))
    joined = queries.join(hits, "query_id", "left")
    given = F.lit(None).cast("string")
    if answers is not None:
        joined = joined.join(answers.select("query_id", "answer"), "query_id", "left")
        given = F.col("answer")
    empty = F.col("n_sources").isNull()
    return joined.select(
        "query_id",
        F.when(empty, F.lit(rules.NO_CONTEXT_ANSWER)).otherwise(given).alias("answer"),
        F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
    )


def trigram_scores(pairs: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Deterministic pair scorer for reranking: trigram recall of the query in the chunk.

    Work grows with the candidates (a bounded number per query): shingles are built once per distinct
    candidate chunk and once per query, then compared pair by pair.
    """
    wanted = queries.select("query_id", word_trigrams("text").alias("wanted"))
    ids = pairs.select("chunk_id").distinct()
    held = corpus.select("chunk_id", "text").join(ids, "chunk_id", "left_semi").select("chunk_id", word_trigrams("text").alias("held"))
    rows = pairs.select("query_id", "chunk_id").join(wanted, "query_id").join(held, "chunk_id")
    share = F.size(F.array_intersect("wanted", "held")) / F.nullif(F.size("wanted"), F.lit(0))
    return rows.select("query_id", "chunk_id", rounded(F.coalesce(share, F.lit(0.0))).alias("score"))


def source_list(reranked: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row per source: index, document, label, snippet, score and full text.

    ``corpus(chunk_id, text[, document_id][, filename])``.
    """
    none = F.lit(None)
    doc = F.col("document_id") if "document_id" in corpus.columns else none.cast("string")
    name = F.col("filename") if "filename" in corpus.columns else none.cast("string")
    details = corpus.select("chunk_id", doc.alias("document_id"), F.nullif(name, F.lit("")).alias("filename"), "text")
    text = F.regexp_replace(F.col("text"), r"(?U)^\s+|\s+$", "")
    label = F.coalesce(
        F.col("filename"),
        F.concat(F.lit(rules.SOURCE_WORDING["numbered"]), F.col("document_id").cast("string")),
        F.lit(rules.SOURCE_WORDING["generic"]),
    )
    return reranked.join(details, "chunk_id").select(
        "query_id",
        F.col("rank").alias("source_index"),
        "chunk_id",
        "document_id",
        "filename",
        label.alias("label"),
        F.substring(text, 1, rules.SNIPPET_CHARS).alias("snippet"),
        F.col("score").cast("double").alias("score"),
        text.alias("text"),
    )


def context_block(sources: DataFrame) -> DataFrame:
    """The numbered context of each query: at most top-n sources, in index order."""
    line = F.concat(
        F.lit("["),
        F.col("source_index").cast("string"),
        F.lit("] (" + rules.SOURCE_WORDING["prefix"]),
        F.col("label"),
        F.lit(")\n"),
        F.col("text"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("source_index", line.alias("line"))))
    return sources.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["line"]), "\n\n").alias("context")
    )


def explode_subqueries(
    plans: DataFrame, parts: str = "parts", original: str = "text", limit: int = rules.MAX_SUBQUERIES
) -> DataFrame:
    """Proposed sub-queries, trimmed and without blanks, at most ``limit``; the question itself if none."""
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    kept = F.filter(F.transform(F.col(parts), strip), lambda x: x.isNotNull() & (x != ""))
    chosen = F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.slice(kept, 1, limit)).otherwise(F.array(F.col(original)))
    return plans.select("query_id", F.posexplode_outer(chosen).alias("sub_no", "subquery"))


def refine_rounds(
    queries: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    grades: DataFrame,
    max_rounds: int = rules.MAX_ROUNDS,
) -> DataFrame:
    """Search again with a refined query where the last result was graded insufficient.

    ``grades(query_id, round, sufficient, refined_query)``.  A query goes on only if its result is not
    empty and the refined text is not blank and differs.  The last round's result wins.  Every round is
    written to the shared folder; the loop runs over the (bounded) number of rounds, never over rows.
    """
    current, done = queries, []
    for turn in range(1, max(1, max_rounds) + 1):
        hits = materialize(search(current), f"round{turn}")
        if turn == max_rounds:
            done.append(hits.withColumn("rounds", F.lit(turn)))
            break
        verdict = grades.filter((F.col("round") == turn) & ~F.coalesce("sufficient", F.lit(True))).select(
            "query_id", F.regexp_replace("refined_query", r"(?U)^\s+|\s+$", "").alias("_refined")
        )
        again = (
            current.join(verdict, "query_id")
            .filter((F.col("_refined") != "") & (F.col("_refined") != F.col("text")))
            .join(hits.select("query_id").distinct(), "query_id", "left_semi")
        )
        again = materialize(again.withColumn("text", F.col("_refined")).drop("_refined"), f"refined{turn}")
        done.append(hits.join(again.select("query_id"), "query_id", "left_anti").withColumn("rounds", F.lit(turn)))
        if again.isEmpty():
            break
        current = again
    return reduce(DataFrame.unionByName, done)
