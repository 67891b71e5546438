"""Keyword index: postings of segments, written once, and BM25 over those of the queries' terms.

A segment is an Arrow batch of the corpus, or a run of its rows where they hold more than ``SEGMENT_TOKENS``.  It gives one row of documents (ids, lengths, filter values) and one row
for each of its terms: local document numbers, term frequencies, the largest frequency and the least length
among them.  Segments are written by the tasks that read the corpus, sorted by term inside: building shuffles nothing,
and a search reads the pages that hold its terms.

A search deals the queries' postings by segment and scores a segment at a time, in the order that a task holds them.  The
largest weight that a term can have in a segment follows from its largest frequency and least length; where the sum over a
query's terms is below the k-th score that the task has for it, the segment is skipped for that query.

Defined cases: null and empty texts count as documents without terms.  Repeated ids are documents of their own.
Scores are rounded to six digits before they are compared.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpusloom.functions.text import search_terms
from corpusloom.operators.task_search import _Best, pieces

# Task code travels with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens of a segment (one document at least): what a task that builds holds at once follows from it, not from the input.
SEGMENT_TOKENS = 1 << 21
#: Rows of postings that a search turns into Python values at once.
POSTING_ROWS = 256
#: Terms named in a filter, as many as the scan compares with its pages' bounds; more are joined.
NAMED_TERMS = 10
#: Terms of the queries that are broadcast to the postings; more are joined by shuffle.
SMALL_TERMS = 500_000


def bm25_idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


class KeywordIndex:
    """A written index."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        rows = self.spark.read.parquet(path)
        self.segments = rows.where("term is null").select("segment", "ids", "lengths", *[c for c in rows.columns if c.startswith("f_")])
        self.postings = rows.where("term is not null").select("segment", "term", "docs", "counts", "most", "shortest")
        n, total = self.segments.agg(F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
        self.n, self.mean_length = n or 0, (total or 0) / n if n and total else 1.0

    def documents(self) -> DataFrame:
        return self.segments.select(F.explode("ids").alias("chunk_id"))

    def of_terms(self, terms: list[str]) -> DataFrame:
        """The postings of ``terms``."""
        if len(terms) <= NAMED_TERMS:
            return self.postings.where(F.col("term").isin(terms))
        named = self.spark.createDataFrame(pd.DataFrame({"term": terms}))
        return self.postings.join(F.broadcast(named) if len(terms) <= SMALL_TERMS else named, "term", "left_semi")

    def search(self, block: pd.DataFrame, filters: Sequence[str], k: int, k1: float, b: float, id_type: ST.DataType) -> DataFrame:
        """(query_id, chunk_id, score): at least the best k of each query of ``block(query_id, terms, filters)``."""
        field = ST.StructField("chunk_id", self.segments.schema["ids"].dataType.elementType)
        out = ST.StructType([ST.StructField("query_id", id_type), field, ST.StructField("score", ST.DoubleType())])
        terms = sorted({t for ts in block["terms"] for t in ts})
        if not terms or not self.n:
            return self.spark.createDataFrame([], out)
        held = self.of_terms(terms)
        counts = held.groupBy("term").agg(F.sum(F.octet_length("docs") / 4).alias("df")).toPandas().set_index("term")["df"]  # one row for each term of the block
        df = counts.reindex(terms).fillna(0).to_numpy(dtype=float)
        idf = np.log(1 + (self.n - df + 0.5) / (df + 0.5))
        scorer = SegmentScorer(block, terms, idf, filters, k, k1, b, self.mean_length)
        stream = self.segments.unionByName(held, allowMissingColumns=True).repartition("segment").sortWithinPartitions("segment", F.col("term").asc_nulls_first())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, kind = _Best(len(scorer.needs), k), None

            def rows() -> Iterator[dict]:
                nonlocal kind
                for batch in batches:
                    kind = batch.schema.field("ids").type.value_type
                    for at in range(0, batch.num_rows, POSTING_ROWS):
                        yield from batch.slice(at, POSTING_ROWS).to_pylist()

            for _, parts in groupby(rows(), lambda r: r["segment"]):
                scorer.score(next(parts), parts, best)
            yield from best.result(scorer.query_ids, kind)

        return stream.mapInArrow(run, out)


class SegmentScorer:
    """Scores the documents of one segment for a block of queries."""

    def __init__(self, block: pd.DataFrame, terms: list[str], idf: np.ndarray, filters: Sequence[str], k: int, k1: float, b: float, mean: float) -> None:
        self.query_ids, self.k1, self.b, self.mean = block["query_id"].to_numpy(), k1, b, mean
        number = {t: i for i, t in enumerate(terms)}
        self.idf = dict(zip(terms, idf.tolist()))
        self.needs = [list(dict.fromkeys(ts)) for ts in block["terms"]]
        self.asks: dict[str, list[int]] = {}
        for q, ts in enumerate(self.needs):
            for t in ts:
                self.asks.setdefault(t, []).append(q)
        self.order = number
        self.slots = [(f, [None if v is None or v != v else v for v in block[f].tolist()]) for f in filters]

    def weight(self, term: str, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.idf[term] * counts * (self.k1 + 1) / (counts + self.k1 * (1 - self.b + self.b * lengths / self.mean))

    def score(self, segment: dict, postings: Iterator[dict], best: _Best) -> None:
        lengths, ids = np.array(segment["lengths"], float), np.array(segment["ids"])
        weights, bound = {}, {}
        for row in postings:
            term = row["term"]
            docs = np.frombuffer(row["docs"], "<i4")
            weights[term] = docs, row
            bound[term] = float(self.weight(term, np.array(float(row["most"])), np.array(float(row["shortest"]))))
        queries = sorted({q for t in weights for q in self.asks.get(t, ())})
        ready: dict[str, np.ndarray] = {}
        fits = {f: segment["f_" + f] for f, _ in self.slots}
        masks: dict[tuple, np.ndarray] = {}
        for q in queries:
            mine = sorted((t for t in self.needs[q] if t in weights), key=self.order.__getitem__)
            # rounding can lift a score by half a millionth
            if sum(bound[t] for t in mine) + 1e-6 < best.floor[q]:
                continue
            for t in mine:
                if t not in ready:
                    docs, row = weights[t]
                    ready[t] = self.weight(t, np.frombuffer(row["counts"], "<i4").astype(float), lengths[docs])
            total = np.zeros(len(lengths))
            for t in mine:
                total[weights[t][0]] += ready[t]
            wanted = tuple((f, values[q]) for f, values in self.slots if values[q] is not None)
            if wanted:
                if wanted not in masks:
                    masks[wanted] = np.logical_and.reduce([np.array([v == w for v in fits[f]], bool) for f, w in wanted])
                total = np.where(masks[wanted], total, 0.0)
            at = np.flatnonzero(total > 0)
            scores = np.round(total[at], 6)
            good = scores >= best.floor[q]
            at, scores = at[good], scores[good]
            if len(at) > best.k:
                top = np.lexsort((ids[at], -scores))[: best.k]
                at, scores = at[top], scores[top]
            best.take(np.full(len(at), q), ids[at], scores)
            if len(at) == best.k:
                best.floor[q] = max(best.floor[q], scores.min())


def build_keyword_index(corpus: DataFrame, path: str, filters: Sequence[str] = (), vocabulary: set[str] | None = None) -> KeywordIndex:
    """Write the postings of ``corpus(chunk_id, text, *filters)``, of all terms or of those in ``vocabulary``."""
    spark = corpus.sparkSession
    wanted = None if vocabulary is None else pa.array(sorted(vocabulary), pa.string())
    id_type = corpus.schema["chunk_id"].dataType
    filter_types = [corpus.schema[f].dataType for f in filters]
    fields = [("segment", ST.LongType()), ("term", ST.StringType()), ("docs", ST.BinaryType()), ("counts", ST.BinaryType()), ("most", ST.IntegerType()), ("shortest", ST.IntegerType())]
    fields += [("ids", ST.ArrayType(id_type)), ("lengths", ST.ArrayType(ST.IntegerType()))] + [("f_" + f, ST.ArrayType(t)) for f, t in zip(filters, filter_types)]
    out = ST.StructType([ST.StructField(n, t) for n, t in fields])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        tokens = lambda batch: batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for number, batch in enumerate(pieces(batches, tokens, SEGMENT_TOKENS)):
            n = batch.num_rows
            ids, lists = batch.column(0), batch.column(1)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
            filter_values = [batch.column(2 + i) for i in range(len(filters))]
            whole = lambda c: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c)  # noqa: E731, B023
            flat = lists.flatten()
            if wanted is None:
                encoded = flat.dictionary_encode()
                names, codes = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                known = np.ones(len(codes), bool)
            else:
                names = wanted
                codes = pa.compute.index_in(flat, value_set=wanted.cast(flat.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                known = codes >= 0
            doc = np.repeat(np.arange(n), lengths)[known]
            rank = np.empty(len(names), np.int64)
            order = np.argsort(np.array(names.to_pylist(), object)) if len(names) else np.empty(0, np.int64)
            rank[order] = np.arange(len(names))
            cell, counts = np.unique(rank[codes[known]] * n + doc, return_counts=True)
            term, local = cell // max(n, 1), cell % max(n, 1)
            starts = np.flatnonzero(np.diff(term, prepend=-1))
            ends = np.append(starts, len(term)).astype(np.int32) * 4

            def packed(values: np.ndarray) -> pa.Array:
                return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values, "<i4"))])  # noqa: B023

            m = len(starts)
            most = np.maximum.reduceat(counts, starts) if m else np.empty(0)
            shortest = np.minimum.reduceat(lengths[local], starts) if m else np.empty(0)
            segment = pa.array(np.full(m, base + number), pa.int64())
            nothing = lambda kind: pa.nulls(m, kind)  # noqa: E731, B023
            documents = [whole(ids), whole(pa.array(lengths, pa.int32())), *(whole(c) for c in filter_values)]
            names_of = [f[0] for f in fields]
            first = [pa.array([base + number], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32())]
            yield pa.RecordBatch.from_arrays(first + documents, names_of)
            if m:
                found = names.take(pa.array(order[term[starts]])).cast(pa.string())
                rows = [segment, found, packed(local), packed(counts), pa.array(most, pa.int32()), pa.array(shortest, pa.int32())]
                yield pa.RecordBatch.from_arrays(rows + [nothing(d.type) for d in documents], names_of)

    tokens = corpus.select("chunk_id", search_terms("text").alias("terms"), *filters)
    tokens.mapInArrow(segments, out).write.mode("overwrite").parquet(path)
    return KeywordIndex(spark, path)
