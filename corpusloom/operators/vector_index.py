"""Inverted-file vector index: vectors filed under their nearest centroid, with one byte for each residual component.

Centroids are fitted on a bounded sample, every vector is assigned.  The lists are written by list number in blocks of
at most ``BLOCK_ROWS`` vectors: ids, residual codes, and two bounds, the largest residual and the largest error of
a code.  A search reads codes of the lists nearest to each query, keeps a multiple of k candidates by approximate
score and scores these exactly.  The exact search takes the k-th of these scores as a floor and passes over all
blocks that can hold a vector above it: q v = q c + q (v - c) is at most q c plus the largest residual, and the score by
codes is wrong by no more than the largest error.  A list is cut into parts by ids, so that a centroid with a
third of all vectors is not one task's.

Defined cases: null vectors and vectors of another length than the index's are not indexed and not searched with; zero vectors score 0.
Copies that tie at the k-th place are all candidates of the exact search; ties go to the smallest id.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpusloom import rules
from corpusloom.functions.text import rounded
from corpusloom.operators.ranking import top_k
from corpusloom.operators.search import _unit_rows, cosine
from corpusloom.operators.task_search import QUERY_BLOCK, _Best, query_blocks
from corpusloom.session import broadcast_if_small, materialize

# Task code travels with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows the centroids are fitted on, at most; the rest of the table is only assigned.
SAMPLE_ROWS = 50_000
#: Centroids at most; they travel to the tasks.
MAX_LISTS = 16_384
BLOCK_ROWS = 4096
ROUNDS = 10
PROBES = 8
OVERSAMPLE = 8
#: Candidates that are broadcast to the corpus; more are joined by shuffle.
NEAR_ROWS = 500_000
#: Lists named in a filter of the scan; for more, tasks skip the others.
NAMED_LISTS = 1000
_STRIPE = 2048


class VectorIndex:
    """A written index: its folder and its centroids."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
        self.centroids = np.array([r.centroid for r in rows], np.float64)

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def blocks(self) -> DataFrame:
        """list, ids, codes (row after row), scale, radius (largest residual), error (largest of a code)."""
        return self.spark.read.parquet(f"{self.path}/lists")


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids by Lloyd's rounds on unit vectors; an empty one moves to the vector farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = sample[np.sort(rng.choice(len(sample), lists, replace=False))].copy()
    for _ in range(rounds):
        nearest, score = _nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        empty = np.flatnonzero(np.bincount(nearest, minlength=lists) == 0)
        sums[empty] = sample[np.argsort(score, kind="stable")[: len(empty)]]
        centres = _unit_rows(sums)
    return centres


def _nearest(units: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place, score = np.empty(len(units), np.int64), np.empty(len(units))
    for at in range(0, len(units), _STRIPE):
        s = units[at : at + _STRIPE] @ centres.T
        place[at : at + _STRIPE] = s.argmax(axis=1)
        score[at : at + _STRIPE] = s.max(axis=1)
    return place, score


def _units(column: pa.Array, dim: int) -> np.ndarray:
    return _unit_rows(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim))


def build_vector_index(
    corpus: DataFrame, path: str, vector: str = "embedding", lists: int | None = None, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS, seed: int = 7
) -> VectorIndex:
    """Write the index of ``corpus(chunk_id, vector)``; by default about the root of the number of vectors as lists.

    The sample is the rows of the smallest hashes of their ids.  The length of most of its vectors is the index's.
    """
    spark = corpus.sparkSession
    rows = corpus.where(F.col(vector).isNotNull()).select("chunk_id", F.col(vector).cast("array<float>").alias("vec"))
    sample = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample_rows).collect()
    if not sample:
        raise ValueError("no vectors to index")
    dim = int(pd.Series([len(r.vec) for r in sample]).mode().max())
    fit = _unit_rows(np.array([r.vec for r in sample if len(r.vec) == dim], np.float64))
    n = rows.where(F.size("vec") == dim).count()
    number = min(lists or round(math.sqrt(n)) or 1, MAX_LISTS, len(fit))
    centres = fit_centroids(fit, number, seed=seed)
    table = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(table, "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, _ = _nearest(_units(batch.column(1), dim), centres)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), batch.column(0), batch.column(1)], ["list", "chunk_id", "vec"])

    id_field = corpus.schema["chunk_id"]
    held = ST.StructType([ST.StructField("list", ST.IntegerType()), id_field, ST.StructField("vec", ST.ArrayType(ST.FloatType()))])
    assigned = materialize(rows.where(F.size("vec") == dim).mapInArrow(assign, held), "assigned")
    sizes = assigned.groupBy("list").agg(F.ceil(F.count("*") / block_rows).alias("parts"))  # at most MAX_LISTS rows
    dealt = assigned.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("chunk_id"), "parts"))
    ordered = dealt.repartition("list", "part").sortWithinPartitions("list", "part", "chunk_id").select("list", "chunk_id", "vec")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
            for a, b in ((s, min(s + block_rows, e)) for f, e in zip(cuts, cuts[1:]) for s in range(f, e, block_rows)):
                rest = _units(batch.column(2).slice(a, b - a), dim) - centres[place[a]]
                scale = max(np.abs(rest).max(initial=0) / 127, 1e-12)
                codes = np.rint(rest / scale).astype(np.int8)
                error = np.linalg.norm(rest - codes * scale, axis=1).max(initial=0)
                ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(1).slice(a, b - a))
                numbers = [pa.array([x], pa.float64()) for x in (scale, np.linalg.norm(rest, axis=1).max(initial=0), error)]
                yield pa.RecordBatch.from_arrays([pa.array([place[a]], pa.int32()), ids, pa.array([codes.tobytes()], pa.binary()), *numbers], ["list", "ids", "codes", "scale", "radius", "error"])

    out = ST.StructType(
        [ST.StructField("list", ST.IntegerType()), ST.StructField("ids", ST.ArrayType(id_field.dataType)), ST.StructField("codes", ST.BinaryType())]
        + [ST.StructField(x, ST.DoubleType()) for x in ("scale", "radius", "error")]
    )
    ordered.mapInArrow(pack, out).write.mode("overwrite").parquet(f"{path}/lists")
    return VectorIndex(spark, path)


def _candidates(index: VectorIndex, block: pd.DataFrame, matrix: np.ndarray, id_type: ST.DataType, k: int, probes: int, floors: np.ndarray | None) -> DataFrame:
    """(query_id, chunk_id, score by codes): the best k of the probed lists, or with ``floors`` all that may reach them."""
    centres, dim = index.centroids, index.dim
    near = matrix @ centres.T
    probed = np.zeros(near.shape, bool)
    if floors is None:
        some = min(probes, len(centres))
        np.put_along_axis(probed, np.argsort(-near, axis=1, kind="stable")[:, :some], True, axis=1)
    query_ids = block["query_id"].to_numpy()
    rows = index.blocks()
    wanted = np.flatnonzero(probed.any(axis=0)).tolist()
    if floors is None and len(wanted) <= NAMED_LISTS:
        rows = rows.where(F.col("list").isin(wanted))

    def scored(row: dict) -> tuple[np.ndarray, np.ndarray]:
        at = row["list"]
        asks = np.flatnonzero(probed[:, at] if floors is None else near[:, at] + row["radius"] >= floors)
        codes = np.frombuffer(row["codes"], np.int8).reshape(-1, dim).astype(np.float64)
        return asks, near[asks, at][:, None] + (matrix[asks] @ codes.T) * row["scale"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = _Best(len(query_ids), k), None
        for batch in batches:
            ids_of = batch.column("ids")
            kind = ids_of.type.value_type
            for i, row in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                asks, scores = scored(row)
                ids = ids_of[i].values.to_numpy(zero_copy_only=False)
                if floors is None:
                    fits = scores >= best.floor[asks][:, None]
                    q, v = np.nonzero(fits)
                    best.take(asks[q], ids[v], scores[q, v])
                else:
                    q, v = np.nonzero(scores + row["error"] >= floors[asks][:, None])
                    columns = [pa.array(query_ids[asks[q]]), pa.array(ids[v], type=kind), pa.array(scores[q, v])]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "chunk_id", "score"])
        if floors is None:
            yield from best.result(query_ids, kind)

    field = ST.StructField("chunk_id", rows.schema["ids"].dataType.elementType)
    return rows.mapInArrow(run, ST.StructType([ST.StructField("query_id", id_type), field, ST.StructField("score", ST.DoubleType())]))


def _rescored(near: DataFrame, queries: DataFrame, corpus: DataFrame, vector: str, k: int) -> DataFrame:
    """Exact scores of candidate pairs, the best k of each query."""
    asked = queries.select("query_id", F.col(vector).alias("qvec"))
    pairs = broadcast_if_small(near.select("query_id", "chunk_id"), NEAR_ROWS)
    held = corpus.select("chunk_id", F.col(vector).alias("cvec")).join(pairs, "chunk_id").join(broadcast_if_small(asked, QUERY_BLOCK), "query_id")
    return top_k(held.select("query_id", "chunk_id", rounded(cosine(F.col("qvec"), F.col("cvec"))).alias("score")), k)


def search_vector_index(
    queries: DataFrame, index: VectorIndex, corpus: DataFrame, k: int = rules.VECTOR_TOP_K, probes: int = PROBES, exact: bool = False, vector: str = "embedding"
) -> DataFrame:
    """Cosine top-k of ``queries(query_id, vector)``: approximate from ``probes`` lists, or ``exact``.

    ``corpus`` is the indexed table; only rows of candidates are scored in it.
    """
    asked = queries.where(F.col(vector).isNotNull() & (F.size(vector) == index.dim))
    id_type = queries.schema["query_id"].dataType
    found = []
    for block in query_blocks(asked, ["query_id", vector], QUERY_BLOCK):
        matrix = _unit_rows(np.stack([np.asarray(v, dtype=np.float64) for v in block[vector]]))
        mine = asked.join(broadcast_if_small(asked.sparkSession.createDataFrame(block[["query_id"]], ST.StructType([queries.schema["query_id"]])), QUERY_BLOCK), "query_id", "left_semi")
        near = materialize(top_k(_candidates(index, block, matrix, id_type, k * OVERSAMPLE, probes, None), k * OVERSAMPLE), "near")
        hits = _rescored(near, mine, corpus, vector, k)
        if exact:
            last = {r.query_id: r.score for r in hits.where(F.col("rank") == k).collect()}  # one row for each query of the block
            floors = np.array([last.get(q, -np.inf) for q in block["query_id"]]) - 2e-6
            near = materialize(_candidates(index, block, matrix, id_type, k, probes, floors), "near")
            hits = _rescored(near, mine, corpus, vector, k)
        found.append(hits)
    if not found:
        kinds = [queries.schema["query_id"], corpus.schema["chunk_id"], ST.StructField("score", ST.DoubleType()), ST.StructField("rank", ST.IntegerType())]
        return queries.sparkSession.createDataFrame([], ST.StructType(kinds))
    return reduce(DataFrame.unionByName, found)
