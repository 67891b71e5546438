"""What a search task holds at once does not follow from the batches it is given."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.operators import keyword_index as K
from corpusloom.operators import search as S
from corpusloom.operators.task_search import _Best, pieces


def test_pieces_hold_every_row_once():
    rng = np.random.default_rng(1)
    sizes = np.concatenate((rng.integers(0, 30, 500), [400, 0, 0, 250], rng.integers(0, 30, 100)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(sizes))), pa.array(sizes)], ["id", "n"])
    got = list(pieces(iter([batch, batch.slice(0, 0), batch]), lambda b: b.column(1).to_numpy(), 100))
    assert [i for p in got for i in p.column(0).to_pylist()] == 2 * list(range(len(sizes)))
    assert all(p.num_rows == 1 or sum(p.column(1).to_pylist()) <= 100 for p in got)


def test_many_short_lists_take_little_memory():
    """20,000 lists of five rows, as segments give them; a frame for each took over 50 MB."""
    best, rng = _Best(200, 5), np.random.default_rng(2)
    rows = [(i % 200, rng.integers(0, 10**6, 5), np.round(rng.random(5), 2)) for i in range(20_000)]
    tracemalloc.start()
    for q, ids, scores in rows:
        best.take(np.full(5, q), ids, scores)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    (found,) = best.result(np.arange(200), pa.int64())
    for q in (0, 77, 199):
        want = sorted((-s, i) for p, ids, scores in rows if p == q for i, s in zip(ids, scores))[:5]
        assert [(-r["score"], r["chunk_id"]) for r in found.to_pylist() if r["query_id"] == q] == want


def test_a_long_batch_becomes_several_segments(spark, tmp_path, monkeypatch):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.col("id") % 40 + 1), lambda i: F.concat(F.lit("w"), (i * F.col("id")) % 97)))
    corpus = spark.range(400, numPartitions=1).select(F.col("id").alias("chunk_id"), words.alias("text"))
    queries = corpus.where("chunk_id % 50 = 7").select(F.col("chunk_id").alias("query_id"), "text")
    whole = sorted(S.bm25_search(queries, K.build_keyword_index(corpus, f"{tmp_path}/whole"), 10).collect())
    monkeypatch.setattr(K, "SEGMENT_TOKENS", 500)
    index = K.build_keyword_index(corpus, f"{tmp_path}/cut")
    assert index.segments.select(F.max(F.aggregate("lengths", F.lit(0), lambda a, x: a + x))).first()[0] <= 500
    assert index.n == 400 and sorted(S.bm25_search(queries, index, 10).collect()) == whole
