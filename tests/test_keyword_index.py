"""The keyword index: same results as a plain BM25, read without the corpus, segments skipped by their bounds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import search as S
from corpusloom.operators.keyword_index import KeywordIndex, SegmentScorer, build_keyword_index


def plain(queries, docs, k, lang=None):
    terms = {i: t.lower().split() for i, t in docs}
    n, mean = len(docs), sum(map(len, terms.values())) / len(docs)
    df = {}
    for ts in terms.values():
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = {}
    for q, text in queries:
        scores = []
        for i, ts in terms.items():
            if lang and lang[q] is not None and lang[q] != i % 3:
                continue
            s = sum(
                math.log(1 + (n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) * ts.count(t) * 2.2 / (ts.count(t) + 1.2 * (0.25 + 0.75 * len(ts) / mean))
                for t in set(text.lower().split())
                if t in ts
            )
            if s > 0:
                scores.append((-round(s, 6), i))
        out[q] = [i for _, i in sorted(scores)[:k]]
    return {q: ids for q, ids in out.items() if ids}


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(9)
    words = ["the"] * 30 + [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(400)]
    docs += [(500 + i, docs[3][1]) for i in range(20)] + [(600, ""), (601, "ALONE Été")]
    queries = [(q, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))) for q in range(60)] + [(90, "absent"), (91, "alone été the")]
    return docs, queries


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.chunk_id)
    return out


@pytest.mark.parametrize("partitions,batch", [(1, 10_000), (5, 10_000), (2, 16)])
def test_written_index_against_a_plain_version(spark, tmp_path, data, partitions, batch):
    docs, queries = data
    corpus = spark.createDataFrame(docs, "chunk_id long, text string").withColumn("lang", F.col("chunk_id") % 3).repartition(partitions)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        build_keyword_index(corpus, str(tmp_path / "index"), ("lang",))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    index = KeywordIndex(spark, str(tmp_path / "index"))
    assert index.segments.count() >= partitions and (batch > 16 or index.segments.count() > 20)
    asked = spark.createDataFrame(queries, "query_id long, text string").withColumn("lang", F.when(F.col("query_id") % 2 == 0, F.col("query_id") % 3))
    assert ranked(S.bm25_search(asked, index, 7)) == plain(queries, docs, 7)
    assert ranked(S.bm25_search(asked, index, 7, block_size=9)) == plain(queries, docs, 7)
    lang = {q: q % 3 if q % 2 == 0 else None for q, _ in queries}
    assert ranked(S.bm25_search(asked, index, 5, filters=("lang",))) == plain(queries, docs, 5, lang)


def test_a_search_reads_postings_only(spark, tmp_path, data):
    docs, queries = data
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        reads.add(1)
        return text

    corpus = spark.createDataFrame(docs, "chunk_id long, text string").withColumn("text", counted("text"))
    index = build_keyword_index(corpus, str(tmp_path / "index"))
    assert reads.value == len(docs)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    for _ in range(2):
        S.bm25_search(asked, index, 5).collect()
    assert reads.value == len(docs)
    few = index.of_terms(["w1", "w2"])._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [w1,w2])" in few


def test_segments_below_the_floor_are_skipped():
    import pandas as pd

    block = pd.DataFrame({"query_id": [1], "terms": [["a", "b"]]})
    scorer = SegmentScorer(block, ["a", "b"], np.array([1.0, 2.0]), (), 2, 1.2, 0.75, 10.0)
    best = S._Best(1, 2)
    touched = []
    weight = scorer.weight
    scorer.weight = lambda t, c, n: touched.append(np.size(c)) or weight(t, c, n)

    def segment(number, counts, length):
        n = len(counts)
        row = {"segment": number, "lengths": [length] * n, "ids": list(range(number * 10, number * 10 + n))}
        binary = lambda v: np.array(v, "<i4").tobytes()
        return row, iter([{"term": "b", "docs": binary(range(n)), "counts": binary(counts), "most": max(counts), "shortest": length}])

    scorer.score(*segment(0, [5, 6, 7], 5), best)
    floor = best.floor[0]
    assert floor > 0 and 3 in touched
    touched.clear()
    scorer.score(*segment(1, [1, 1, 1], 50), best)
    assert 3 not in touched and best.floor[0] == floor
    scorer.score(*segment(2, [9, 1, 1], 5), best)
    assert best.floor[0] >= floor and 3 in touched


def test_empty_corpora_and_queries(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "x")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "x")], "query_id long, text string")
    assert S.bm25_search(asked, corpus.limit(0), 3).collect() == []
    index = build_keyword_index(corpus.limit(0), str(tmp_path / "index"))
    assert S.bm25_search(asked, index, 3).collect() == []
    assert S.bm25_search(asked.limit(0), corpus, 3).collect() == []
