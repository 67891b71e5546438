"""The inverted-file index: exact search against all pairs, recall of the probes, bounded blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import search as S
from corpusloom.operators import vector_index as I


def vectors(spark, n, dim, seed, clusters=40, noise=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    x = centres[rng.integers(0, clusters, n)] + noise * rng.standard_normal((n, dim))
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def tables(spark, rows, queries):
    kind = "{} long, embedding array<float>"
    return spark.createDataFrame(rows, kind.format("chunk_id")).repartition(4), spark.createDataFrame(queries, kind.format("query_id"))


def ranked(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.mark.parametrize("n,dim", [(600, 12), (1500, 24)])
def test_exact_search_against_all_pairs(spark, tmp_path, n, dim):
    rows = vectors(spark, n, dim, n)
    rows += [(n + i, rows[3][1]) for i in range(40)] + [(n + 100, [0.0] * dim), (n + 101, None)]
    queries = [(i, v) for i, v in vectors(spark, 30, dim, n, noise=1.0)] + [(50, rows[3][1]), (51, None), (52, [0.0] * dim), (53, [1.0])]
    corpus, asked = tables(spark, rows, queries)
    index = I.build_vector_index(corpus, str(tmp_path / "index"), block_rows=32)
    good = asked.where(F.size("embedding") == dim)
    want = ranked(S.vector_search(good, corpus, 5))
    assert ranked(I.search_vector_index(asked, index, corpus, 5, exact=True)) == want
    assert ranked(I.search_vector_index(asked, I.VectorIndex(spark, str(tmp_path / "index")), corpus, 5, probes=len(index.centroids), exact=True)) == want
    sizes = [len(r.ids) for r in index.blocks().collect()]
    assert max(sizes) <= 32 and sum(sizes) == n + 41


@pytest.mark.parametrize("n", [1500, 6000])
def test_recall_of_the_probes(spark, tmp_path, n):
    corpus, asked = tables(spark, vectors(spark, n, 32, 5), vectors(spark, 80, 32, 5)[40:])
    index = I.build_vector_index(corpus, str(tmp_path / "index"))
    want = {(q, c) for q, _, c, _ in ranked(S.vector_search(asked, corpus, 10))}
    got = {(q, c) for q, _, c, _ in ranked(I.search_vector_index(asked, index, corpus, 10))}
    assert len(got & want) / len(want) >= 0.9


def test_a_list_with_most_vectors_is_cut(spark, tmp_path):
    rows = [(i, [1.0, float(i % 7) / 100, 0.0]) for i in range(900)] + [(1000 + i, [0.0, 0.0, 1.0]) for i in range(9)]
    corpus, asked = tables(spark, rows, [(1, [0.0, 0.1, 1.0])])
    index = I.build_vector_index(corpus, str(tmp_path / "index"), lists=2, block_rows=50)
    assert max(len(r.ids) for r in index.blocks().collect()) <= 50
    assert [c for _, _, c, _ in ranked(I.search_vector_index(asked, index, corpus, 3, exact=True))] == [1000, 1001, 1002]


def test_no_queries(spark, tmp_path):
    corpus, asked = tables(spark, vectors(spark, 20, 4, 1), [(1, [1.0, 0.0, 0.0, 0.0])])
    index = I.build_vector_index(corpus, str(tmp_path / "index"))
    assert I.search_vector_index(asked.limit(0), index, corpus, 3).collect() == []
    with pytest.raises(ValueError):
        I.build_vector_index(corpus.limit(0), str(tmp_path / "none"))
