import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluation as E
from corpusloom.operators import metadata as M
from corpusloom.operators import ranking as R
from corpusloom.operators import relevance as L
from corpusloom.operators import search as S


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    texts = [(i, " ".join(rng.choices(vocab, weights=range(30, 0, -1), k=rng.randint(3, 40)))) for i in range(120)]
    asked = [(q, " ".join(rng.choices(vocab, k=4))) for q in range(9)]
    return (
        spark.createDataFrame(asked, "query_id bigint, text string").cache(),
        spark.createDataFrame(texts, "chunk_id bigint, text string").repartition(5).cache(),
        asked,
        texts,
    )


def brute_bm25(asked, texts, k):
    docs = {i: re.findall(r"\w+", t) for i, t in texts}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for q, text in asked:
        scores = {}
        for term in set(text.split()):
            df = sum(term in d for d in docs.values())
            for i, d in docs.items():
                tf = d.count(term)
                if tf:
                    w = math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
                    scores[i] = scores.get(i, 0) + w
        out[q] = [i for i, _ in sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["chunk_id"])
    return out


def test_bm25_against_brute_force(small):
    queries, corpus, asked, texts = small
    assert lists(S.bm25_search(queries, corpus, 7)) == brute_bm25(asked, texts, 7)


def test_bm25_in_query_blocks(small):
    queries, corpus, asked, texts = small
    assert lists(S.bm25_search(queries, corpus, 7, block_size=2)) == brute_bm25(asked, texts, 7)


def test_bm25_without_any_hit(spark, small):
    nothing = spark.createDataFrame([(1, "zzz"), (2, "...")], "query_id bigint, text string")
    assert S.bm25_search(nothing, small[1], 5).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    corpus = rng.standard_normal((300, 16)).astype("float32")
    asked = corpus[:20] + 0.1 * rng.standard_normal((20, 16)).astype("float32")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id bigint, embedding array<float>").cache()
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "chunk_id bigint, embedding array<float>").repartition(4).cache()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    return q, c, unit(asked.astype("float64")) @ unit(corpus.astype("float64")).T


def test_vector_search_exact(vectors):
    q, c, scores = vectors
    want = {i: np.lexsort((np.arange(300), -np.round(s, 6)))[:10].tolist() for i, s in enumerate(scores)}
    assert lists(S.vector_search(q, c, 10)) == want
    assert lists(S.vector_search(q, c, 10, block_size=6)) == want


def test_lsh_recall(vectors):
    q, c, _ = vectors
    exact, near = lists(S.vector_search(q, c, 1)), lists(S.lsh_candidates(q, c, 1, dim=16))
    assert sum(exact[i] == near.get(i) for i in exact) >= 18
    scored = S.lsh_candidates(q, c, 50, dim=16)
    full = S.vector_search(q, c, 300)
    assert scored.join(full, ["query_id", "chunk_id", "score"], "left_anti").count() == 0
    assert scored.groupBy("query_id", "chunk_id").count().filter("count > 1").count() == 0


def test_filters_apply_before_top_k(spark, small):
    queries, corpus, asked, texts = small
    lang = F.when(F.col("chunk_id") % 3 == 0, "a").otherwise("b")
    q = queries.withColumn("lang", F.when(F.col("query_id") < 4, "a").when(F.col("query_id") < 6, "none"))
    got = lists(S.bm25_search(q, corpus.withColumn("lang", lang), 5, filters=("lang",)))
    full = brute_bm25(asked, texts, 200)
    for i in range(9):
        want = [c for c in full[i] if c % 3 == 0] if i < 4 else [] if i < 6 else full[i]
        assert got.get(i, []) == want[:5]
    back = S.filter_fallback(q, lambda x: S.bm25_search(x, corpus.withColumn("lang", lang), 5, filters=("lang",)), ("lang",))
    flags = {r["query_id"]: r["fallback"] for r in back.select("query_id", "fallback").distinct().collect()}
    assert flags == {i: i in (4, 5) for i in range(9)}
    assert lists(back)[4] == full[4][:5]


def test_fusion_weights(spark):
    dense = spark.createDataFrame([(1, c, r, 0.0) for r, c in enumerate([10, 11, 12], 1)], "query_id int, chunk_id int, rank int, score double")
    sparse = spark.createDataFrame([(1, c, r, 0.0) for r, c in enumerate([12, 13], 1)], "query_id int, chunk_id int, rank int, score double")
    assert lists(R.weighted_rrf(dense, sparse, 0.0)) == {1: [12, 13]}
    assert lists(R.weighted_rrf(dense, sparse, 1.0)) == {1: [10, 11, 12]}
    fused = {r["chunk_id"]: r["score"] for r in R.weighted_rrf(dense, sparse).collect()}
    assert fused[12] == pytest.approx(0.6 / 63 + 0.4 / 61, abs=1e-9) and fused[10] == pytest.approx(0.6 / 61, abs=1e-9)
    swept = R.alpha_sweep(dense, sparse)
    assert lists(swept.filter("alpha = 0.0")) == {1: [12, 13]} and swept.select("alpha").distinct().count() == 11


def test_merge_subqueries(spark):
    rows = [(1, 0, 1, "a", 0.5), (1, 0, 2, "b", 0.9), (1, 1, 1, "a", 0.99), (1, 1, 2, "c", None), (1, 1, 3, "d", 0.5)]
    df = spark.createDataFrame(rows, "query_id int, list_no int, pos int, chunk_id string, score double")
    assert lists(R.merge_subqueries(df)) == {1: ["b", "a", "d", "c"]}
    assert lists(R.merge_subqueries(df, cap=2)) == {1: ["b", "a"]}


def test_refine_rounds(spark, small):
    queries, corpus, asked, texts = small
    grades = spark.createDataFrame(
        [(0, 1, False, " w1 w2 "), (1, 1, False, asked[1][1]), (2, 1, False, " "), (3, 1, True, "w5"), (0, 2, False, "w9")],
        "query_id bigint, round int, sufficient boolean, refined_query string",
    )
    got = S.refine_rounds(queries, lambda q: S.bm25_search(q, corpus, 5), grades)
    rounds = {r["query_id"]: r["rounds"] for r in got.select("query_id", "rounds").distinct().collect()}
    assert rounds == {0: 2, **{i: 1 for i in range(1, 9)}}
    assert lists(got)[0] == brute_bm25([(0, "w1 w2")], texts, 5)[0]


def test_subqueries(spark):
    df = spark.createDataFrame([(1, "orig", [" a ", "", "b", "c", "d"]), (2, "orig", [" "]), (3, "orig", None)], "query_id int, text string, parts array<string>")
    got = [(r["query_id"], r["sub_no"], r["subquery"]) for r in S.explode_subqueries(df).orderBy("query_id", "sub_no").collect()]
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "orig"), (3, 0, "orig")]


def test_sources_and_context(spark):
    ranked = spark.createDataFrame([(1, 1, 0.5, 1), (1, 2, None, 2), (1, 3, 0.1, 3)], "query_id int, chunk_id int, score double, rank int")
    corpus = spark.createDataFrame([(1, " x " * 400, 7, "f.pdf"), (2, "two", 8, ""), (3, "three", None, None)], "chunk_id int, text string, document_id int, filename string")
    src = S.source_list(ranked, corpus)
    rows = src.orderBy("source_index").collect()
    assert [r["label"] for r in rows] == ["f.pdf", "tài liệu #8", "tài liệu"] and len(rows[0]["snippet"]) == 500 and rows[1]["score"] is None
    assert S.context_block(src).first()["context"].endswith("[2] (nguồn: tài liệu #8)\ntwo\n\n[3] (nguồn: tài liệu)\nthree")


# --- relevance -----------------------------------------------------------------------------------


def test_keyword_paths_agree(spark):
    corpus = spark.createDataFrame(
        [(1, "Mã 43/2019/QH14 và số 8"), (2, "so 1.893 qh14"), (3, "số 8, lớp 1"), (4, "c++ và § 5"), (5, "43/2019/qh145")], "chunk_id bigint, text string"
    )
    items = spark.createDataFrame([(1, ["43/2019/QH14", "8"]), (2, ["§", " "]), (3, ["893"]), (4, ["++"])], "query_id bigint, keywords array<string>")
    kws = L.item_keywords(items)
    pairs = lambda df: {(r["keyword"], r["chunk_id"]) for r in df.collect()}
    want = {("43/2019/qh14", 1), ("8", 1), ("8", 3), ("§", 4), ("893", 2)}
    assert pairs(L.keyword_matches(kws, corpus)) == want  # "++" follows a letter, so it is not a word
    assert pairs(L.keyword_matches(kws, corpus, small=0)) == want
    df = {r["keyword"]: r["df"] for r in L.keyword_df(kws, corpus).collect()}
    assert df == {"43/2019/qh14": 1, "8": 2, "§": 1, "893": 1, "++": 0}
    hit = lambda **kw: {tuple(r) for r in L.rare_keyword_hit(kws, corpus, **kw).collect()}
    assert hit() == {(1, 1), (2, 4), (3, 2)} and hit(rare_df=0) == set()
    assert hit(use_df=False) == {(1, 1), (2, 4), (3, 2)}


def test_auto_relevant(spark):
    corpus = spark.createDataFrame([(1, "Một hai BA bốn năm"), (2, "mot hai ba x y z"), (3, "khác")], "chunk_id bigint, text string")
    items = spark.createDataFrame([(1, "một hai ba bốn", "d"), (2, "một hai ba bốn", "none"), (3, "zzz", "d")], "query_id bigint, reference string, source_doc string")
    labels = L.auto_relevant(items, corpus)
    assert {tuple(r) for r in labels.collect()} == {(1, 1), (1, 2)}
    assert {tuple(r) for r in L.label_coverage(items, labels).collect()} == {("answerable", 1), ("negative", 1), ("unlabeled", 1)}


# --- metrics -------------------------------------------------------------------------------------


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", i, r) for i, r in enumerate([0, 1, 0, 1, 1], 1)], "query_id string, rank int, rel int")
    totals = spark.createDataFrame([("q", 3), ("missed", 2), ("none", 0)], "query_id string, n_relevant int")
    at = lambda df, c, q="q": {r["query_id"]: r[c] for r in df.collect()}[q]
    assert at(E.precision_at_k(ranked, 2), "precision") == 0.5
    assert at(E.precision_at_k(ranked, 5), "precision") == 0.6
    assert at(E.precision_at_k(ranked, 10), "precision") == 0.3
    assert at(E.precision_at_k(ranked, 0), "precision") is None
    assert at(E.recall_at_k(ranked, totals, 2), "recall") == pytest.approx(1 / 3, abs=1e-6)
    assert at(E.recall_at_k(ranked, totals, 2), "recall", "none") is None and at(E.recall_at_k(ranked, totals, 2), "recall", "missed") == 0
    assert at(E.f1_at_k(ranked, totals, 5), "f1") == 0.75 and at(E.f1_at_k(ranked, totals, 1), "f1") == 0
    assert at(E.hit_at_k(ranked, 1), "hit") == 0 and at(E.hit_at_k(ranked, 2), "hit") == 1
    assert at(E.reciprocal_rank(ranked), "reciprocal_rank") == 0.5
    dcg = 1 / math.log2(3) + 1 / math.log2(5) + 1 / math.log2(6)
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert at(E.dcg_at_k(ranked, 5), "dcg") == pytest.approx(dcg, abs=1e-6)
    assert at(E.ndcg_at_k(ranked, totals, 5), "ndcg") == pytest.approx(dcg / ideal, abs=1e-6)


def test_mean_skips_undefined(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", None), ("b", None)], "g string, m double")
    assert {r["g"]: r["mean_m"] for r in E.mean_defined(df, "m", ["g"]).collect()} == {"a": 1.0, "b": None}


@pytest.mark.parametrize("pairs,kappa", [([(1, 1), (0, 0)], 1.0), ([(1, 0), (0, 1)], -1.0), ([(1, 1), (1, 1)], 1.0), ([], None)])
def test_kappa(spark, pairs, kappa):
    assert E.cohen_kappa(spark.createDataFrame(pairs, "a int, b int")).first()["kappa"] == kappa


def test_label_pairs_need_equal_keys(spark):
    a, b = spark.createDataFrame([(1, 1), (2, 0)], "k int, a int"), spark.createDataFrame([(1, 1)], "k int, b int")
    with pytest.raises(Exception, match="same keys"):
        E.label_pairs(a, b, ["k"]).collect()


@pytest.mark.parametrize(
    "text,want",
    [('{"relevant": true}', True), ('x {"relevant": false} y', False), ('say "relevant": true,', True), ('{"relevant": "no"}', True), ('{"relevant": 0}', False),
     ('{"other": 1}', False), ("nothing", None), ("", None), ('{"relevant": []}', False), ('[1] "relevant":false', False), ('{"relevant": null}', False), ('{"relevant": ""}', False)],
)
def test_label_json(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(E.parse_label_json("t").alias("x")).first()["x"] is want


def test_alpha_and_saturation(spark):
    rows = [(0.1, 10, 0.5, 0.2), (0.2, 10, 0.5, 0.3), (0.3, 10, 0.5, 0.3), (0.1, 50, 0.6, 0.1), (0.2, 50, 0.5, 0.1), (0.3, 50, 0.0, 0.0)]
    grid = spark.createDataFrame(rows, "alpha double, k int, recall double, f1 double")
    assert E.pick_alpha(grid).first()["alpha"] == 0.2
    assert {r["alpha"]: r["saturation_k"] for r in E.saturation_k(grid).collect()} == {0.1: 50, 0.2: 10, 0.3: 50}


# --- gazetteer -----------------------------------------------------------------------------------


@pytest.mark.parametrize("small", [2000, 0])
def test_gazetteer_paths_agree(spark, small):
    texts = [(1, "ở phường Bình Hưng Hòa nhé"), (2, "BÌNH HƯNG"), (3, "xã hội"), (4, "An Phú hay An Long"), (5, ""), (6, None)]
    df = spark.createDataFrame(texts, "query_id int, text string")
    got = {r["query_id"]: r["match"] for r in M.gazetteer_match(df, M.localities(spark), small=small).collect()}
    assert got == {1: "Bình Hưng Hòa", 2: "Bình Hưng", 3: None, 4: "An Long", 5: None, 6: None}


def test_query_slots_and_titles(spark):
    df = spark.createDataFrame([(1, "tuyển sinh 2026-2027 ở Gò Vấp"), (2, "năm 2026 2027"), (3, "hồ sơ")], "query_id int, text string")
    got = {r["query_id"]: (r["ward"], r["school_year"]) for r in M.query_slots(df, M.localities(spark)).collect()}
    assert got == {1: ("Gò Vấp", "2026-2027"), 2: (None, "2026-2027"), 3: (None, None)}
    files = spark.createDataFrame([("KH tuyển sinh 2026 - 2027 phường gò vấp.pdf",), ("phường Lạ Hoắc.pdf",)], "filename string")
    assert {(r["school_year"], r["ward"]) for r in M.title_metadata(files, M.localities(spark)).collect()} == {("2026-2027", "Gò Vấp"), (None, "Lạ Hoắc")}
    assert M.localities(spark).count() == len(set(r[0] for r in M.localities(spark).collect()))


def test_bm25_reads_the_corpus_once_for_three_blocks(spark, small):
    queries, corpus = small[:2]
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        reads.add(1)
        return text

    watched = corpus.withColumn("text", counted("text"))
    third = max(1, -(-queries.count() // 3))
    S.bm25_search(queries, watched, 5, block_size=third).collect()
    assert reads.value == corpus.count()


def test_vector_search_reads_the_corpus_once_for_three_blocks(spark):
    import random

    rng = random.Random(11)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    corpus = spark.createDataFrame([(i, vector(), i % 4 if i % 9 else None) for i in range(300)], "chunk_id int, embedding array<double>, lang int")
    queries = spark.createDataFrame([(i, vector(), i % 5 if i % 2 else None) for i in range(30)], "query_id int, embedding array<double>, lang int")
    reads = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(v):
        reads.add(1)
        return v

    watched = corpus.withColumn("embedding", counted("embedding"))
    one = lists(S.vector_search(queries, watched, 5))
    once = reads.value
    assert lists(S.vector_search(queries, watched, 5, block_size=10)) == one and reads.value == 2 * once
    assert lists(S.vector_search(queries, corpus, 5, block_size=10, pass_bytes=1)) == one
    rows, asked = corpus.collect(), queries.collect()
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 6)
    want = {}
    for q in asked:
        fits = [r for r in rows if q.lang is None or r.lang == q.lang]
        best = [r.chunk_id for r in sorted(fits, key=lambda r: (-cos(q.embedding, r.embedding), r.chunk_id))[:5]]
        if best:
            want[q.query_id] = best
    assert lists(S.vector_search(queries, corpus, 5, filters=("lang",), block_size=10)) == want
