"""Containment by prefix and counting, keywords and names by automaton: against plain versions."""

import random

import numpy as np
import pytest

from corpusloom.operators import metadata as M
from corpusloom.operators import relevance as L
from corpusloom.operators.automaton import automaton, whole_words

WORDS = [f"w{i}" for i in range(12)] + ["a", "b"]


def grams(text):
    ws = text.split()
    return {tuple(ws[i : i + 3]) for i in range(max(len(ws) - 2, 1))} if ws else set()


def tables(spark, seed, n_items=40, n_chunks=150):
    rng = random.Random(seed)
    say = lambda most: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, most)))
    chunks = [(i, say(40)) for i in range(n_chunks)] + [(1000, ""), (1001, "w1"), (1002, "w1 w2"), (1003, None)]
    items = [(i, say(9)) for i in range(n_items)] + [(900, ""), (901, "w1"), (902, "w1 w2"), (903, None), (904, "unheard of words")]
    return items, chunks, spark.createDataFrame(items, "query_id long, reference string"), spark.createDataFrame(chunks, "chunk_id long, text string").repartition(4)


@pytest.mark.parametrize("threshold", [None, 0.2, 1 / 3, 0.5, 0.666667, 1.0])
@pytest.mark.parametrize("block", [0, 1 << 20])
def test_containment_against_all_pairs(spark, threshold, block):
    items, chunks, a, b = tables(spark, 3)
    if block == 0:
        a, items = a.where("query_id < 5 or query_id > 899"), [x for x in items if x[0] < 5 or x[0] > 899]
    want = {}
    for q, ref in items:
        for c, text in chunks:
            wanted, held = grams(ref or ""), grams(text or "")
            share = round(len(wanted & held) / len(wanted), 6) if wanted else 0
            if share > 0 and (threshold is None or share >= threshold):
                want[q, c] = share
    got = L.shared_trigrams(a, b, threshold, block_bytes=block).collect()
    assert {(r.query_id, r.chunk_id): r.recall for r in got} == pytest.approx(want) and len(got) == len(want)
    assert want


def test_a_trigram_in_every_chunk_makes_no_candidates():
    common = ["x", "y", "z"]
    index = L.ReferenceIndex([common + [f"r{q}", f"s{q}", f"t{q}"] for q in range(200)], 0.6)
    seen = []
    index._counted = lambda pairs, both: iter(seen.append(len(pairs)) or ())
    list(index.matches([" ".join(common + ["other", "words"])] * 2000 + ["x y z r7 s7 t7"]))
    assert sum(seen) == 1


def test_containment_shuffles_nothing(spark):
    _, _, a, b = tables(spark, 4)
    assert "Exchange" not in L.shared_trigrams(a, b.coalesce(1), 0.5)._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")


def test_many_references_in_slices(monkeypatch):
    monkeypatch.setattr(L, "_CELLS", 50)
    rng = random.Random(5)
    refs = [[rng.choice(WORDS[:4]) for _ in range(8)] for _ in range(60)]
    bodies = [" ".join(rng.choice(WORDS[:4]) for _ in range(20)) for _ in range(50)]
    index = L.ReferenceIndex(refs, 0.4)
    got = {(r, q): s for rows, qs, n in index.matches(bodies) for r, q, s in zip(rows.tolist(), qs.tolist(), n.tolist())}
    pairs = {(r, q): len(grams(b) & grams(" ".join(ref))) for r, b in enumerate(bodies) for q, ref in enumerate(refs)}
    assert got == {k: n for k, n in pairs.items() if n >= np.ceil(0.4 * len(grams(" ".join(refs[k[1]])))) and n}


def test_whole_words():
    words = ["ab", "b", "++", "a b", "43/2019", "b c"]
    search = automaton(words)
    assert whole_words(search, words, "ab xb b") == {0, 1}
    assert whole_words(search, words, "c++ a b") == {3, 1}
    assert whole_words(search, words, "++ 43/2019 143/2019x") == {2, 4}
    assert whole_words(search, words, "a b c") == {1, 3, 5}
    assert whole_words(search, words, "143/2019 43/20190") == set()


@pytest.mark.parametrize("small", [1, 12, 1 << 20])
def test_names_against_a_plain_version(spark, small):
    rng = random.Random(6)
    names = ["An", "An Phú", "ân phú", "AN", "phu", "İz", "Q1", "q10", ""]
    texts = [(i, " ".join(rng.choice(["an", "phú", "Ân", "PHU", "izmir", "İzmir", "q10", "x"]) for _ in range(4))) for i in range(60)] + [(None, None), (7, "")]
    got = M.gazetteer_match(spark.createDataFrame(texts, "query_id int, text string"), spark.createDataFrame([(n,) for n in names], "name string"), small=small).collect()
    lower = {r[0]: r[1] for r in spark.createDataFrame([(t,) for _, t in texts if t] + [(n,) for n in names], "t string").selectExpr("t", "lower(t)").collect()}

    def best(text):
        inside = [(-len(n), n) for n in names if n and text and lower[n] in lower[text]]
        return min(inside)[1] if inside else None

    assert [r.match for r in got] == [best(t) for _, t in texts]


def test_rare_keywords_against_a_plain_version(spark):
    rng = random.Random(8)
    chunks = [(i, " ".join(rng.choice(WORDS + ["k%d" % rng.randrange(80)]) for _ in range(12))) for i in range(120)]
    items = [(q, [rng.choice(WORDS + ["k%d" % j for j in range(80)]) for _ in range(rng.randrange(1, 3))]) for q in range(60)]
    corpus = spark.createDataFrame(chunks, "chunk_id long, text string").repartition(5)
    kws = L.item_keywords(spark.createDataFrame(items, "query_id long, keywords array<string>"))
    df = {k: sum(k in t.split() for _, t in chunks) for _, ks in items for k in ks}
    want = {(q, c) for q, ks in items for c, t in chunks if all(k in t.split() for k in ks) and any(df[k] <= 3 for k in ks)}
    assert {tuple(r) for r in L.rare_keyword_hit(kws, corpus).collect()} == want and want
    assert {r.keyword: r.df for r in L.keyword_df(kws, corpus).collect()} == df
    given = L.keyword_df(kws, corpus)
    assert {tuple(r) for r in L.rare_keyword_hit(kws, corpus, given).collect()} == want
    assert L.rare_keyword_hit(kws.limit(0), corpus).collect() == [] and L.keyword_matches(kws.limit(0), corpus).collect() == []
