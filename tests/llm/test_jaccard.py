import random
from itertools import combinations

import numpy as np
import pytest

from corpusloom.llm import jaccard
from corpusloom.llm.components import components


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)]
    line = "this very line is in nearly every text of all"
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 3, 5, 6, 12, 40, 120, 300)))]
        for _ in range(rng.choice((1, 1, 1, 4, 12))):
            copy = list(words)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), (line + "\n" if rng.random() < 0.6 else "") + rng.choice((" ", "\t", "  ")).join(copy)))
    return rows


@pytest.mark.parametrize("hot,small,slack", [(1000, 16, 16), (8, 3, 4), (8, 3, 0), (3, 2, 40)])
def test_against_all_pairs(spark, monkeypatch, hot, small, slack):
    for name, value in (("HOT", hot), ("SMALL", small), ("SLACK", slack)):
        monkeypatch.setattr(jaccard, name, value)
    rows = [*corpus(hot + slack, 120), (9001, None), (9002, ""), (9003, "a b c d"), (9004, "A  b c D"), (None, "a b c d"), (None, "zz"), (9003, "other text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as node", "2 as n").repartition(3)
    got = [tuple(r) for r in jaccard.similarity_classes(docs).collect()]
    want = brute(rows)
    assert sorted(got, key=str) == want


def test_empty_table(spark):
    assert jaccard.similarity_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 62, rng.integers(1, 200), dtype=np.uint64)) for _ in range(300)]
    sets += [s[: max(1, len(s) * 9 // 10)] for s in sets]
    points = [np.frombuffer(jaccard.group_counts(s), np.uint8) for s in sets]
    sizes = np.array([len(s) for s in sets])
    tree = jaccard.CountTree(sizes, points)
    some = np.arange(240, 360)
    leaf = jaccard.CountTree(sizes[some], [points[i] for i in some])
    assert tree.matrix is None and leaf.matrix is not None
    for i in some:
        assert set(some[leaf.near(i - 240)]) == set(tree.near(i).tolist()) & set(some)
    for i in range(0, 600, 7):
        found = {i, *tree.near(i).tolist()}
        linked = {j for j in range(600) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
        assert linked <= found and len(found) < 300


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 300)] + [(500, 500), (None, 3), (-5, 17)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    want = {i: -5 for i in [*range(41), -5]} | {i: 100 for i in range(100, 300)}
    assert got == want


def test_a_common_line_sends_no_document_on(spark, monkeypatch):
    line = "this very line is in nearly every text of all"
    rows = [(i, " ".join(f"w{i}-{k}" for k in range(100)) + "\n" + line) for i in range(30)]
    counts, write = {}, jaccard.materialize

    def counting(df, label="stage"):
        written = write(df, label)
        counts[label] = written.count()
        return written

    monkeypatch.setattr(jaccard, "materialize", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.component_id) for r in jaccard.similarity_classes(docs).collect()) == [(i, i) for i in range(30)]
    assert counts["tokens"] == 0


def family(seed, n):
    """Copies of one text that are hardly linked, and of another that are."""
    rng = random.Random(seed)
    rows = []
    for tag, share in (("u", 0.065), ("v", 0.02)):
        base = [f"{tag}{k}" for k in range(240)]
        rows += [" ".join(f"{tag}{i}-{k}" if rng.random() < share else w for k, w in enumerate(base)) for i in range(n)]
    return list(enumerate(rows))


def test_two_documents_of_a_family_meet_once(spark, monkeypatch):
    rows, made = family(3, 40), []
    spread_out = "spark.sql.adaptive.coalescePartitions.enabled"
    monkeypatch.setattr(jaccard, "PARTS_EACH", 16)
    kind = type(spark.range(1))
    run = kind.mapInArrow

    def recording(self, fn, schema, *args, **more):
        out = run(self, fn, schema, *args, **more)
        if schema == "a long, b long" and "part" in self.columns:
            made.append(out)
        return out

    monkeypatch.setattr(kind, "mapInArrow", recording)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set(spread_out, "false")
    try:
        got = [tuple(r) for r in jaccard.similarity_classes(docs).collect()]
        pairs = [df.collect() for df in made[1:]]  # the first are ties
    finally:
        spark.conf.unset(spread_out)
    assert sorted(got, key=str) == brute(rows)
    assert len(pairs[0]) > 20 and all(len(found) == len(set(found)) for found in pairs)


@pytest.mark.parametrize("cells", [1 << 22, 700, 60])
def test_each_pair_has_one_first_meeting(monkeypatch, cells):
    monkeypatch.setattr(jaccard, "CELLS", cells)
    rng = np.random.default_rng(5)
    lists = [np.sort(rng.choice(60, rng.integers(1, 30), replace=False)).astype(np.int64) for _ in range(50)]
    seen = np.zeros((50, 50), int)
    for token in range(60):
        group = [i for i in range(50) if token in lists[i]]
        if group:
            seen[np.ix_(group, group)] += ~np.concatenate([met for _, met in jaccard.met_before([lists[i] for i in group], token)])
    assert (seen == [[bool(set(a) & set(b)) for b in lists] for a in lists]).all()
