import random

import pytest

from corpusloom.llm import quality


def plain_base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_base_counts_against_a_plain_version():
    rng = random.Random(1)
    pool = ["a", "b", "The", "é#", "<x>", "\n", " \n", "\t", "\x0b", " ", "日本", "\xa0", "🙂|"]
    for _ in range(300):
        text = "".join(rng.choice(pool) + rng.choice((" ", "")) for _ in range(rng.randrange(80)))
        got = quality.judge(text, "en", {}, quality.limits())
        want = plain_base(text)
        assert got[:5] == want
        assert got[5] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_distance_is_a_metric_between_zero_and_one():
    import numpy as np

    p, q = np.array([1, 0, 3]), np.array([0, 5, 0])
    assert quality.distance(p, p * 7) == 0 and quality.distance(p, q) == pytest.approx(1)


def corpus():
    rng = random.Random(2)
    common = {k: v[:12] for k, v in quality.COMMON_WORDS.items()}
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(3, 9)))
    prose = lambda k, n: " ".join(rng.choice(common[k]) if rng.random() < 0.4 else word() for _ in range(n))
    rows = [(i, prose(k, 300), k) for i, k in enumerate(("en", "fr", "de", "es") * 30)]
    symbols = " ".join(word() + rng.choice(("###", "%%%", "&&&", "$$$")) for _ in range(300))
    listed = "\n".join(word() + " | " for _ in range(400))
    rows += [(1000, symbols, "en"), (1001, listed, "en"), (1002, None, "en"), (1003, "", "xx"), (1004, prose("en", 60), None), (1005, symbols, "xx"), (1006, "the cat sat on " * 100, "en"), (0, rows[0][1], "en"), (None, "x" * 400_000, "fr")]
    return rows


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string").selectExpr("*", "'a' as kept", "1 as n_words")
    got = quality.quality_rules(docs.select("doc_id", "text", "lang", "kept", "n_words")).collect()
    assert len(got) == len(corpus())
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert all(r.kept for i in range(120) for r in by_id[i]) and len(by_id[0]) == 2
    assert not by_id[1000][0].kept and not by_id[1000][0].base_failed and by_id[1000][0].class_distance > quality.MAX_CLASS_DISTANCE
    assert not by_id[1001][0].kept
    assert by_id[1002][0].base_failed and by_id[1003][0].n_words == 0
    assert by_id[1004][0].kept and by_id[1004][0].word_distance is None
    assert by_id[1005][0].class_distance is None  # its reference is too small to judge
    assert by_id[1006][0].base_failed and by_id[None][0].n_words == 1
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_given_references_and_empty_table(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    references = quality.language_references(docs.where("doc_id < 120"))
    one = quality.quality_rules(docs.where("doc_id = 1000"), references).first()
    assert not one.kept and one.class_distance > quality.MAX_CLASS_DISTANCE
    assert quality.quality_rules(docs.limit(0)).collect() == []


def test_a_hot_group_of_junk_rejects_no_clean_document(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ETAOINSHR") for _ in range(rng.randrange(3, 9)))
    junk = lambda n: " ".join(word() for _ in range(n))
    clean = [r for r in corpus() if r[0] is not None and r[0] < 120]
    one, many = junk(3000), [junk(3000) for _ in range(8)]
    rows = clean + [(2000 + i, one, "en") for i in range(len(clean) // 2)] + [(3000 + i, x, "en") for i, x in enumerate(many)]
    rows += [(4000, "x y z " * 20_000, "de"), (4001, None, "de"), (4002, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    summed = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert len([i for i in summed if i < 120]) < 100  # what the sums do
    kept = sorted(r.doc_id for r in quality.keep_good(docs, quality.robust_references(docs)).collect())
    assert kept == sorted(r[0] for r in clean)
    assert quality.robust_references(docs.limit(0)).collect() == []
