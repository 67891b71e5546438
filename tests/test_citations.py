import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import citations as V

ANSWERS = "answer_id int, answer string, verdict_json string, sources array<struct<index:int,filename:string>>"


def verdict(sid, action="keep", att=(), quote="", **over):
    v = {"sentence_id": sid, "attributed_indices": list(att), "supporting_quote": quote, "supported": True, "in_scope": True, "action": action}
    v.update(over)
    return {k: x for k, x in v.items() if x != "missing"}


def check(spark, answer, verdicts, n_sources=3):
    body = verdicts if isinstance(verdicts, str) else json.dumps({"verdicts": verdicts})
    df = spark.createDataFrame([(1, answer, body, [(i, f"f{i}") for i in range(1, n_sources + 1)])], ANSWERS)
    r = V.verify_answers(df).first()
    return r["ok"], r["final_answer"], r["dropped_count"], r["cited_indices"], {s["index"]: s["cited_spans"] for s in r["sources"]}


def test_drop_second_sentence(spark):
    got = check(spark, "A [1]. B [2].", [verdict(0, att=[1], quote="qa"), verdict(1, "drop", [2])])
    assert got == (True, "A [1].", 1, [1], {1: ["qa"]})


def test_recite(spark):
    got = check(spark, "Khai sinh [2].", [verdict(0, "recite", [1])])
    assert got == (True, "Khai sinh [1].", 0, [1], {1: []})


def test_invalid_indices_fall_back_to_own_markers(spark):
    got = check(spark, "A [2][9].\nB", [verdict(0, "recite", [7], "q"), verdict(1, "recite", [8])])
    assert got == (True, "A [2].\nB", 0, [2], {2: ["q"]})


def test_no_verdict_keeps_sentence(spark):
    got = check(spark, "A [1]. B [3].", [verdict(1, "drop"), verdict(0, in_scope="missing"), verdict(42, "drop")])
    assert got == (True, "A [1].", 1, [1], {1: []})


def test_last_duplicate_wins_and_quotes_are_distinct(spark):
    got = check(spark, "A. B.", [verdict(0, "drop"), verdict(0, att=[2], quote=" x "), verdict(1, att=[2, 1], quote="x")])
    assert got == (True, "A. B.", 0, [1, 2], {1: ["x"], 2: ["x"]})


@pytest.mark.parametrize("reply", ["not json", '{"verdicts": 3}', '{"other": []}', ""])
def test_broken_reply_keeps_everything(spark, reply):
    assert check(spark, "A [1].", reply) == (False, "A [1].", 0, [1, 2, 3], {1: None, 2: None, 3: None})


def test_all_dropped_keeps_original(spark):
    assert check(spark, "A [1].", [verdict(0, "drop")]) == (False, "A [1].", 0, [1, 2, 3], {1: None, 2: None, 3: None})


def test_empty_answer_is_ok(spark):
    assert check(spark, " \n", [])[:4] == (True, " \n", 0, [1, 2, 3])


@pytest.mark.parametrize("wrap", ["```json\n{}\n```", "Here you are:\n{}\nbye", "```\n{}```"])
def test_wrapped_reply(spark, wrap):
    body = wrap.replace("{}", json.dumps({"verdicts": [verdict(0, "drop")]}))
    assert check(spark, "A. B.", body)[:3] == (True, "B.", 1)


def test_revision(spark):
    rows = [(True, 1, 0), (True, 0, 0), (False, 1, 0), (True, 1, 1)]
    df = spark.createDataFrame(rows, "ok boolean, dropped_count int, revision int")
    assert [r["revise"] for r in V.revision_decision(df, F.col("revision")).collect()] == [True, False, False, False]


def test_group_sources(spark):
    schema = "answer_id int, index int, document_id int, filename string, snippet string, vector_id string, cited_spans array<string>"
    rows = [(1, 1, 5, "a", "s1", "AB", ["x"]), (1, 2, None, "b", "s2", None, None), (1, 3, 5, "a", "s3", "ab", ["y"]), (1, 4, 5, "a", "s4", "C", []), (1, 5, 9, "", "s5", "d", None), (1, 6, None, None, "s6", "e", None)]
    got = {r["group_key"]: r for r in V.group_sources_by_document(spark.createDataFrame(rows, schema)).collect()}
    assert {k: (r["first_index"], r["label"], r["snippet"], r["cited_ids"]) for k, r in got.items()} == {
        "d5": (1, "a", "s1", ["ab", "c"]), "b": (2, "b", "s2", []), "d9": (5, "Tài liệu #9", "s5", ["d"]), "i6": (6, "Tài liệu", "s6", ["e"]),
    }
    assert [(q["id"], q["quotes"]) for q in got["d5"]["quotes"]] == [("ab", ["x", "y"])]


def test_quote_spans(spark):
    df = spark.createDataFrame([(1, "Một  HAI\nba một hai BA (x+)", "một hai ba"), (2, "a (x+) b", "(X+)"), (3, "abab", "ab"), (4, "𝒳 abc", "ABC")], "k int, content string, quote string")
    got = {}
    for r in V.quote_spans(df, ["k"]).collect():
        got.setdefault(r["k"], []).append((r["start"], r["end"]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(0, 11), (12, 22)], 2: [(2, 6)], 4: [(2, 5)]}


def test_highlight(spark):
    df = spark.createDataFrame([(1, "abcdef ghi", ["bcd", "cde", "GHI"]), (2, "none here", ["zzz"])], "k int, content string, quotes array<string>")
    got = {}
    for r in V.highlight_segments(df, ["k"]).orderBy("k", "segment_no").collect():
        got.setdefault(r["k"], []).append((r["text"], r["mark"]))
    assert got == {1: [("a", False), ("bcde", True), ("f ", False), ("ghi", True)], 2: [("none here", True)]}


def test_merge_ranges_across_sections_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot", s, s + rng.randint(1, 40)) for s in (rng.randint(0, 6000) for _ in range(500))] + [("hot", 10, 900), ("x", 5, 7), ("x", 7, 9), ("x", 10, 11)]

    def brute(key):
        out = []
        for s, e in sorted((s, e) for k, s, e in rows if k == key):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return sorted(map(tuple, out))

    rows += [(None, 3, 5), (None, 5, 200), (None, 150, 160), (None, 201, 202), ("x", None, 9), ("x", 20, None)]
    got = V.merge_ranges(spark.createDataFrame(rows, "k string, start int, end int"), ["k"], width=64).collect()
    assert sorted((r["start"], r["end"]) for r in got if r["k"] is None) == [(3, 200), (201, 202)]
    rows = [(k, s, s if e is None else e) for k, s, e in rows if s is not None]
    for key in ("hot", "x"):
        assert sorted((r["start"], r["end"]) for r in got if r["k"] == key) == brute(key)


def test_citation_position(spark):
    chunks = spark.createDataFrame([(1, i) for i in range(5)] + [(2, i) for i in range(3)] + [(3, 0)], "document_id int, chunk_index int")
    cited = spark.createDataFrame([(1, 3), (2, 0), (2, 2)], "document_id int, chunk_index int")
    got = {r["document_id"]: tuple(r)[1:] for r in V.citation_position(chunks, cited).collect()}
    assert got == {1: (5, 1, 4), 2: (3, 2, None), 3: (1, 0, None)}


def test_sentence_split_matches_plain_python(spark):
    from corpusloom.functions.citations import split_sentences

    pattern = re.compile(r"(\n+|(?<=[.!?…])\s+)")
    rng = random.Random(5)
    texts = ["".join(rng.choices(["a", "b.", " ", "\n", "! ", "… ", "[1]", ": "], k=25)) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", split_sentences("t").alias("s")).collect()
    for r in rows:
        parts, want = pattern.split(texts[r["i"]]), []
        for text, delim in zip(parts[::2], [*parts[1::2], ""]):
            if text.strip():
                want.append([text, delim])
            elif want:
                want[-1][1] += text + delim
        assert [[s["text"], s["delim"]] for s in r["s"]] == want
