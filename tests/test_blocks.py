import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.markup import BLOCK
from corpusloom.operators import blocks as B
from corpusloom.plans.ingest import ingest_parsed
from corpusloom.operators.metadata import localities
from corpusloom.sources import tables as A

DOC = f"doc_id bigint, blocks array<{BLOCK}>"


def h(value, level=1, page=1):
    return (page, "heading", level, value, f"# {value}", None)


def p(value, page=1):
    return (page, "text", None, value, value, None)


def tb(md, rows, page=1):
    return (page, "table", None, md, md, rows)


def docs(spark, *lists):
    return spark.createDataFrame(list(enumerate(lists)), DOC)


def stack_paths(blocks):
    """The heading stack kept by hand."""
    stack, out = {}, []
    for _, kind, level, value, _, _ in blocks:
        if kind == "heading" and value:
            level = level or 1
            stack = {k: v for k, v in stack.items() if k < level}
            stack[level] = value
        out.append([stack[k] for k in sorted(stack)])
    return out


def test_heading_path(spark):
    blocks = [p("a"), h("H2", 2), p("b"), h("H1", 1), h("H3", 3), p("c"), h("H2b", 2), h("", 1), h("Top", None), p("d"), h("Deep", 9), p("e")]
    rows = B.heading_path(docs(spark, blocks, [])).orderBy("pos").collect()
    assert [r["heading_path"] for r in rows] == stack_paths(blocks)


def test_segments_cut_before_heading_and_at_tables(spark):
    blocks = [p("a b c"), h("x"), p("d e f"), h("y"), tb("|t|", [["t"]]), p("z"), h("w")]
    # tokens: 3, then heading (3 < 5 stays), +2 +3 = 8 >= 5 so "y" starts a new segment, table cuts, rest
    segs = B.segment_blocks(docs(spark, blocks), region_max=5).orderBy("segment_index").collect()
    assert [[b["value"] for b in s["blocks"]] for s in segs] == [["a b c", "x", "d e f"], ["y"], ["z", "w"]]
    assert [s["heading_path"] for s in segs] == [[], ["y"], ["y"]]


@pytest.mark.parametrize("texts,size,want", [
    (["a b c d e", "f g h i j"], 4, ["a b c d e", "f g h i j"]),
    (["a", "b", "c d"], 2, ["a\n\nb", "c d"]),
    ([" "], 4, []),
    (["a b c d e f"], 2, ["a b c d e f"]),
])
def test_greedy_merge(spark, texts, size, want):
    df = spark.createDataFrame([(texts,)], "t array<string>")
    assert df.select(B.merged_texts(F.col("t"), size).alias("m")).first()["m"] == want


def test_chunks_of_a_document(spark):
    blocks = [h("Kế hoạch"), p("nội dung", 1), p("tiếp", 2), tb("| Ngày | Việc |", [["Ngày", "Việc"], ["1/5", None]], 3), tb("", None, 3)]
    df = docs(spark, blocks).withColumn("name", F.lit("f.pdf"))
    chunks = B.build_chunks(df, filename="name").orderBy("chunk_index").collect()
    assert [(c["chunk_type"], c["page_number"], c["has_table"]) for c in chunks] == [("text", 1, False), ("table", 3, True)]
    assert chunks[0]["content"] == "# Kế hoạch\n\nnội dung\n\ntiếp"
    assert chunks[0]["text"] == "Trích từ f.pdf. Thuộc: Kế hoạch.\n\n# Kế hoạch\n\nnội dung\n\ntiếp"
    assert chunks[1]["grid"] == [["Ngày", "Việc"], ["1/5", None]]
    assert chunks[1]["context"].endswith("Dữ liệu dạng bảng.")
    again = B.build_chunks(df, filename="name").orderBy("chunk_index").collect()
    assert [c["chunk_id"] for c in chunks] == [c["chunk_id"] for c in again] and len({c["chunk_id"] for c in chunks}) == 2
    stored = A.append_chunks(B.build_chunks(df, filename="name")).orderBy("chunk_index").collect()
    assert json.loads(stored[1]["table_data"]) == {"grid": [["Ngày", "Việc"], ["1/5", None]]}
    assert stored[0]["table_data"] is None and json.loads(stored[0]["heading_path"]) == ["Kế hoạch"]


def test_chunk_contents_rebuild_the_document(spark):
    blocks = [h(f"h{i}", i % 4 + 1) if i % 5 == 0 else p(" ".join(["w"] * (i % 40 + 1)) + f" {i}") for i in range(200)]
    chunks = B.build_chunks(docs(spark, blocks), region_max=100, chunk_size=50).orderBy("chunk_index").collect()
    assert "\n\n".join(c["content"] for c in chunks) == "\n\n".join(b[4] for b in blocks)


@pytest.mark.parametrize("groups,n,problem", [
    ([[0, 1], [2]], 3, None),
    ([[0, 2]], 3, "blocks not consecutive"),
    ([[0]], 2, "blocks not covered"),
    ([[0, 1], [1, 2]], 3, "block in several groups"),
    ([[0, 1, 2]], 2, "block out of range"),
    ([[]], 1, "group without blocks"),
    ([], 1, "no groups"),
])
def test_partition(spark, groups, n, problem):
    data = [([(g, None, None, None) for g in groups], n)]
    row = B.validate_partition(spark.createDataFrame(data, f"groups array<{B.GROUP}>, n_blocks int")).first()
    assert row["problem"] == problem and row["valid"] == (problem is None)


def test_assembled_groups_and_fallback(spark):
    long = " ".join(["w"] * 300)
    df = docs(spark, [p(long, 1), p(long + " x", 2), p("end", 3)], [p(long), p(long)])
    segs = B.segment_blocks(df)
    proposals = spark.createDataFrame(
        [(0, 0, [([0], ["Điều 1", " "], " ngữ cảnh ", "mixed"), ([1, 2], None, None, "bad")]), (1, 0, [([0], None, None, None)])],
        f"doc_id bigint, segment_index int, groups array<{B.GROUP}>",
    )
    out = B.assemble_groups(segs, proposals).orderBy("doc_id", "piece_index").collect()
    assert [(r["doc_id"], r["accepted"], r["page_number"], r["chunk_type"], r["context"]) for r in out] == [
        (0, True, 1, "mixed", "ngữ cảnh"), (0, True, 2, "text", ""), (1, False, 1, "text", ""), (1, False, 1, "text", ""),
    ]
    assert out[0]["heading_path"] == ["Điều 1"] and out[1]["content"] == long + " x\n\nend"


def test_parsed_pages_and_ingest(spark, tmp_path):
    page = {"page": 0, "md": " # KẾ HOẠCH\nngày 1 tháng 2 năm 2026 ", "items": [
        {"type": "heading", "lvl": 1, "value": "KẾ HOẠCH", "md": ""}, {"type": "image", "value": "x"}, {"type": "text", "value": " ", "md": None},
        {"type": "table", "rows": [["a", " "], ["", "b"]], "md": ""}]}
    (tmp_path / "one.json").write_text(json.dumps({"pages": [page, {"page": 7, "md": "", "items": None}]}))
    raw = A.read_parsed_pages(spark, str(tmp_path))
    named = raw.select(F.lit(5).cast("long").alias("doc_id"), F.lit("tuyển sinh 2026 2027 phường an phú.pdf").alias("filename"), "pages")
    blank = spark.createDataFrame([(6, "empty.pdf", [])], f"doc_id bigint, filename string, {A.PAGES_SCHEMA}")
    out = ingest_parsed(named.unionByName(blank), localities(spark))
    meta = {r["doc_id"]: r for r in out["documents"].collect()}
    assert (meta[5]["doc_type"], meta[5]["issued_date"], meta[5]["school_year"], meta[5]["ward"]) == ("ke_hoach", "01/02/2026", "2026-2027", "An Phú")
    chunks = out["search_chunks"].orderBy("chunk_index").collect()
    assert [c["chunk_type"] for c in chunks] == ["text", "table"] and chunks[1]["grid"] == [["a", None], [None, "b"]]
    status = {r["doc_id"]: (r["status"], r["page_count"], r["chunk_count"], r["error_message"]) for r in out["status"].collect()}
    assert status == {5: ("ready", 2, 2, None), 6: ("failed", None, None, "no content")}


def test_eval_set_formats(spark, tmp_path):
    rows = [{"id": "a", "question": "q1", "expected_keywords": ["x"]}, {"id": "b", "question": "q2"}]
    (tmp_path / "s.json").write_text(json.dumps(rows))
    (tmp_path / "s.jsonl").write_text(json.dumps(rows[0]) + "\n\n" + json.dumps(rows[1]) + "\n")
    for name in ("s.json", "s.jsonl"):
        got = A.read_eval_set(spark, str(tmp_path / name)).orderBy("id").collect()
        assert [(r["id"], r["question"], r["expected_keywords"]) for r in got] == [("a", "q1", ["x"]), ("b", "q2", None)]


def long_document(n):
    kinds = [h(f"h{i}", i % 5, i // 9) if i % 7 == 0 else tb(f"|{i}|", [[str(i)]]) if i % 31 == 3 else tb(" ", None) if i % 31 == 5 else p(" ".join(["w"] * (i * 37 % 90)) + f" {i}") for i in range(n)]
    return [p(" ") if i % 13 == 2 else b for i, b in enumerate(kinds)]


def test_block_rows_give_the_same_chunks(spark):
    many = docs(spark, long_document(900), [], long_document(5), [p(" "), p("")]).withColumn("file", F.lit("f")).withColumn("lang", F.col("doc_id") + 1)
    rows = many.select("doc_id", "file", "lang", F.posexplode("blocks").alias("pos", "b")).select("doc_id", "file", "lang", "pos", "b.*").repartition(7)
    a = B.build_chunks(many, filename="file", carry=("lang",), chunk_size=60, region_max=200)
    b = B.chunk_block_rows(rows, filename="file", carry=("lang",), chunk_size=60, region_max=200)
    assert a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() > 100
    assert B.chunk_block_rows(rows.limit(0)).collect() == []


def test_walk_against_lists_kept_by_hand(spark):
    blocks = long_document(400)
    walked = B.segment_blocks(docs(spark, blocks), region_max=150).orderBy("segment_index").collect()
    runs, run, count = [], [], 0
    for b, path in zip(blocks, stack_paths(blocks)):
        if b[1] == "table" or (b[1] == "heading" and count >= 150):
            runs, run, count = runs + [run] * bool(run), [], 0
        if b[1] != "table":
            run.append((b[3], path))
            count += len(b[4].split())
    runs += [run] * bool(run)
    assert [[(x["value"], x["path"]) for x in s["blocks"]] for s in walked] == runs
    assert [s["heading_path"] for s in walked] == [r[0][1] for r in runs]


def test_ten_times_the_blocks_take_about_ten_times_the_time(spark):
    import time

    def spent(n):
        one = docs(spark, long_document(n)).repartition(1)
        start = time.time()
        B.build_chunks(one).write.format("noop").mode("overwrite").save()
        return time.time() - start

    spent(2_000)
    assert spent(40_000) < 30 * max(spent(4_000), 0.5)


def test_partition_problems_in_order(spark):
    import random

    rng, rows = random.Random(7), []

    def plain(groups, n):
        seen = set()
        for g in groups:
            if not g:
                return "group without blocks"
            if any(i < 0 or i >= n for i in g):
                return "block out of range"
            if any(b - a != 1 for a, b in zip(g, g[1:])):
                return "blocks not consecutive"
            if seen & set(g):
                return "block in several groups"
            seen |= set(g)
        return ("blocks not covered" if len(seen) != n else None) if groups else "no groups"

    for i in range(300):
        n = rng.randrange(1, 8)
        cuts = sorted(rng.sample(range(1, n), rng.randrange(0, n))) if n > 1 else []
        groups = [list(range(a, b)) for a, b in zip([0, *cuts], [*cuts, n])]
        for _ in range(rng.choice((0, 0, 1, 2))):
            groups[rng.randrange(len(groups))] = [rng.randrange(-1, n + 1) for _ in range(rng.randrange(0, 3))]
        rows.append((i, groups, n))
    df = spark.createDataFrame([(i, [(g, None, None, None) for g in gs], n) for i, gs, n in rows], f"id int, groups array<{B.GROUP}>, n_blocks int")
    assert {r["id"]: r["problem"] for r in B.validate_partition(df).collect()} == {i: plain(gs, n) for i, gs, n in rows}
