"""Cases that a review found: caps, letters beyond Latin, repeated keys, redelivery."""

import re
import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import metadata as M
from corpusloom.functions import text as T
from corpusloom.functions.markup import html_blocks, text_blocks
from corpusloom.operators.evaluation import merge_judgments
from corpusloom.operators.metadata import gazetteer_match
from corpusloom.operators.quality import seeded_sample
from corpusloom.operators.search import vector_search
from corpusloom.operators.usage import period_report
from corpusloom.streaming.ingest import read_ingested, stream_ingest


def blocks(spark, page):
    row = spark.createDataFrame([(page,)], "html string").select(html_blocks("html").alias("b")).first()
    return [(b.type, b.value) for b in row.b]


def test_header_and_aside_are_content(spark):
    page = "<article><header><h1>Main title</h1></header><p>body</p><aside>note</aside></article><nav>no</nav>"
    assert blocks(spark, page) == [("heading", "Main title"), ("text", "body"), ("text", "note")]


def test_all_character_references(spark):
    assert blocks(spark, "<p>caf&eacute; &#8211; &#x3c;b&#62; &lt;i&gt; &amp;amp; &nope; x</p>") == [("text", "café – <b> <i> &amp; &nope; x")]


def rule(s):
    s = unicodedata.normalize("NFC", s).replace("đ", "d").replace("Đ", "D")
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", s).strip()


TEXTS = ["किताब की हिन्दी", "ภาษาไทย น้ำ", "ガラス パ ぎ", "ἄνθρωπος ᾳ Ὀδυσσεύς", "Đường\x1cPhố Huế", "ẹ́ ß ẞ İ", "각 é", "naïve – “x” €", "a b", "ÀÉ ǅ Ǆ"]


@pytest.mark.parametrize("s", TEXTS)
def test_normalization_of_other_scripts(spark, s):
    row = spark.createDataFrame([(s, unicodedata.normalize("NFD", s))], "a string, b string").select(*[T.normalize_text(c) for c in "ab"]).first()
    assert row[0] == rule(s) and row[1] == rule(unicodedata.normalize("NFD", s))


def test_composition_in_any_order_of_marks(spark):
    texts = ["ệ", "ệ", "plain", None, "가"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.compose_accents("t")).collect()]
    assert got == [t and unicodedata.normalize("NFC", t) for t in texts]


@pytest.mark.parametrize("small", [2000, 0])
def test_gazetteer_gives_each_row_its_answer(spark, small):
    names = spark.createDataFrame([("alpha",), ("gamma",), ("be",), ("a very long name",)], "name string")
    rows = [(1, "in ALPHA"), (1, "gamma ray"), (None, "alpha"), (2, None), (3, "nothing"), (4, "to be"), (5, "a very long name of alpha")]
    got = gazetteer_match(spark.createDataFrame(rows, "query_id int, text string"), names, small=small).collect()
    assert sorted((r.query_id or 0, r.text or "", r.match) for r in got) == sorted(
        [(1, "in ALPHA", "alpha"), (1, "gamma ray", "gamma"), (0, "alpha", "alpha"), (2, "", None), (3, "nothing", None), (4, "to be", "be"), (5, "a very long name of alpha", "a very long name")], key=lambda r: (r[0], r[1])
    )


def test_no_break_space_in_headers(spark):
    head = "KẾ HOẠCH\nngày 2 tháng 3 năm 2024\nSố : 12/KH"
    row = spark.createDataFrame([(head,)], "h string").select(M.doc_type("h"), M.issued_date("h"), M.doc_number("h")).first()
    assert tuple(row) == ("ke_hoach", "02/03/2024", "Số 12/KH")


def test_vectors_of_other_lengths_are_refused(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    corpus = spark.createDataFrame([(1, [1.0, 0.0, 1.0]), (2, [1.0])], "chunk_id int, embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="other lengths"):
        vector_search(queries, corpus, 2).collect()


def test_null_users_are_not_active(spark):
    now = datetime(2024, 1, 8)
    messages = spark.createDataFrame([(1, "user", datetime(2024, 1, 7)), (None, "user", datetime(2024, 1, 7))], "user_id int, sender_type string, created_at timestamp")
    talks = spark.createDataFrame([], "created_at timestamp")
    got = {r.metric: r.value for r in period_report(messages, talks, now).collect()}
    assert got["active_users"] == 1


def test_cached_judgments_stay_single(spark):
    kind = "query_id int, chunk_id int, relevant boolean"
    cache = spark.createDataFrame([(1, 1, True)], kind)
    now = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, None)], kind)
    grown, labels = merge_judgments(cache, now, now)
    assert sorted(tuple(r) for r in grown.collect()) == [(1, 1, True), (1, 2, True)] == sorted(tuple(r) for r in labels.collect())


def test_sample_order_is_that_of_md5(spark):
    import hashlib

    got = sorted(r.id for r in seeded_sample(spark.range(100), 5, 42, "id").collect())
    assert got == sorted(sorted(range(100), key=lambda i: hashlib.md5(f"42/{i}".encode()).hexdigest())[:5])


def test_redelivery_within_a_batch_and_by_name(spark, tmp_path):
    kind = "doc_id long, name string, text string, at int"

    def deliver(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        to_blocks = lambda d: d.select("doc_id", text_blocks("text").alias("blocks"), F.lit(1).alias("page_count"), F.lit(True).alias("has_content"))
        query = stream_ingest(stream, to_blocks, f"{tmp_path}/out", f"{tmp_path}/check", order=("at",), name="name")
        query.awaitTermination()
        chunks, status = read_ingested(spark, f"{tmp_path}/out")
        return sorted((r.doc_id, r.content) for r in chunks.collect()), sorted((r.doc_id, r.chunk_count) for r in status.collect())

    first = deliver([(1, "a.pdf", "old", 1), (1, "a.pdf", "new", 2), (2, "b.pdf", "two", 1), (3, "b.pdf", "three", 5)])
    assert first == ([(1, "new"), (3, "three")], [(1, 1), (3, 1)])
    assert deliver([(9, "a.pdf", "again", 3)]) == ([(3, "three"), (9, "again")], [(3, 1), (9, 1)])
