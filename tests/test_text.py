import re
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import citations as C
from corpusloom.functions import markup as M
from corpusloom.functions import metadata as D
from corpusloom.functions import text as T


def one(spark, column, *values, schema=None):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], schema or names)
    return df.select(column.alias("out")).first()["out"]


def plain_normalize(s):
    s = s.replace("đ", "d").replace("Đ", "D")
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", s.lower()).strip()


@pytest.mark.parametrize("s", ["Đường  Số 1.893", "43/2019/QH14 Xét\ttuyển", "Straße ø", unicodedata.normalize("NFD", "Thủ Đức"), ""])
def test_normalize(spark, s):
    assert one(spark, T.normalize_text("c0"), s) == plain_normalize(s)


def test_normalize_null(spark):
    assert spark.range(1).select(T.normalize_text(F.lit(None).cast("string")).alias("x")).first()["x"] == ""


@pytest.mark.parametrize("s", ["Thủ Đức", "Huế ộ ữ ệ", "café"])
def test_compose(spark, s):
    assert one(spark, T.compose_accents("c0"), unicodedata.normalize("NFD", s)) == unicodedata.normalize("NFC", s)


@pytest.mark.parametrize("s,n", [("", 0), ("  \n", 0), ("a b\nc", 3), (" x y ", 2)])
def test_count_tokens(spark, s, n):
    assert one(spark, T.count_tokens("c0"), s) == n


def test_trigrams(spark):
    grams = lambda s: one(spark, T.word_trigrams("c0"), s)
    assert grams("a b c d a b c") == ["a b c", "b c d", "c d a", "d a b"]
    assert grams("A b") == ["a b"]
    assert grams(" ") == []


def test_trigram_recall_pair(spark):
    assert one(spark, T.trigram_recall("c0", "c1"), "một hai ba bốn", "x mot hai ba y") == 0.5
    assert one(spark, T.trigram_recall("c0", "c1"), "", "a b c") == 0.0


@pytest.mark.parametrize(
    "kw,text,hit",
    [("8", "so 1.893", False), ("8", "lop 8, nam", True), ("a.b", "axb a.b", True), ("a.b", "axb", False), ("", "x", False), ("c\\e+", "in c\\e+ out", True)],
)
def test_keyword_present(spark, kw, text, hit):
    assert one(spark, T.keyword_present("c0", "c1"), kw, text) is hit


@pytest.mark.parametrize("kw,yes", [("8", False), ("12", False), ("abc", True), ("1.", True), ("123", True)])
def test_is_specific(spark, kw, yes):
    assert one(spark, T.is_specific("c0"), kw) is yes


@pytest.mark.parametrize("s,kind", [("- a\n- b", "list"), ("x\n  * a\n\t- b", "list"), ("- a\nb", "text"), ("-a\n-b", "text"), ("", "text")])
def test_chunk_type(spark, s, kind):
    assert one(spark, T.chunk_type("c0"), s) == kind


def test_document_uuid(spark):
    assert one(spark, T.document_uuid("c0"), 17) == str(uuid.uuid5(uuid.NAMESPACE_URL, "document:17"))


def test_clean_path(spark):
    ddl = "c0 array<string>"
    assert one(spark, T.clean_path(F.col("c0")), [" a ", " ", "b"], schema=ddl) == ["a", "b"]
    assert one(spark, T.clean_path(F.col("c0")), ["", " "], schema=ddl) is None


@pytest.mark.parametrize(
    "name,year",
    [("x 2026 - 2027 y.pdf", "2026-2027"), ("x 2026 2027.pdf", "2026-2027"), ("x 2026-2027", "2026-2027"), ("20262027.pdf", "2026-2027"), ("x 2026.pdf", None)],
)
def test_year(spark, name, year):
    assert one(spark, D.parse_year(D.file_stem("c0")), name) == year


@pytest.mark.parametrize(
    "name,ward",
    [
        ("Kế hoạch phường Bình  Thạnh.pdf", "Bình Thạnh"),
        ("địa bàn PHƯỜNG An Phú, năm học 2026 2027.docx", "An Phú"),
        ("xã Bà Điểm năm học 2026", "Bà Điểm"),
        ("đặc khu Côn Đảo 2026", "Côn Đảo"),
        ("không có gì", None),
    ],
)
def test_locality(spark, name, ward):
    assert one(spark, D.locality_name(D.file_stem("c0")), name) == ward


def test_header_fields(spark):
    h = "ubnd\nỦY BAN NHÂN DÂN PHƯỜNG X  \nSố: 12/KH-UBND y\nngày 5 tháng 12 năm 2026\nQUYẾT ĐỊNH về KẾ\nHOẠCH"
    got = [one(spark, f("c0"), h) for f in (D.doc_type, D.issued_date, D.issuing_body, D.doc_number)]
    assert got == ["ke_hoach", "05/12/2026", "ỦY BAN NHÂN DÂN PHƯỜNG X", "Số 12/KH-UBND"]
    assert one(spark, D.doc_type("c0"), "thư") == "khac"
    assert one(spark, D.issued_date("c0"), "thư") is None


def test_strip_markdown(spark):
    assert one(spark, D.strip_markdown("c0"), "# A\n   ### **B** c\n#x __y__") == "A\nB c\n#x y"


@pytest.mark.parametrize("answer", ["A. B [1].\n\nC d [2]! e", "One", "a: b\nc? d… e", "x.  y\n\n\nz.", "Trailing. \n"])
def test_sentences_rebuild(spark, answer):
    parts = one(spark, C.split_sentences("c0"), answer)
    assert "".join(p["text"] + p["delim"] for p in parts) == answer
    assert [p["id"] for p in parts] == list(range(len(parts)))


def test_sentences_edges(spark):
    assert one(spark, C.split_sentences("c0"), " \n") == []
    parts = one(spark, C.split_sentences("c0"), "\nA:\n- b [2][10].")
    assert [(p["text"], p["cited"]) for p in parts] == [("A:", []), ("- b [2][10].", [2, 10])]


@pytest.mark.parametrize(
    "text,ids,out", [("khai sinh [2].", [1], "khai sinh [1]."), ("a [1] b", [2, 3], "a  b [2][3]"), ("a [1]  b [2].", [], "a b ."), ("x…", [4], "x [4]…")]
)
def test_recite(spark, text, ids, out):
    assert one(spark, C.recite("c0", F.col("c1")), text, ids, schema="c0 string, c1 array<int>") == out


@pytest.mark.parametrize("cur,prev,want", [(4, 1, 300.0), (2, 1, 100.0), (1, 3, -66.7), (5, 0, None)])
def test_delta(spark, cur, prev, want):
    assert one(spark, C.delta_pct("c0", "c1"), cur, prev) == want


def test_html_blocks(spark):
    html = (
        "<html><head><title>t</title></head><body><nav>n</nav><script>var a='</p>'</script><!-- <p>c</p> --><h2>Head &amp; b</h2>"
        "<p>one<br>two <b>x</b></p><table><tr><th>A</th><th>B</th></tr><tr><td><p>1</p></td><td></td></tr></table><ul><li>l</li></ul><footer>f</footer></body></html>"
    )
    rows = one(spark, M.html_blocks("c0"), html)
    assert [(r["type"], r["level"], r["value"]) for r in rows if r["type"] != "table"] == [
        ("heading", 2, "Head & b"), ("text", None, "one\ntwo x"), ("text", None, "l"),
    ]
    table = rows[2]
    assert table["type"] == "table" and table["rows"] == [["A", "B"], ["1", None]]
    assert table["md"] == "| A | B |\n| --- | --- |\n| 1 |  |"


def test_task_side_normalization_agrees(spark):
    import random

    rng = random.Random(3)
    letters = "aBc ĐđŘřẠạ…’“”ßẞİıΣσς한글̣́\t\n\x1c\x85\xa0 ﬁ①ǅñÑçÇœÆ𝄞é"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 15))) for _ in range(400)] + [None, "", "plain ASCII  Text", "Ünïcödé text"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.normalize_text("t").alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: T.normalized(t) for i, t in enumerate(texts)}
