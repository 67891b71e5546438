"""Pages to blocks: what regular expressions got wrong, and pages made to be slow."""

import time

import pytest

from corpusloom.functions.markup import html_blocks, page_blocks


def short(page):
    return [(b["type"], b["level"], b["value"]) if b["type"] != "table" else ("table", b["rows"]) for b in page_blocks(page)]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>1 < 2 and 3 > 2</p>", [("text", None, "1 < 2 and 3 > 2")]),
        ("<p title='a>b'>x</p>", [("text", None, "x")]),
        ("<nav>a<nav>b</nav>menu left</nav><p>x</p>", [("text", None, "x")]),
        ("<template><p>no</p></template><p>x</p>", [("text", None, "x")]),
        (
            "<table><tr><td>a<table><tr><td>in</td><td>side</td></tr></table>b</td><td>c</td></tr><tr><td>d</td></tr></table>",
            [("table", [["a in side b", "c"], ["d"]])],
        ),
        ("<table><caption>Cap</caption><tr><td>1<p>2</p></table>after", [("text", None, "Cap"), ("table", [["1 2"]]), ("text", None, "after")]),
        ("<table><tr><td></td><th>x<td>y</tr></table>", [("table", [[None, "x", "y"]])]),
        ("<div><nav>menu</div>shown", [("text", None, "shown")]),
        ("<head><title>t</title><body>shown", [("text", None, "shown")]),
        ("<title>t</title><p>x", [("text", None, "x")]),
        ("<h1>One<p>two</p></h1>three", [("heading", 1, "One"), ("text", None, "two"), ("text", None, "three")]),
        ("<H2 class=x>A<br>b</H2>", [("heading", 2, "A\nb")]),
        ("<p>don't <a title=don't>go</a> 'now'</p>", [("text", None, "don't go 'now'")]),
        ('<a href="x"">one</a> words <a href="y"">two</a>', [("text", None, "one words two")]),
        ("<p>&lt;b&gt; &eacute;&#233;&#xe9; &nosuch; &amp;lt; a&nbsp;b</p>", [("text", None, "<b> ééé &nosuch; &lt; a b")]),
        ("<script>if (a < b) '</p>'</script><p>x<!-- <p>y --></p><STYLE>p{}</STYLE>z", [("text", None, "x"), ("text", None, "z")]),
        ("x<!-- open", [("text", None, "x")]),
        ("<!doctype html><?xml v?></ >x", [("text", None, "x")]),
        ("</p></div></table>x</td>", [("text", None, "x")]),
        ("a<", [("text", None, "a<")]),
        ("", []),
        ("<script>never closed <p>x</p>", []),
        ("<td>loose</td> cell", [("text", None, "loose"), ("text", None, "cell")]),
    ],
)
def test_pages(page, want):
    assert short(page) == want


HOSTILE = {
    "open tags": lambda n: "<a " * n,
    "open values": lambda n: '<a b="' * n,
    "nested": lambda n: "<div>" * n,
    "closed by others": lambda n: "<b>" * n + "</p>" * n,
    "nested tables": lambda n: "<table><tr><td>" * n + "x",
    "navigation": lambda n: "<nav>" * n + "x" + "</nav>" * (n - 1),
    "comments": lambda n: "<!-- " * n,
    "raw": lambda n: "<style>" * n,
    "angles": lambda n: "<" * n,
    "references": lambda n: "&amp" * n + "&#" * n,
    "equals": lambda n: "<a " + "= " * n,
    "quotes": lambda n: "<a " + "='\" " * n + ">",
    "ends": lambda n: "<p>x</p>" * n,
    "cells": lambda n: "<table>" + "<td>x" * n,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_twice_the_page_takes_about_twice_the_time(name):
    def spent(n):
        page = HOSTILE[name](n)
        start = time.process_time()
        page_blocks(page)
        return time.process_time() - start

    spent(1000)
    assert spent(64_000) < 12 * max(spent(16_000), 0.02)


def test_column(spark):
    rows = spark.createDataFrame([(1, "<h1>T</h1><table><tr><td>a<td></table>"), (2, None), (3, "")], "i int, h string").select("i", html_blocks("h").alias("b")).collect()
    got = {r.i: r.b for r in rows}
    assert got[2] is None and got[3] == []
    assert [tuple(b) for b in got[1]] == [(1, "heading", 1, "T", "# T", None), (1, "table", None, "| a |  |\n| --- | --- |", "| a |  |\n| --- | --- |", [["a", None]])]


def test_a_page_without_text_gives_no_row(spark, tmp_path):
    import catalog

    catalog.load_all()
    rows = [(1, "<p>a</p>"), (2, ""), (3, None), (4, "<html><head><title>t</title></head><body><p> </p></body></html>")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.QUERIES["html_to_blocks"](spark, str(tmp_path)).collect()
    assert [(r.page_id, r.pos, r.value) for r in got] == [(1, 0, "a")]
