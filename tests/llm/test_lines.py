import random

import pytest

from corpusloom.llm import lines

SPACES = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, min_points=1):
    key = lambda x: x.strip(SPACES).translate(LOWER)
    held = {}
    for i, (_, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, set()).add(i)
    gone = {k for k, v in held.items() if len(k) >= min_points and len(v) >= min_docs}
    out = []
    for d, t in rows:
        split = (t or "").split("\n")
        kept = [x for x in split if key(x) not in gone]
        out.append((d, "\n".join(kept), len(split), len(split) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs,min_points", [(10, 1), (3, 1), (3, 8)])
def test_against_a_plain_version(spark, min_docs, min_points):
    rng = random.Random(min_docs)
    pool = [f"line {i}" for i in range(60)] + ["", "  ", "\t", "É", "é", "ÉA ", " Éa", "SAME", "same\r", "\x0bSame\f", "\xa0same"]
    rows = [(i, rng.choice((None, "", *["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 30))) for _ in range(8)]))) for i in range(80)]
    rows += [(None, "line 1\nalone"), (5, "other text\nline 2"), rows[7], rows[7], (900, "long\n" * 30_000 + "line 3"), (901, "w" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as pos", "'a' as h1", "2 as n").repartition(3)
    got = sorted((tuple(r) for r in lines.drop_repeated_lines(docs, min_docs, min_points).collect()), key=str)
    assert got == brute(rows, min_docs, min_points)


def test_other_columns_stay_and_empty_tables_work(spark):
    docs = spark.createDataFrame([(i, "a\nb%d" % i, "s") for i in range(12)], "doc_id long, text string, version string")
    out = lines.without_repeated_lines(docs)
    assert sorted((r.doc_id, r.text, r.version) for r in out.collect()) == [(i, "b%d" % i, "s") for i in range(12)]
    assert lines.drop_repeated_lines(docs.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = lines.drop_repeated_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
