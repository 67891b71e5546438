import random
import re
from math import log2

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.arrays import matches, running_sums
from corpusloom.llm import secrets

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def bits(window):
    return -sum(window.count(c) / len(window) * log2(window.count(c) / len(window)) for c in set(window))


def plain(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text):
        s = m[0]
        if not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)) or any(re.search(p, s) for p in secrets.ALLOWED):
            continue
        if re.fullmatch("[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}", s):
            continue
        limit = next(b for _, p, b in secrets.CLASSES if re.search(p, s))
        if max(bits(s[i : i + 20]) for i in range(len(s) - 19)) >= limit:
            out.append((m.start(), 3, "entropy", m.end()))
    return sorted(out)


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'x' as spans", "1 as start").repartition(3)
    rows = secrets.scan_secrets(docs).collect()
    return {r.doc_id: [(s.start, s.place, s.kind, s.end) for s in r.spans] for r in rows}


def test_against_a_plain_version(spark):
    rng = random.Random(5)
    digits = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    hexa, low, both, up = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    parts = [
        lambda: digits(rng.randrange(15, 45), hexa),
        lambda: digits(rng.randrange(15, 45), hexa.upper()),
        lambda: digits(rng.randrange(15, 45), low),
        lambda: digits(rng.randrange(15, 45), both + "+/_-"),
        lambda: "AKIA" + digits(rng.randrange(3, 20), up),
        lambda: rng.choice(("password", "PassWd", "secret", "tOKEN", "api_key", "APIKEY")) + rng.choice(("=", ": ", '" = "', "  :", "'='")) + digits(rng.randrange(0, 12), both + ".="),
        lambda: rng.choice(("token:secret:abcdefg", "password:token:abcdefg", "Donaudampfschifffahrtsgesellschaft", "some-words-with-dashes-2", "é𝄞 ü", "\n", " ", "aaaaaaaaaaaaaaaaaaaaaaaaaa1")),
    ]
    texts = ["".join(rng.choice(parts)() + rng.choice((" ", "\n", "é", "𝄞", "")) for _ in range(rng.randrange(1, 25))) for _ in range(150)]
    texts += [None, "", "x" * 19 + "1", "𝄞" * 30]
    got = found(spark, texts)
    for i, text in enumerate(texts):
        assert got[i] == plain(text), text
    kinds = [s[2] for spans in got.values() for s in spans]
    assert all(kinds.count(k) > 20 for k in secrets.KINDS)


def test_long_texts_and_candidates(spark):
    rng = random.Random(6)
    many = " ".join("token=" + "%030x" % rng.getrandbits(120) for _ in range(3000))
    blob = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/0123456789") for _ in range(60_000))
    texts = [many, "a " + blob, "z" * 400_000 + "1", "word " * 100_000 + "password=hunter22"]
    got = found(spark, texts)
    assert got[0] == plain(many)
    assert got[1] == [(2, 3, "entropy", 60_002)]
    assert got[2] == [] and got[3] == [(500_000, 0, "assign", 500_017)]


def test_allow_list(spark):
    texts = [
        "id 3f2504e0-4f89-11d3-9a0c-0305e82c3301 end",
        "sha256-47DEQpj8HBSa9mTImW5JCeuQeRkm5NMpJWZG3hSuFU",
        "0123456789abcdefghijklmnopqrstuvwxyz",
        "path/to/some/folder/2024/report",
        "yourexample4f9Ak29Zq81LmQx7",
        "rT7f9Ak29Zq81LmQx7Wp3BvN",
    ]
    assert {i: [s[2] for s in spans] for i, spans in found(spark, texts).items()} == {0: [], 1: [], 2: [], 3: [], 4: [], 5: ["entropy"]}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "token=abcdef"), (7, "token=abcdef"), (7, "token=abcdef")], "doc_id long, text string")
    assert sorted((str(r.doc_id), len(r.spans)) for r in secrets.scan_secrets(docs).collect()) == [("7", 1), ("7", 1), ("None", 1)]
    assert secrets.scan_secrets(docs.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = secrets.scan_secrets(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "InArrow", "InPandas", "Exchange"))


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_running_sums(spark, n):
    row = spark.range(1).select(running_sums(F.transform(F.slice(F.sequence(F.lit(1), F.lit(n + 1)), 1, n), lambda x: x * 3)).alias("s")).first()
    assert row.s == [3 * i * (i + 1) // 2 for i in range(n)]


def test_matches(spark):
    row = spark.range(1).select(matches(F.lit("é1 22 𝄞333"), "[0-9]+").alias("m"), matches(F.lit("none"), "[0-9]+").alias("n")).first()
    assert [tuple(m) for m in row.m] == [(1, 2, "1"), (3, 5, "22"), (7, 10, "333")] and row.n == []
