import random

import pytest
from tokenizers import Tokenizer

from corpusloom.llm import bpe
from corpusloom.llm.common import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, text):
    coder = bpe.transducer(PATH)
    want = library.encode(text, add_special_tokens=False).ids
    got = coder.encode(text)
    assert got == want, text[:80]
    assert coder.decode(got) == library.decode(want, skip_special_tokens=False)
    assert coder.decode(got, block=3) == text


def test_every_code_point_next_to_letters_and_blanks(library):
    points = [chr(i) for i in range(1, 0x30000) if not 0xD800 <= i < 0xE000]
    odd = []
    for i in range(0, len(points), 64):
        text = "".join(f"a{c}1{c}{c} {c}b " for c in points[i : i + 64])
        if bpe.transducer(PATH).encode(text) != library.encode(text, add_special_tokens=False).ids:
            odd += [hex(ord(c)) for c in points[i : i + 64] if bpe.transducer(PATH).encode(f"a{c}1{c}{c} {c}b ") != library.encode(f"a{c}1{c}{c} {c}b ", add_special_tokens=False).ids]
    assert not odd, (len(odd), odd[:20])


def test_random_texts(library):
    rng = random.Random(5)
    pool = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "é", "ß", "日本", "🙂", "x1", "99", "guarantee", "ing", "<|endoftext|>", "<|endo", ".", "\r\n", " ", "　", "́", "\x1c", "\x85"]
    for _ in range(3000):
        same(library, "".join(rng.choice(pool) for _ in range(rng.randrange(0, 30))))


def test_long_pieces_and_blocks(library, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(bpe, "PIECE_BLOCK", 64)
    monkeypatch.setattr(bpe, "TEXT_BLOCK", 50)
    for alphabet in ("ab", "guaranteingst", "a", "éè", "0123456789", "-=", " ", "\n "):
        same(library, "".join(rng.choice(alphabet) for _ in range(6000)))
    words = ["internationalization", "guaranteeing", "on", "the", "s"]
    same(library, "".join(rng.choice(words) for _ in range(2000)))
    same(library, " ".join(rng.choice(words) for _ in range(2000)))


def test_invalid_bytes_decode_as_the_library_does(library):
    rng = random.Random(3)
    coder = bpe.transducer(PATH)
    for _ in range(500):
        ids = [rng.choice((rng.randrange(256), rng.randrange(50257))) for _ in range(rng.randrange(12))]
        assert coder.decode(ids, block=2) == library.decode(ids, skip_special_tokens=False)


def test_operator_on_nulls_ties_and_long_texts(spark, library):
    rows = [(1, None, 5), (1, None, 5), (2, "", 1), (3, "word " * 90_000, 2), (None, "ü" * 9000, 0), (4, "a\nb c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()
    assert len(out) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in out:
        assert r.decoded == texts[r.doc_id] and list(r.ids) == library.encode(r.decoded, add_special_tokens=False).ids
    assert bpe.decode_documents(bpe.encode_documents(docs.limit(0), PATH), PATH).collect() == []


def test_lookahead_of_a_small_merge_list():
    assert bpe.sufficient_lookahead([(b"a", b"b")]) == 1
    assert bpe.sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) == 2
    assert bpe.sufficient_lookahead([(b"a", b"b"), (b"b", b"c")]) == 1
