import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import sequences
from corpusloom.llm.common import tokenizer_file
from corpusloom.session import materialize, scratch_path

PATH = tokenizer_file("word_bpe_49k.json")


def run(spark, docs, length=16):
    folder = scratch_path(spark, "sequences")
    manifest = materialize(sequences.write_sequences(docs, folder, PATH, 1, length), "manifest")
    return folder, manifest


@pytest.mark.parametrize("length", [1, 16, 4096])
def test_round_trip_against_the_library(spark, length):
    texts = ["Hello World's  end", None, "", "Ünḯcode İ Σ ΑΣ. ΑΣ", "<|startoftext|>a <|STARTOFTEXT|>", "x" * 5000, "a b  c\td\x1ce", "Hello World's  end", "One, two. three,, (four). é, 5. Don't. a., b.c, <|endoftext|>, I.", "one, TWO. x."] * 5
    rows = [(i * 7 % 53, t, "s", i) for i, t in enumerate(texts)] + [(None, "null id", "s", 0), (3, "tie", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, ids int")
    folder, manifest = run(spark, docs, length)
    got = sequences.read_documents(spark, folder, manifest).orderBy("start").collect()
    library = Tokenizer.from_file(PATH)
    assert len(got) == len(rows)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    want = sorted((r[0] if r[0] is not None else -1, zlib.crc32(np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, zlib.crc32(bytes(r.ids))) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens


def test_rows_are_read_without_a_copy(spark):
    docs = spark.createDataFrame([(i, f"word {i} again") for i in range(4000)], "doc_id long, text string").coalesce(1)
    folder, manifest = run(spark, docs, 8)
    path = manifest.orderBy("n_tokens", ascending=False).first().path
    row = sequences.sequence(path, 300)
    with pa.memory_map(path) as source:
        every = pa.ipc.open_file(source).read_all().column("ids").to_pylist()
    assert row["ids"].to_pylist() == every[300]
    assert len(row["ids"]) == 8 == len(row["mask"]) and row["mask"].to_pylist() == [True] * 8
    with pa.memory_map(path) as source:
        before = pa.total_allocated_bytes()
        assert pa.ipc.open_file(source).get_batch(0).column("ids").values.to_numpy(zero_copy_only=True).dtype == np.uint16
        assert pa.total_allocated_bytes() - before < 100


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = scratch_path(spark, "sequences")
    assert sequences.write_sequences(docs, folder, PATH, 1).collect() == []


def test_words_as_the_library_gives_them():
    import random

    library, rng = Tokenizer.from_file(PATH), random.Random(9)
    pool = ["a", "B", "é", "́", "İ", "ß", "ǅ", " ", "　", "日", "🙂", "'s", "9", "-", ".", ",", "\x1c", "\x85", "<|", "|>", "Å", "ﬁ", "한", "ᄒ", "ᅡ"]
    texts = [" ".join("".join(rng.choice(pool) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(40))) for _ in range(400)]
    got = sequences.WordIds(PATH).encode(texts)
    for text, packed in zip(texts, got):
        assert np.frombuffer(packed, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text
