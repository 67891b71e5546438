import random

import numpy as np
import pytest

from corpusloom.llm import passages


def brute(rows, length):
    """Removed places of each distinct (id, text), by looking at every string."""
    texts = {(d, t or "") for d, t in rows}
    first = {}
    order = lambda k: (k[0] is None, k[0] or 0)
    ids = sorted(texts, key=order)
    for key in ids:
        raw = key[1].encode()
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p : p + length], (key, p))
    out = {}
    for key in ids:
        raw = key[1].encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] != (key, p):
                gone[p : p + length] = b"\1" * length
        out[key] = bytes(b for b, g in zip(raw, gone) if not g), "".join(map(str, gone))
    return out


def check(spark, rows, length, gram, chunk, batch):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as version", "'x' as spans").repartition(3)
    got = passages.remove_repeats(docs, length, gram, chunk, batch).collect()
    want = brute(rows, length)
    assert len(got) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(want[d, t or ""])
    for r in got:
        choices = [(k, g) for k, g in texts[r.doc_id] if len(g) == r.n_bytes and k == bytes(r.kept)]
        assert choices, (r.doc_id, r.n_bytes, r.spans)
        gone = bytearray(r.n_bytes)
        for s in r.spans:
            gone[s.start : s.stop] = b"\1" * (s.stop - s.start)
        assert any("".join(map(str, gone)) == g for _, g in choices)


@pytest.mark.parametrize("seed,length,gram,chunk,batch", [(1, 100, 32, 1 << 19, 1 << 16), (2, 40, 12, 300, 50), (3, 20, 8, 64, 7), (4, 100, 32, 200, 16)])
def test_against_every_string(spark, seed, length, gram, chunk, batch):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randrange(2, 60)) for _ in range(6)]
    rows = []
    for i in range(70):
        parts = [rng.choice(shared) if rng.random() < 0.4 else text(rng.randrange(1, 40)) for _ in range(rng.randrange(0, 6))]
        rows.append((rng.randrange(10**6) * 100 + i, " ".join(parts)))
    for i in range(25):
        base = list(rng.choice(rows[:70])[1])
        for _ in range(rng.randrange(0, 4)):
            if base:
                base[rng.randrange(len(base))] = rng.choice("xyz")
        rows.append((rng.randrange(10**6) * 100 + 70 + i, "".join(base)))
    rows += [(-5, None), (-6, ""), (None, shared[0] * 3), (7, "ab" * 150), (8, "a" * 400), (9, "a" * 99), (10, "a" * 100), rows[3], rows[3]]
    check(spark, rows, length, gram, chunk, batch)


def test_empty_table(spark):
    assert passages.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_levels_stay_few():
    family, rng = passages.SuffixFamily(), np.random.default_rng(0)
    every = rng.integers(0, 1 << 60, (64, 100), dtype=np.uint64)
    for batch in every:
        assert not family.seen(batch).any()
        family.add(batch)
    assert len(family.levels) <= 8 and family.seen(every.reshape(-1)).all()
