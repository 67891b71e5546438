import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """Share, cut at the limit, and share the rest again until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def rows_of(seed, n=400):
    rng = random.Random(seed)
    names = [None, "b", "a", "é", "z", "hot"] + [f"s{i}" for i in range(rng.randrange(6))]
    return [(i, rng.choice((None, "", *["w " * rng.randrange(1, 90)] * 8)), "hot" if rng.random() < 0.4 else rng.choice(names)) for i in range(n)]


@pytest.mark.parametrize("seed,slice_rows", [(1, 4096), (2, 8), (3, 1)])
def test_targets_and_taken_words(spark, monkeypatch, seed, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    rows = rows_of(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as target", "2 as size").repartition(5)
    got = mixing.training_positions(docs).collect()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    sources = {}
    for d, _, s in rows:
        sources[s] = sources.get(s, 0) + size[d]
    want, taken = targets(sources), {}
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == sources[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert len(r.positions) <= 3 and list(r.positions) == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] = taken.get(r.source, 0) + r["size"] * len(r.positions)
    for s in sources:
        assert abs(taken[s] - want[s]) <= 90
    again = {(r.doc_id, tuple(r.positions)) for r in mixing.training_positions(docs.repartition(2)).collect()}
    assert again == {(r.doc_id, tuple(r.positions)) for r in got}


def test_positions_invert_the_integral(spark):
    for schedule in (*mixing.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (1.0, 0.0))):
        pieces = list(zip(schedule, schedule[1:]))
        whole = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pieces)
        for share, time in spark.range(1, 100).select((F.col("id") / 100).alias("s")).select("s", mixing.demand_time(F.col("s"), schedule)).collect():
            done = 0.0
            for (t0, w0), (t1, w1) in pieces:
                x = min(max(time - t0, 0), t1 - t0)
                done += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
            assert done / whole == pytest.approx(share, abs=1e-9)


def test_mix_repeats_documents_in_order(spark):
    rows = rows_of(5, 120) + [(None, "null id", "a"), (3, "tie of an id", "a"), (7, "long " * 100_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as _version", "4 as positions")
    placed = mixing.training_positions(docs)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == placed.agg(F.sum(F.size("positions"))).first()[0]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.training_positions(docs).collect() == [] and mixing.mix_documents(docs).collect() == []
